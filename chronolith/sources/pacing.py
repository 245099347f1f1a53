"""How much maintenance to do at once, and how long to wait between: limits that follow the time the last batch took."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Pace:
    """A limit between ``least`` and ``most`` that aims at batches of ``target_ms``."""

    least: int
    most: int
    target_ms: float

    def following(self, current: float, took_ms: float, least: float | None = None) -> int:
        """The next limit: a fifth under what the target allows after a slow batch, a quarter more after a quick one."""
        low = self._within(self.least if least is None else least, self.least)
        now = self._within(current, low)
        if not math.isfinite(took_ms) or took_ms <= 0:
            return now
        load = took_ms / self.target_ms
        if load > 1.25:
            return max(low, min(now - 1, math.floor(now / load * 0.8)))
        return min(self.most, max(now + 1, math.ceil(now * 1.25))) if load < 0.5 else now

    def _within(self, value: float, low: int) -> int:
        return max(low, min(self.most, math.floor(value)))


# Limits in points and in pages, with their target in milliseconds.
COMPACTION = Pace(64, 512, 50)
VACUUM = Pace(8, 256, 50)
#: Queries within so many milliseconds count as active.
ACTIVE_MS = 3000
HOUR_MS = 3_600_000
# Age of the backlog, then the least points of a batch and the pause after it.
BY_AGE = ((7 * HOUR_MS, 512, 250), (4 * HOUR_MS, 256, 400), (-math.inf, 64, 500))
#: Pauses while queries are active: those that wait over 100 ms ask for the longer one.
PRESSED_MS, BUSY_MS, LONG_WAIT_MS = 1000, 750, 100


def _by_age(backlog_age_ms: float) -> tuple[int, int]:
    return next((points, pause) for age, points, pause in BY_AGE if backlog_age_ms >= age)


def point_floor(backlog_age_ms: float, recent_query_age_ms: float) -> int:
    """The least points of a batch: an old backlog asks for more, unless queries are active."""
    return COMPACTION.least if recent_query_age_ms <= ACTIVE_MS else _by_age(backlog_age_ms)[0]


def pause_ms(backlog_age_ms: float, recent_query_age_ms: float, recent_query_wait_ms: float) -> int:
    if recent_query_age_ms <= ACTIVE_MS:
        return PRESSED_MS if recent_query_wait_ms > LONG_WAIT_MS else BUSY_MS
    return _by_age(backlog_age_ms)[1]
