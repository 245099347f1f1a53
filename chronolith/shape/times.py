"""Time ranges of panels: resolution, moving and zooming, labels of durations, macros in queries and overrides in notes."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from ..plans.syntax import parse_duration

SECOND = 1000
HOUR = 3_600_000
#: An automatic step aims at so many points.
POINTS = 250
#: Numbers below are seconds, others milliseconds.
SECONDS_BELOW = 10_000_000_000


def _rounded(x: float) -> int:
    return math.floor(x + 0.5)


def auto_step(range_ms: float) -> int:
    return max(SECOND, math.ceil(range_ms / POINTS / SECOND) * SECOND)


def duration_label(ms: float) -> str:
    rest, parts = max(0, _rounded(ms)), []
    for unit, size in (("d", 86_400_000), ("h", HOUR), ("m", 60_000), ("s", SECOND), ("ms", 1)):
        n, rest = divmod(rest, size)
        if n or (unit == "ms" and not parts):
            parts.append(f"{n}{unit}")
    return "".join(parts)


def parse_instant(text: str) -> int | None:
    """An ISO time in milliseconds; without a zone it is UTC."""
    try:
        at = datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    return _rounded((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def _is_number(value: object) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)


def parse_duration_value(value: object) -> float | None:
    if _is_number(value) and value > 0:
        return value * 1000
    return parse_duration(value.strip()) if isinstance(value, str) and value.strip() else None


def parse_time_value(value: object) -> int | None:
    if _is_number(value):
        return _rounded(value * 1000 if abs(value) < SECONDS_BELOW else value)
    if isinstance(value, datetime):
        return parse_instant(value.isoformat())
    return parse_instant(value) if isinstance(value, str) and value.strip() else None


@dataclass(frozen=True)
class Overrides:
    start_ms: int | None = None
    end_ms: int | None = None
    step_ms: float | None = None

    def __bool__(self) -> bool:
        return (self.start_ms, self.end_ms, self.step_ms) != (None, None, None)


@dataclass(frozen=True)
class Range:
    start_ms: int
    end_ms: int
    step_ms: float
    live: bool = False
    overridden: bool = False

    @property
    def range_ms(self) -> int:
        return max(1, self.end_ms - self.start_ms)


@dataclass(frozen=True)
class State:
    """Absolute with a start and an end, else relative to an end or to now."""

    range_ms: float = HOUR
    start_ms: int | None = None
    end_ms: int | None = None
    step_ms: float | None = None


def resolve(state: State, panel_step_ms: float | None, overrides: Overrides | None, now_ms: int) -> Range:
    overrides = overrides or Overrides()
    absolute = state.start_ms is not None and state.end_ms is not None
    end = state.end_ms if state.end_ms is not None else now_ms
    start = state.start_ms if absolute else end - state.range_ms
    live = not absolute and state.end_ms is None and overrides.end_ms is None
    start = start if overrides.start_ms is None else overrides.start_ms
    end = end if overrides.end_ms is None else overrides.end_ms
    start, end = sorted((start, end))
    given = (overrides.step_ms, state.step_ms, panel_step_ms, auto_step(max(1, end - start)))
    return Range(start, end, next(s for s in given if s is not None), live, bool(overrides))


@dataclass
class TimeContext:
    """The state that panels share; listeners are told of every change."""

    state: State = field(default_factory=State)
    listeners: list = field(default_factory=list)

    def subscribe(self, listener):
        self.listeners.append(listener)
        return lambda: self.listeners.remove(listener)

    def _set(self, state: State) -> None:
        self.state = state
        for listener in list(self.listeners):
            listener()

    def set_relative(self, range_ms: float) -> None:
        self._set(replace(self.state, range_ms=max(1000, range_ms), start_ms=None, end_ms=None))

    def set_absolute(self, start_ms: int, end_ms: int) -> None:
        a, b = sorted((start_ms, end_ms))
        self._set(replace(self.state, range_ms=max(1, b - a), start_ms=a, end_ms=b))

    def set_step(self, step_ms: float | None) -> None:
        self._set(replace(self.state, step_ms=step_ms))

    def shift(self, direction: int, now_ms: int) -> None:
        """One window back (-1) or on (1); one that would reach the present becomes relative."""
        now = resolve(self.state, None, None, now_ms)
        by = direction * now.range_ms
        if direction > 0 and now.end_ms + by >= now_ms:
            self.set_relative(now.range_ms)
        else:
            self.set_absolute(now.start_ms + by, now.end_ms + by)

    def zoom(self, factor: float, now_ms: int) -> None:
        now = resolve(self.state, None, None, now_ms)
        half, middle = max(1000, now.range_ms * factor) / 2, (now.start_ms + now.end_ms) / 2
        if now.live and middle + half >= now_ms:
            self.set_relative(2 * half)
        else:
            self.set_absolute(_rounded(middle - half), _rounded(middle + half))


def expand_macros(query: str, r: Range) -> str:
    values = {"from": str(_rounded(r.start_ms)), "to": str(_rounded(r.end_ms))}
    for name, ms in (("range", r.range_ms), ("interval", r.step_ms)):
        values |= {name: duration_label(ms), f"{name}_ms": str(_rounded(ms)), f"{name}_s": str(_rounded(ms / 1000))}
    longest_first = "|".join(sorted(values, key=len, reverse=True))
    return re.sub(rf"\$__({longest_first})", lambda m: values[m[1]], query)


def overrides_of(front_matter: object) -> Overrides | None:
    """From ``tsdb.time.{start,end,step}`` or ``tsdb.{start,end,step}``."""
    root = front_matter.get("tsdb") if isinstance(front_matter, dict) else None
    if not isinstance(root, dict):
        return None
    own = root["time"] if isinstance(root.get("time"), dict) else root
    return Overrides(parse_time_value(own.get("start")), parse_time_value(own.get("end")), parse_duration_value(own.get("step"))) or None


def front_matter(note: str, load) -> object:
    """What ``load`` (a YAML parser) makes of the front matter; None without one or if it fails."""
    found = re.match(r"---\r?\n(.*?)\r?\n---(?:\r?\n|$)", note, re.DOTALL)
    try:
        return load(found[1]) if found else None
    except Exception:  # noqa: BLE001  whatever the parser raises
        return None
