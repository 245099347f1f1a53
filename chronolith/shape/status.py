"""What a panel says when it has nothing to show."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Status:
    tone: str
    title: str
    detail: str


@dataclass(frozen=True)
class Health:
    store_open: bool = True
    engine_ready: bool = True
    ingest_error: str | None = None
    targets: int = 0
    down: int = 0
    stale: int = 0
    pending: int = 0
    scrape_error: str | None = None


STARTING = Status("empty", "The store is being opened", "Results appear here as soon as it can be read.")
CLOSED = Status("warning", "The store is closed", "No manifest of the sample store could be read.")
ENGINE = Status("empty", "Queries can't run yet", "Results appear here as soon as the Spark session is up.")
WAITING = Status("empty", "No scrape has ended yet", "Samples arrive with the first scrape of any target.")
NOTHING = Status("empty", "Nothing found", "The query has no samples in this range of time.")


def unavailable(health: Health | None) -> Status:
    if health is None:
        return STARTING
    if not health.store_open:
        return CLOSED
    return no_data(health) if health.engine_ready else ENGINE


def no_data(health: Health | None) -> Status:
    h = health or Health()
    if h.ingest_error:
        return Status("error", "Samples aren't being stored", f"The last write failed: {h.ingest_error}")
    if h.down:
        return Status("warning", "Targets are down", h.scrape_error or f"Failed in their last scrape: {h.down}.")
    if h.stale:
        return Status("warning", "Targets are silent", f"Overdue by several intervals: {h.stale}.")
    return WAITING if 0 < h.targets == h.pending else NOTHING


def query_error(error: object) -> Status:
    return Status("error", "The query failed", str(error))
