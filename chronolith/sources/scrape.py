"""Scraping: a table of targets becomes a table of scrapes, each target fetched by one task."""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .exposition import instance_of

#: Shortest intervals between scrapes of the own registry and of targets.
SELF_LEAST_S, TARGET_LEAST_S = 1, 5
REDIRECTS = 3


class ScrapeError(RuntimeError):
    pass


class _NoRedirect(HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def fetch_text(url: str, timeout_s: float, redirects: int = REDIRECTS) -> str:
    """The body of an http or https address; anything but 200 after the redirects is an error. The time limit holds for all of it."""
    opener, end, at = build_opener(_NoRedirect), time.monotonic() + timeout_s, url
    for _ in range(redirects + 1):
        parts = urlsplit(at)
        if not parts.netloc:
            raise ScrapeError(f"invalid target URL: {at}")
        if parts.scheme not in ("http", "https"):
            raise ScrapeError(f"unsupported target URL protocol: {parts.scheme}:")
        left = end - time.monotonic()
        if left <= 0:
            raise ScrapeError(f"scrape timeout for {at}")
        try:
            with opener.open(Request(at), timeout=left) as answer:
                if answer.status != 200:
                    raise ScrapeError(f"unexpected status {answer.status} from {at}")
                return answer.read().decode("utf-8", "replace")
        except HTTPError as error:
            place = error.headers.get("Location")
            if not 300 <= error.code < 400 or not place:
                raise ScrapeError(f"unexpected status {error.code} from {at}") from None
            at = urljoin(at, place)
        except TimeoutError:
            raise ScrapeError(f"scrape timeout for {at}") from None
        except URLError as error:
            late = isinstance(error.reason, TimeoutError)
            raise ScrapeError(f"scrape timeout for {at}" if late else str(error.reason)) from None
    raise ScrapeError(f"too many redirects for {at}")


SCRAPED = "job string, instance string, ts long, up boolean, duration_seconds double, text string, error string"


def scrape(targets: DataFrame, timeout_s: float = 10) -> DataFrame:
    """(job, url) to (job, instance, ts, up, duration_seconds, text, error); a failed target is a row too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for job, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now, begin, text, error = int(time.time() * 1000), time.perf_counter(), None, None
                try:
                    text = fetch_text(url, timeout_s)
                except (ScrapeError, OSError, ValueError) as failure:
                    error = str(failure)
                rows.append({"job": job, "instance": instance_of(url), "ts": now, "up": error is None, "duration_seconds": time.perf_counter() - begin, "text": text, "error": error})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return targets.select("job", "url").repartition("url").mapInArrow(run, SCRAPED)


_SCHEMA = pa.schema([("job", pa.string()), ("instance", pa.string()), ("ts", pa.int64()), ("up", pa.bool_()), ("duration_seconds", pa.float64()), ("text", pa.string()), ("error", pa.string())])


def due(targets: list[dict], last_ms: dict[str, int], now_ms: int) -> list[dict]:
    """Targets (job, url, interval_seconds, enabled) whose interval has passed; intervals have a lower bound."""
    out = []
    for t in targets:
        every = max(TARGET_LEAST_S, t.get("interval_seconds", TARGET_LEAST_S)) * 1000
        if t.get("enabled", True) and now_ms - last_ms.get(t["url"], -every) >= every:
            out.append(t)
    return out


class Schedule:
    """Which targets to scrape when: none while its last scrape runs, and no result counts of targets that have been replaced since."""

    def __init__(self, targets: list[dict]):
        self.generation = 0
        self.replace(targets)

    def replace(self, targets: list[dict]) -> None:
        self.generation += 1
        self.targets, self.last_ms, self.running = list(targets), {}, set()

    def begin(self, now_ms: int) -> list[tuple[dict, int]]:
        """Targets to scrape now, each with the generation to give back."""
        idle = [t for t in self.targets if t["url"] not in self.running]
        found = due(idle, self.last_ms, now_ms)
        for t in found:
            self.running.add(t["url"])
            self.last_ms[t["url"]] = now_ms
        return [(t, self.generation) for t in found]

    def end(self, target: dict, generation: int) -> bool:
        """Whether the result still counts; the interval runs from the beginning of a scrape."""
        if generation != self.generation:
            return False
        self.running.discard(target["url"])
        return True


def targets_frame(spark: SparkSession, targets: list[dict]) -> DataFrame:
    return spark.createDataFrame([(t["job"], t["url"]) for t in targets], "job string, url string")
