"""The HTTP API's requests and responses as plain functions and dicts; a server only has to pass them on."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict
from urllib.parse import unquote

from .engine import Engine
from .plans.syntax import QueryError, parse, parse_duration, parse_selector, reach
from .shape.status import Health
from .shape.times import parse_instant
from .sources.registry import Registry
from .sources.store import MetricStore

_SECONDS = re.compile(r"-?\d+(\.\d+)?", re.ASCII)
Params = dict[str, list[str]]


def parse_time(raw: str) -> int:
    """Seconds, or an RFC 3339 time."""
    if _SECONDS.fullmatch(raw):
        return int(float(raw) * 1000 + (0.5 if float(raw) >= 0 else -0.5))
    ms = parse_instant(raw)
    if ms is None:
        raise QueryError(f'invalid time value: "{raw}"')
    return ms


def parse_step(raw: str) -> int:
    return parse_time(raw) if _SECONDS.fullmatch(raw) else parse_duration(raw)


class Api:
    """``registry``: whose metrics ``/metrics`` shows (none: no such path); ``health``: what ``/health`` judges by."""

    def __init__(self, store: MetricStore, version: str = "0", now: Callable[[], int] = lambda: int(time.time() * 1000), lookback_ms: int = 300_000, registry: Registry | None = None, health: Callable[[], Health] = Health):
        self.store, self.version, self.now, self.lookback, self.registry, self.health = store, version, now, lookback_ms, registry, health

    def handle(self, path: str, params: Params) -> tuple[int, object]:
        """Status and body. The export's body is an iterator of lines, that of the metrics their text."""
        try:
            if path in ("/health", "/-/healthy"):
                return self._healthy()
            if path == "/metrics" and self.registry is not None:
                return 200, self.registry.text()
            found = self._routes().get(path)
            if found:
                return 200, found(params)
            label = re.fullmatch(r"/api/v1/label/([^/]+)/values", path)
            if label:
                rows = self.store.label_values(unquote(label[1]), self._first_selector(params)).collect()
                return 200, self._success([r.value for r in rows])
        except QueryError as error:
            return 400, {"status": "error", "errorType": "bad_data", "error": str(error)}
        except Exception as error:  # noqa: BLE001  the boundary to the client
            return 500, {"status": "error", "errorType": "internal", "error": str(error)}
        return 404, {"status": "error", "errorType": "not_found", "error": f"unknown endpoint {path}"}

    def _routes(self) -> dict[str, Callable[[Params], object]]:
        empty = {"/api/v1/metadata": {}, "/api/v1/rules": {"groups": []}, "/api/v1/alerts": {"alerts": []}, "/api/v1/query_exemplars": []}
        return {
            "/api/v1/query": self._query,
            "/api/v1/query_range": self._query_range,
            "/api/v1/series": self._series,
            "/api/v1/labels": lambda p: self._success([r.name for r in self.store.label_names(self._first_selector(p)).collect()]),
            "/api/v1/status/buildinfo": lambda _: self._success({"version": "2.24.0", "application": "tsdb", "pluginVersion": self.version, **dict.fromkeys(("revision", "branch", "buildUser", "buildDate", "goVersion"), "")}),
            "/api/v1/status/tsdb": self._status,
            "/api/v1/export": self._export,
            **{k: lambda _, v=v: self._success(v) for k, v in empty.items()},
        }

    def _healthy(self) -> tuple[int, dict]:
        """503 while the store or engine isn't there or ingest fails."""
        health = self.health()
        ok = health.store_open and health.engine_ready and not health.ingest_error
        return 200 if ok else 503, {"status": "ok" if ok else "error", "metrics_endpoint": "/metrics", **asdict(health)}

    @staticmethod
    def _success(data: object) -> dict:
        return {"status": "success", "data": data}

    @staticmethod
    def _required(params: Params, name: str) -> str:
        if not params.get(name) or not params[name][0]:
            raise QueryError(f'missing required parameter "{name}"')
        return params[name][0]

    @staticmethod
    def _selectors(params: Params) -> list[str]:
        if not params.get("match[]"):
            raise QueryError("no match[] parameter provided")
        return params["match[]"]

    @staticmethod
    def _first_selector(params: Params) -> tuple:
        """Of several selectors only the first counts."""
        return parse_selector(params["match[]"][0]) if params.get("match[]") else ()

    def _engine(self, query: str, start: int, end: int) -> Engine:
        """Over the buckets that the query can see from ``start`` to ``end``."""
        return Engine(self.store.source(start - reach(parse(query), self.lookback), end), self.lookback)

    def _query(self, p: Params) -> dict:
        query, at = self._required(p, "query"), parse_time(p["time"][0]) if p.get("time") else self.now()
        return self._success(self._engine(query, at, at).instant_query(query, at))

    def _query_range(self, p: Params) -> dict:
        query = self._required(p, "query")
        start, end = (parse_time(self._required(p, k)) for k in ("start", "end"))
        return self._success(self._engine(query, start, end).range_query(query, start, end, parse_step(self._required(p, "step"))))

    def _series(self, p: Params) -> dict:
        bounds = [parse_time(p[k][0]) if p.get(k) else None for k in ("start", "end")]
        found: dict[int, dict] = {}
        for text in self._selectors(p):
            for row in self.store.series_matching(parse_selector(text), *bounds).collect():
                found.setdefault(row.sid, row.labels)
        return self._success(list(found.values()))

    def _status(self, _: Params) -> dict:
        s = self.store.quick_stats()
        head = {"numSeries": s["seriesCount"], "numSamples": s["sampleCount"], "minTime": s["oldestSampleMs"], "maxTime": s["newestSampleMs"]}
        return self._success({"headStats": head, "seriesCountByMetricName": []})

    def _export(self, p: Params) -> Iterator[str]:
        selectors = [parse_selector(s) for s in self._selectors(p)]
        start, end = parse_time(p["start"][0]) if p.get("start") else 0, parse_time(p["end"][0]) if p.get("end") else self.now()
        return (r.value + "\n" for r in self.store.export_lines(selectors, start, end).toLocalIterator())
