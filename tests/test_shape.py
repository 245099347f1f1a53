"""Panels, time ranges and the API."""

import json
import math

import pytest

from chronolith.api import Api, parse_step, parse_time
from chronolith.engine import Engine
from chronolith.plans.syntax import QueryError
from chronolith.plans.values import Source
from chronolith.shape import panels, times
from chronolith.shape.status import Health
from chronolith.sources.registry import Registry
from chronolith.sources.store import MetricStore


def test_alignment_and_legends(spark):
    rows = spark.createDataFrame([({"a": "1"}, 100, 1.0), ({"a": "1"}, 130, 4.0)], "labels map<string,string>, step long, value double")
    assert panels.align(rows, 100, 130, 10).first()["values"] == [1.0, None, None, 4.0]
    ops = [({"__name__": "m", "op": o, "x": "1"}, None) for o in ("open", "modify")]
    assert panels.legends(ops) == ['op="open"', 'op="modify"']
    assert panels.legend({"__name__": "m", "b": "2", "a": "1"}) == 'm{a="1", b="2"}'
    assert panels.legend({"a": "1"}, "{{ a }}-{{b}}") == "1-" and panels.legend({}) == "value"
    assert panels.axis_size(["1"]) == 70 and panels.axis_size(["x" * 99]) == 140


@pytest.mark.parametrize(("v", "unit", "text"), [(2**28, "bytes", "256.0 MiB"), (1536, "B", "1.5 KiB"), (0.042, "s", "42 ms"), (0.0042, "s", "4.20 ms"), (90, "ops", "90 ops"), (2.5e6, None, "2.50M"), (1234.5, None, "1234.50"), (0.01234, None, "0.0123"), (math.inf, "b", "∞"), (12345, None, "12.35k")])
def test_formats(v, unit, text):
    assert panels.format_unit(v, unit) == text


def test_panels():
    p = panels.panel({"queries": ["up", {"expr": " m ", "legend": "{{a}}"}], "range": "1h", "refresh": 1, "type": "stat"})
    assert [q.expr for q in p.queries] == ["up", "m"] and p.refresh_s == 5 and p.step() == 15_000
    assert panels.parse_panel("sum(m{a='b'})", json.loads).queries[0].expr == "sum(m{a='b'})"
    assert panels.parse_panel('{"query": "up"}', json.loads).queries[0].expr == "up"
    for bad in ({}, [], {"query": "m", "type": "pie"}):
        with pytest.raises(QueryError):
            panels.panel(bad)


def test_times():
    r = times.Range(0, 90_000, 10_000)
    assert times.expand_macros("sum(increase(foo_total[$__range])) / $__range_s # $__interval", r) == "sum(increase(foo_total[1m30s])) / 90 # 10s"
    o = times.overrides_of({"tsdb": {"time": {"start": 1, "end": 61, "step": 10}}})
    got = times.resolve(times.State(), None, o, 10**12)
    assert (got.start_ms, got.end_ms, got.step_ms, got.live, got.overridden) == (1000, 61_000, 10_000, False, True)
    assert times.resolve(times.State(), 7000, None, 3_600_000) == times.Range(0, 3_600_000, 7000, True)
    assert times.overrides_of({"tsdb": {}}) is None and times.duration_label(0) == "0ms" and times.duration_label(90_061) == "1m30s61ms"
    c, calls = times.TimeContext(), []
    c.subscribe(lambda: calls.append(1))
    c.set_absolute(5000, 1000)
    c.shift(-1, 10**9)
    assert (c.state.start_ms, c.state.end_ms, len(calls)) == (-3000, 1000, 2)
    c.zoom(2, 10**9)
    assert (c.state.start_ms, c.state.end_ms) == (-5000, 3000)
    c.set_relative(60_000)
    c.shift(1, 10**9)
    assert c.state.start_ms is None
    assert times.front_matter("---\nx\n---\nbody", lambda t: t) == "x" and times.front_matter("body", str) is None


def test_panel_runs(spark):
    rows = spark.createDataFrame([({"__name__": "m"}, t, float(t)) for t in range(0, 60_001, 10_000)], "labels map<string,string>, ts long, value double")
    engine = Engine(Source.of(rows))
    (table,) = panels.panel("avg_over_time(m[$__interval])").run(engine, times.Range(20_000, 60_000, 20_000))
    assert sorted((r.step, r.value) for r in table.collect()) == [(20_000, 15_000.0), (40_000, 35_000.0), (60_000, 55_000.0)]
    (table,) = panels.panel({"query": "m", "type": "stat"}).run(engine, times.Range(0, 60_000, 20_000))
    assert [r.value for r in table.collect()] == [60_000.0]


def test_api(spark, tmp_path):
    store = MetricStore(spark, f"file://{tmp_path}/s")
    rows = [({"__name__": "m", "job": j}, t, v) for j, t, v in (("a", 1000.0, 1.0), ("a", 2000.0, 2.0), ("b", 1500.0, 3.0))]
    store.ingest(spark.createDataFrame(rows, "labels map<string,string>, ts double, value double"))
    api = Api(store, now=lambda: 2000)
    assert api.handle("/health", {})[0] == 200 and api.handle("/metrics", {})[0] == 404
    reg = Registry()
    reg.counter("c_total").inc(3)
    sick = Api(store, registry=reg, health=lambda: Health(ingest_error="disk full"))
    assert sick.handle("/metrics", {}) == (200, reg.text())
    code, body = sick.handle("/-/healthy", {})
    assert (code, body["status"], body["ingest_error"]) == (503, "error", "disk full")
    status, body = api.handle("/api/v1/query", {"query": ["sum(m)"]})
    assert status == 200 and body == {"status": "success", "data": {"resultType": "vector", "result": [{"metric": {}, "value": [2, "5"]}]}}
    _, body = api.handle("/api/v1/query_range", {"query": ['m{job="a"}'], "start": ["1"], "end": ["1970-01-01T00:00:02Z"], "step": ["1s"]})
    assert body["data"]["result"][0]["values"] == [[1, "1"], [2, "2"]]
    assert api.handle("/api/v1/labels", {})[1]["data"] == ["__name__", "job"]
    assert api.handle("/api/v1/label/job/values", {"match[]": ["m", "zzz"]})[1]["data"] == ["a", "b"]
    assert len(api.handle("/api/v1/series", {"match[]": ["m", '{job="a"}']})[1]["data"]) == 2
    lines = list(api.handle("/api/v1/export", {"match[]": ['{job="a"}']})[1])
    assert json.loads(lines[0]) == {"metric": {"__name__": "m", "job": "a"}, "values": [1.0, 2.0], "timestamps": [1000, 2000]}
    assert api.handle("/api/v1/status/tsdb", {})[1]["data"]["headStats"] == {"numSeries": 2, "numSamples": 3, "minTime": 1000, "maxTime": 2000}
    assert api.handle("/api/v1/rules", {})[1]["data"] == {"groups": []} and api.handle("/api/v1/status/buildinfo", {})[1]["data"]["version"] == "2.24.0"
    assert api.handle("/nope", {})[0] == 404
    for path, params, error in (("query", {}, 'missing required parameter "query"'), ("series", {}, "no match[] parameter provided"), ("query", {"query": ["m"], "time": ["x"]}, 'invalid time value: "x"')):
        assert api.handle(f"/api/v1/{path}", params) == (400, {"status": "error", "errorType": "bad_data", "error": error})
    assert parse_time("1700000000.5") == 1_700_000_000_500 and parse_step("15") == 15_000 and parse_step("1m30s") == 90_000
