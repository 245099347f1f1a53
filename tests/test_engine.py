"""Queries over small in-memory series, with results worked out by hand."""

import math

import pytest

from chronolith.api import Api
from chronolith.engine import Engine, number_text
from chronolith.plans.syntax import QueryError, parse, parse_duration, parse_selector
from chronolith.plans.values import Source
from chronolith.sources.store import MetricStore

T = 120_000


def engine(spark, *series, **options):
    rows = [({"__name__": name, **labels}, ts, float(v)) for name, labels, points in series for ts, v in points]
    df = spark.createDataFrame(rows, "labels map<string,string>, ts long, value double")
    return Engine(Source.of(df), **options)


COUNTER = ("c", {"job": "a"}, [(t, t / 1000) for t in range(0, 120_001, 10_000)])
PAIR = [("m", {"i": "1"}, [(T, 3)]), ("m", {"i": "2"}, [(T, 10)])]


def vector(result):
    assert result["resultType"] == "vector"
    return {tuple(sorted(r["metric"].items())): r["value"][1] for r in result["result"]}


def test_lookback_is_strict(spark):
    e = engine(spark, ("m", {"job": "a"}, [(0, 7)]))
    assert vector(e.instant_query("m", 299_999)) == {(("__name__", "m"), ("job", "a")): "7"}
    assert vector(e.instant_query("m", 300_000)) == {}


def test_rate_of_counter_and_range(spark):
    e = engine(spark, COUNTER)
    assert vector(e.instant_query("rate(c[60s])", T)) == {(("job", "a"),): "1"}
    got = e.range_query("rate(c[60s])", 60_000, 120_000, 30_000)["result"]
    assert [round(float(v), 9) for _, v in got[0]["values"]] == [1.0, 1.0, 1.0]
    raw = e.instant_query("c[30s]", T)
    assert raw["resultType"] == "matrix" and [p[0] for p in raw["result"][0]["values"]] == [100, 110, 120]


def test_reset(spark):
    e = engine(spark, ("c", {}, [(0, 100), (30_000, 130), (60_000, 10), (90_000, 40), (120_000, 70)]))
    (v,) = vector(e.instant_query("rate(c[120s])", T)).values()
    assert 0.5 < float(v) < 1.5
    assert list(vector(e.instant_query("resets(c[120s])", T)).values()) == ["1"]
    assert list(vector(e.instant_query("changes(c[120s])", T)).values()) == ["3"]
    assert list(vector(e.instant_query("irate(c[120s])", T)).values()) == ["1"]
    assert list(vector(e.instant_query("idelta(c[120s])", T)).values()) == ["30"]


def test_sum_by(spark):
    e = engine(spark, ("m", {"job": "a", "instance": "1"}, [(T, 1)]), ("m", {"job": "a", "instance": "2"}, [(T, 2)]), ("m", {"job": "b", "instance": "3"}, [(T, 5)]))
    assert vector(e.instant_query("sum by (job) (m)", T)) == {(("job", "a"),): "3", (("job", "b"),): "5"}
    assert vector(e.instant_query("sum(m) by (job)", T)) == vector(e.instant_query("sum without (instance) (m)", T))
    assert vector(e.instant_query("count(m)", T)) == {(): "3"}
    assert vector(e.instant_query("quantile(0.5, m)", T)) == {(): "2"}
    assert vector(e.instant_query("quantile(-1, m)", T)) == {(): "-Inf"}


def test_histogram_quantile(spark):
    e = engine(spark, *[("h_bucket", {"job": "x", "le": le}, [(T, n)]) for le, n in (("1", 50), ("2", 100), ("+Inf", 100))])
    assert vector(e.instant_query("histogram_quantile(0.5, h_bucket)", T)) == {(("job", "x"),): "1"}
    assert vector(e.instant_query("histogram_quantile(0.75, h_bucket)", T)) == {(("job", "x"),): "1.5"}
    assert vector(e.instant_query("histogram_quantile(2, h_bucket)", T)) == {(("job", "x"),): "+Inf"}


def test_arithmetic_filter_and_bool(spark):
    e = engine(spark, *PAIR)
    assert vector(e.instant_query("m * 2", T)) == {(("i", "1"),): "6", (("i", "2"),): "20"}
    assert vector(e.instant_query("m > 5", T)) == {(("__name__", "m"), ("i", "2")): "10"}
    assert vector(e.instant_query("m > bool 5", T)) == {(("i", "1"),): "0", (("i", "2"),): "1"}
    assert vector(e.instant_query("m / 0", T)) == {(("i", "1"),): "+Inf", (("i", "2"),): "+Inf"}
    assert vector(e.instant_query("m % 0", T)) == {}
    assert vector(e.instant_query("-m", T)) == {(("i", "1"),): "-3", (("i", "2"),): "-10"}
    assert vector(e.instant_query("topk(1, m)", T)) == {(("__name__", "m"), ("i", "2")): "10"}
    assert vector(e.instant_query("bottomk(1, m)", T)) == {(("__name__", "m"), ("i", "1")): "3"}
    assert vector(e.instant_query("topk(scalar(vector(1)), m)", T)) == {(("__name__", "m"), ("i", "2")): "10"}
    assert [r["value"][1] for r in e.instant_query("sort_desc(m)", T)["result"]] == ["10", "3"]
    assert vector(e.instant_query("clamp(m, 4, 5)", T)) == {(("i", "1"),): "4", (("i", "2"),): "5"}
    assert vector(e.instant_query("round(m, 4)", T)) == {(("i", "1"),): "4", (("i", "2"),): "12"}
    assert vector(e.instant_query("ln(m - 3)", T)) == {(("i", "1"),): "-Inf", (("i", "2"),): number_text(math.log(7))}
    assert vector(e.instant_query("m == NaN", T)) == {}
    assert len(vector(e.instant_query("m != NaN", T))) == 2


def test_joins(spark):
    e = engine(spark, ("a", {"job": "x"}, [(T, 10)]), ("b", {"job": "x"}, [(T, 4)]), ("b", {"job": "y"}, [(T, 1)]))
    assert vector(e.instant_query("a / b", T)) == {(("job", "x"),): "2.5"}
    assert vector(e.instant_query("b unless a", T)) == {(("__name__", "b"), ("job", "y")): "1"}
    assert vector(e.instant_query("b and a", T)) == {(("__name__", "b"), ("job", "x")): "4"}
    assert vector(e.instant_query("a or b", T)) == {(("__name__", "a"), ("job", "x")): "10", (("__name__", "b"), ("job", "y")): "1"}
    with pytest.raises(QueryError, match="multiple matches on the right side"):
        e.instant_query("a / on() b", T)
    with pytest.raises(QueryError, match="multiple matches on the left side"):
        e.instant_query("b / on() a", T)


def test_scalars_and_absence(spark):
    e = engine(spark, *PAIR)
    assert e.instant_query("1 + 2 * 3", T) == {"resultType": "scalar", "result": [120, "7"]}
    assert e.instant_query("-2 ^ 2", T)["result"][1] == "4"
    assert e.instant_query("2 ^ 3 ^ 2", T)["result"][1] == "512"
    assert e.instant_query('"x"', T) == {"resultType": "string", "result": [120, "x"]}
    assert e.instant_query("scalar(m)", T)["result"][1] == "NaN"
    assert e.instant_query('scalar(m{i="1"}) + time()', T)["result"][1] == "123"
    assert vector(e.instant_query('absent(m{i="7",j=~"x"})', T)) == {(("i", "7"),): "1"}
    assert vector(e.instant_query("absent(m)", T)) == {}
    assert vector(e.instant_query("vector(2)", T)) == {(): "2"}
    assert e.range_query("1h / 60", 0, 60_000, 30_000)["result"][0]["values"] == [[0, "60"], [30, "60"], [60, "60"]]


def test_series_that_lose_their_names(spark):
    e = engine(spark, ("a", {"x": "1"}, [(T, 1)]), ("b", {"x": "1"}, [(T, 2)]))
    got = e.range_query('abs({x="1"})', T, T, 1000)["result"]
    assert [r["metric"] for r in got] == [{"x": "1"}] * 2 and sorted(r["values"][0][1] for r in got) == ["1", "2"]


ERRORS = {
    "c[5m]": "range queries require an instant vector",
    "m[5m:1m]": "subqueries are not supported",
    "a / on(x) group_left b": "group_left is not supported by this engine",
    "m{": "expected a label name but found",
    "rate(m[5m]) extra": 'unexpected "extra" at position 12',
    "sum by (a) (m) by (b)": "duplicate grouping clause",
    "topk(m)": "topk expects exactly 2 arguments",
    "rate(m)": "expects a range vector like metric",
    "nope(m)": 'unknown or unsupported function "nope"',
    "1 > 2": "must use the bool modifier",
    "1 and m": 'set operator "and" requires vector operands',
    '"a" + 1': "string literals are not allowed",
    "1 + bool 2": "bool modifier is only valid",
    "m @ 5": 'unexpected character "@" at position 2',
    "'abc": "unterminated string at position 0",
    "{}": "at least one matcher",
    "m[1s2h]": "invalid duration",
    "abs(1)": "abs() expects an instant vector here",
    "m offset 5": "expected a duration",
    "sum(m[5m])": "range vector is not allowed here",
    '"s"': "string expressions are not valid",
}


@pytest.mark.parametrize("query", ERRORS)
def test_errors(spark, query):
    import re

    with pytest.raises(QueryError, match=re.escape(ERRORS[query])):
        engine(spark, *PAIR).range_query(query, 0, 60_000, 30_000)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_functions_fold_samples_of_a_store_before_any_shuffle(spark, tmp_path):
    store = MetricStore(spark, f"file://{tmp_path}/store")
    rows = [({"__name__": "m", "i": str(i)}, float(t * 1000), float((t * (i + 1)) % 50)) for i in range(3) for t in range(300)]
    store.ingest(spark.createDataFrame(rows, "labels map<string,string>, ts double, value double"))
    source = store.source(0, 300_000)
    table = Engine(source).table("rate(m[1m])", 60_000, 290_000, 10_000)
    plan = plan_of(table)
    below = plan[plan.index("MapInArrow") :]
    assert "Window" in plan and "Exchange hashpartitioning" not in below and "Window" not in below, plan
    plain = Engine(Source(source.series, source.samples.repartition(5, "ts"))).table("rate(m[1m])", 60_000, 290_000, 10_000)
    got, want = ({(r.labels["i"], r.step): r.value for r in t.collect()} for t in (table, plain))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(got) == 72


def test_api_reads_only_the_buckets_that_a_query_can_see(spark, tmp_path):
    store = MetricStore(spark, f"file://{tmp_path}/store", bucket_ms=1000)
    store.ingest(spark.createDataFrame([({"__name__": "m"}, float(t), 1.0) for t in range(0, 20_000, 500)], "labels map<string,string>, ts double, value double"))
    seen = Api(store, lookback_ms=1500)._engine("m offset 2s or rate(m[3s] offset 1s)", 12_000, 13_000).source.samples
    assert "FileScan" in plan_of(seen)
    assert sorted({int(f.split("bucket=")[1].split("/")[0]) for f in seen.inputFiles()}) == list(range(8000, 14_000, 1000))


def test_step_limit(spark):
    with pytest.raises(QueryError, match="would evaluate 1001 steps, exceeding the limit of 10"):
        engine(spark, *PAIR, max_steps=10).range_query("m", 0, 1_000_000, 1000)


def test_syntax():
    assert parse("sum by (job) (m)") == parse("sum(m) by (job)")
    assert parse("foo[5m] offset 1h") == parse("foo offset 1h [5m]")
    assert parse("a + b * c").op == "+"
    assert parse_duration("1h30m") == 5_400_000
    assert [m.value for m in parse_selector('up{job="x", b=~"y",}')] == ["up", "x", "y"]
    with pytest.raises(QueryError, match="not a valid series selector"):
        parse_selector("up[5m]")


@pytest.mark.parametrize(("value", "text"), [(7.0, "7"), (0.1, "0.1"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1.5e-7, "1.5e-7"), (-0.0, "0"), (123456.789, "123456.789"), (5e-324, "5e-324"), (-2.5, "-2.5")])
def test_number_text(value, text):
    assert number_text(value) == text
