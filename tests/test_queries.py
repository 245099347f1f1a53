"""Registered queries against their SQL, and an engine over random series against a plain evaluation."""

import math
import random

import duckdb
import pytest

import __spark_entry__
from chronolith import queries, store_queries
from chronolith.engine import Engine
from chronolith.plans.values import Source

SF = "/root/testdata/sf0.001"
CHOSEN = [*list(queries.PROMQL)[::5], "w1_rate_resets", "m14_histogram_quantile", "b18_or", "a9_topk", *list(store_queries.queries())]


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return connection


def flat(v):
    return ("nan" if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, SF)
    want = sql.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr([flat(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(repr([flat(r[want.columns.index(c)]) for c in columns]) for r in want.fetchall())


def test_whole_range_has_every_event(spark, sql):
    start, end = queries.whole_range(spark, SF)
    inside = f"epoch_ms(ts) > {start - queries.STEP} AND epoch_ms(ts) <= {end}"
    assert sql.sql(f"SELECT count(*) FROM events WHERE NOT ({inside})").fetchall() == [(0,)]


def test_every_query_has_sql():
    own = {**queries.queries(), **store_queries.queries()}
    assert set(own) == set(queries.oracle_sql()) and len(own) > 90


def test_entry(spark):
    assert set(__spark_entry__.entry(spark).columns) == {"name", "event_type", "user_id", "le", "step", "value"}


def plain(f, points, e, r):
    w = [(t, v) for t, v in points if e - r < t <= e]
    if not w:
        return None
    values = [v for _, v in w]
    if f == "sum_over_time":
        return math.fsum(values)
    if f == "changes":
        return float(sum(a != b for a, b in zip(values, values[1:], strict=False)))
    if f == "last_over_time":
        return values[-1]
    if len(w) < 2:
        return None
    if f == "idelta":
        return values[-1] - values[-2]
    d = values[-1] - values[0] + sum(a for a, b in zip(values, values[1:], strict=False) if b < a)
    span, head, tail = (w[-1][0] - w[0][0]) / 1000, (w[0][0] - e + r) / 1000, (e - w[-1][0]) / 1000
    apart = span / (len(w) - 1)
    if d > 0 and values[0] >= 0:
        head = min(head, span * values[0] / d)
    return d * (span + (head if head < 1.1 * apart else apart / 2) + (tail if tail < 1.1 * apart else apart / 2)) / span


@pytest.mark.parametrize(("step", "r"), [(60_000, 60_000), (60_000, 150_000), (60_000, 25_000), (7_000, 61_000)])
def test_random_series(spark, step, r):
    rng = random.Random(step + r)
    series = {}
    for i in range(4):
        times = sorted(rng.sample(range(0, 600_000, 1000 if i else 10), 60))
        series[str(i)] = [(t, float(rng.choice([rng.randint(0, 9), 100]))) for t in times]
    rows = [({"__name__": "s", "i": i}, t, v) for i, points in series.items() for t, v in points]
    engine = Engine(Source.of(spark.createDataFrame(rows, "labels map<string,string>, ts long, value double")))
    for f in ("sum_over_time", "changes", "last_over_time", "idelta", "increase"):
        got = {(x.labels["i"], x.step): x.value for x in engine.table(f"{f}(s[{r // 1000}s])", 30_000, 600_000, step).collect()}
        want = {(i, e): plain(f, points, e, r) for i, points in series.items() for e in range(30_000, 600_001, step)}
        want = {k: v for k, v in want.items() if v is not None}
        assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items()), f
