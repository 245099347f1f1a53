"""Registered queries of the time-series operators, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .plans.twin import SAMPLES, Twin
from .sources import derived

Query = Callable[[SparkSession, str], DataFrame]
#: Queries have a step of six hours, from the step at or before the first event to that at or after the last.
STEP = 21_600_000
#: Start, step and number of steps, in SQL.
GRID = (
    f"(SELECT epoch_ms(min(ts)) // {STEP} * {STEP} FROM events)",
    STEP,
    f"(SELECT (epoch_ms(max(ts)) + {STEP - 1}) // {STEP} - epoch_ms(min(ts)) // {STEP} + 1 FROM events)",
)

PROMQL = {
    "f1_equal": 'events_value{event_type="click"}',
    "f2_not_equal": 'events_value{event_type!="click"}',
    "f3_pattern": 'events_value{event_type=~"c.*|p.*"}',
    "f4_not_pattern": 'events_value{event_type!~"c.*", user_id=""}',
    "f5_conjunction": 'events_user_value{event_type=~".*e.*", user_id!="8", user_id=~"[0-9]+"}',
    "i1_instant": "events_value",
    "i2_range_gaps": "count_over_time(events_value[5h])",
    "i2_range_overlap": "sum_over_time(events_value[13h])",
    "i4_offset": "events_value offset 90m",
    "i4_range_offset": "max_over_time(events_value[7h] offset 2h)",
    "p2_by": "sum by (event_type) (events_user_value)",
    "p3_without": "sum without (user_id) (events_user_value)",
    "p4_negative": "-events_value",
    "b1_add": "events_value + 1.5",
    "b2_subtract": "100 - events_value",
    "b3_multiply": "events_value * events_value",
    "b4_divide": "hourly_sum / hourly_count",
    "b5_remainder": "events_value % 7",
    "b6_power": "events_value ^ 0.5",
    "b7_equal": "hourly_count == 2",
    "b8_not_equal": "hourly_count != 2",
    "b9_greater": "events_value > 20",
    "b10_less_bool": "events_value < bool 20",
    "b11_greater_equal": "hourly_sum >= hourly_count",
    "b12_less_equal_bool": "hourly_sum <= bool hourly_count",
    "b13_scalars": "1 + 2 * 3 ^ 2 > bool 18",
    "b14_scalar_left": "20 > events_value",
    "b15_on": "hourly_sum / on (event_type) hourly_count",
    "b15_ignoring": "hourly_sum - ignoring (user_id) hourly_count",
    "b16_and": "hourly_count and events_value",
    "b17_unless": "hourly_count unless events_value > 15",
    "b18_or": "events_value > 15 or hourly_count",
    "a1_sum": "sum(events_value)",
    "a2_avg": "avg(events_user_value)",
    "a3_min": "min by (event_type) (events_user_value)",
    "a4_max": "max by (event_type) (events_user_value)",
    "a5_count": "count by (event_type) (events_user_value)",
    "a6_stddev": "stddev(events_user_value)",
    "a7_stdvar": "stdvar by (event_type) (events_user_value)",
    "a8_quantile": "quantile(0.3, events_user_value)",
    "a9_topk": "topk(2, sum_over_time(events_user_value[12h]))",
    "a10_bottomk": "bottomk by (event_type) (1, sum_over_time(events_user_value[12h]))",
    "w1_rate": "rate(events_total[8h])",
    "w1_rate_resets": "rate(events_cycle[30h])",
    "w2_increase": "increase(events_cycle[12h])",
    "w3_delta": "delta(events_value[12h])",
    "w4_irate": "irate(events_cycle[9h])",
    "w5_idelta": "idelta(events_value[6h])",
    "w6_sum_over_time": "sum_over_time(events_value[6h])",
    "w7_avg_over_time": "avg_over_time(events_value[11h])",
    "w8_min_over_time": "min_over_time(events_value[12h])",
    "w9_max_over_time": "max_over_time(events_value[12h])",
    "w10_count_over_time": "count_over_time(events_value[12h])",
    "w11_last_over_time": "last_over_time(events_value[12h])",
    "w12_present_over_time": "present_over_time(events_value[1h])",
    "w13_stddev_over_time": "stddev_over_time(events_value[12h])",
    "w14_stdvar_over_time": "stdvar_over_time(events_value[10h])",
    "w15_changes": "changes(hourly_count[20h])",
    "w16_resets": "resets(events_cycle[2d])",
    "w17_quantile_over_time": "quantile_over_time(0.9, events_value[12h])",
    "m1_abs": "abs(events_value - 15)",
    "m2_ceil": "ceil(events_value)",
    "m3_floor": "floor(0 - events_value)",
    "m4_sqrt": "sqrt(events_value - 10)",
    "m5_exp": "exp(events_value / 100)",
    "m6_ln": "ln(events_value)",
    "m7_log2": "log2(events_value)",
    "m8_log10": "log10(hourly_count - 1)",
    "m9_sgn": "sgn(events_value - 15)",
    "m10_round": "round(events_value - 20, 5)",
    "m11_clamp": "clamp(events_value, 10, 20)",
    "m12_clamp_min": "clamp_min(events_value, 15)",
    "m13_clamp_max": "clamp_max(events_value, 15)",
    "m14_histogram_quantile": "histogram_quantile(0.8, rate(events_bucket[2d]))",
    "m15_scalar": 'events_value * scalar(hourly_count{event_type="click"})',
    "m16_vector": "vector(time() / 60)",
    "m17_time": "time() - 1700000000",
    "m18_absent": 'absent(events_value{event_type="click"})',
    "o1_sort": "sort(events_value)",
    "q1_rate_by_type": "sum by (event_type) (rate(events_total[2h]))",
    "q2_share": "100 * increase(events_total[1d]) / on (event_type) increase(events_total[2d])",
}


def metrics_of(query: str) -> tuple[str, ...]:
    return tuple(m for m in SAMPLES if re.search(rf"\b{m}\b", query))


def whole_range(spark: SparkSession, sf_dir: str) -> tuple[int, int] | None:
    """First and last step of the grid that has every event in a window of a step; None without events."""
    first, last = derived.events(spark, sf_dir).agg(F.min("t"), F.max("t")).first()
    return None if first is None else (first // STEP * STEP, -(-last // STEP) * STEP)


def promql(query: str) -> Query:
    """The query over the whole table, from its first event to its last, with a lookback of a step."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = whole_range(spark, sf_dir)
        start, end = found or (0, 0)
        names = frozenset(metrics_of(query)) or frozenset(["hourly_count"])
        rows = Engine(derived.source(spark, sf_dir, names), STEP).table(query, start, end, STEP)
        columns = [F.col("labels")["__name__" if c == "name" else c].alias(c) for c in ("name", "event_type", "user_id", "le")]
        rows = rows.select(*columns, "step", F.round("value", 6).alias("value"))
        return rows if found else rows.where(F.lit(False))

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promql(PROMQL["q1_rate_by_type"])(spark, sf_dir)


def queries() -> dict[str, Query]:
    from . import store_queries

    return {name: promql(query) for name, query in PROMQL.items()} | store_queries.queries()


def oracle_sql() -> dict[str, str]:
    from . import store_queries

    twin = Twin(*GRID, STEP)
    return {name: twin.query(query, metrics_of(query)) for name, query in PROMQL.items()} | store_queries.oracle_sql()
