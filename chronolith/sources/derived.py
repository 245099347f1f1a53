"""Series derived from the ``events`` table, so that every operator has data.

Running counts are made of counts per hour and places within the hour, so that
no task has to order all events of a type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.syntax import NAME
from ..plans.values import Source

HOUR_MS = 3_600_000
BOUNDS = ("1", "5", "10", "50", "100", "+Inf")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, t in rounded milliseconds, user_id, event_type, value)."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) + 500) / 1000).cast("long")
    return rows.select("event_id", t.alias("t"), F.col("user_id").cast("string").alias("user_id"), "event_type", "value")


def _sid(name: str, keys: list[str]) -> Column:
    return F.xxhash64(F.lit(name), *keys).alias("sid")


def _samples(rows: DataFrame, name: str, keys: list[str], value: Column) -> DataFrame:
    """(sid, ts, value) with the last event of a series and millisecond."""
    once = rows.select(*keys, F.col("t").alias("ts"), value.cast("double").alias("value"), "event_id").groupBy(*keys, "ts").agg(F.max_by("value", "event_id").alias("value"))
    return once.select(_sid(name, keys), "ts", "value")


def _series(rows: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(sid, labels) from the distinct keys alone: values and windows aren't computed for it."""
    pairs = [F.lit(NAME), F.lit(name)] + [x for k in keys for x in (F.lit(k), F.col(k))]
    return rows.select(*keys).distinct().select(_sid(name, keys), F.create_map(*pairs).alias("labels"))


def _running(rows: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """``n``: the running total of ``amount`` in order of time and event id."""
    rows = rows.withColumns({"h": F.floor(F.col("t") / HOUR_MS), "x": amount})
    before = F.sum("s").over(Window.partitionBy(*keys).orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    hours = rows.groupBy(*keys, "h").agg(F.sum("x").alias("s")).withColumn("before", F.coalesce(before, F.lit(0)))
    inner = F.sum("x").over(Window.partitionBy(*keys, "h").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("inner", inner).join(hours, [*keys, "h"]).withColumn("n", F.col("before") + F.col("inner"))


BY_TYPE = ["event_type"]


def source(spark: SparkSession, sf_dir: str, names: frozenset[str]) -> Source:
    """The named metrics."""
    rows = events(spark, sf_dir)
    wide = rows.withColumn("le", F.explode(F.array(*[F.lit(b) for b in BOUNDS])))
    hours = rows.withColumn("t", F.ceil(F.col("t") / HOUR_MS) * HOUR_MS).groupBy("event_type", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.lit(0).alias("event_id"))
    counted = _running(rows, BY_TYPE, F.lit(1))
    fits = F.when(F.col("le") == "+Inf", 1).otherwise((F.col("value") <= F.expr("try_cast(le as double)")).cast("int"))
    # name: rows with values, the value, rows with the keys, the keys
    metrics = {
        "events_value": (rows, F.col("value"), rows, BY_TYPE),
        "events_user_value": (rows, F.col("value"), rows, ["event_type", "user_id"]),
        "events_total": (counted, F.col("n"), rows, BY_TYPE),
        "events_cycle": (counted, F.col("n") % 50, rows, BY_TYPE),
        "events_bucket": (_running(wide, ["event_type", "le"], fits), F.col("n"), wide, ["event_type", "le"]),
        "hourly_count": (hours, F.col("n"), rows, BY_TYPE),
        "hourly_sum": (hours, F.col("s"), rows, BY_TYPE),
    }
    chosen = [(name, *metrics[name]) for name in sorted(names)]
    samples = reduce(DataFrame.unionByName, [_samples(r, name, keys, value) for name, r, value, _, keys in chosen])
    series = reduce(DataFrame.unionByName, [_series(r, name, keys) for name, _, _, r, keys in chosen])
    return Source(series, samples)
