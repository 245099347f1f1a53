"""A recovery log: a folder for each append, numbered upwards, of JSON lines with samples.

A line is ``{"line": n, "samples": [{labels, ts, value}, …]}``; a plain array of
samples, as other writers leave it, is read too. Order is that of (append, line,
place in the line), whatever the sizes of files. An append becomes visible when
Spark commits its job; a failed one leaves a number unused.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import MetricStore

SAMPLES = "array<struct<labels:map<string,string>,ts:double,value:double>>"
LINE = f"line long, samples {SAMPLES}"
_NUMBER = re.compile(r"\d{12}")


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the appends that are there; 0 stands for files outside the numbered folders."""
    fs, place = _folder(spark, path)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    plain = any(not _NUMBER.fullmatch(n) and not n.startswith(("_", ".")) for n in names)
    return [0] * plain + sorted(int(n) for n in names if _NUMBER.fullmatch(n))


def epoch(spark: SparkSession, path: str) -> int:
    """The number of the last append; 0 without any."""
    return max(batches(spark, path), default=0)


def append(samples: DataFrame, path: str, per_line: int = 1000) -> int:
    """Appends (labels, ts, value) in lines of bounded length, in the order of the rows; its number."""
    number = epoch(samples.sparkSession, path) + 1
    place = F.monotonically_increasing_id()
    numbered = samples.select(F.struct(place.alias("n"), "labels", F.col("ts").cast("double").alias("ts"), "value").alias("s"), F.floor(place / per_line).alias("line"))
    lines = numbered.groupBy("line").agg(F.array_sort(F.collect_list("s"), lambda a, b: F.when(a["n"] < b["n"], -1).otherwise(1)).alias("s"))
    each = F.transform("s", lambda x: F.struct(x["labels"].alias("labels"), x["ts"].alias("ts"), x["value"].alias("value")))
    lines.select(F.to_json(F.struct("line", each.alias("samples"))).alias("value")).write.text(f"{path}/{number:012d}")
    return number


def read(spark: SparkSession, path: str, numbers: list[int] | None = None) -> DataFrame:
    """(labels, ts, value, place) of all lines that can be read, or of some appends; torn lines are left out. ``place`` is in the order of writing."""
    numbers = batches(spark, path) if numbers is None else numbers
    if not numbers:
        return spark.createDataFrame([], "labels map<string,string>, ts double, value double, place struct<batch:long,line:long,at:long,i:int>")
    folders = [f"{path}/{n:012d}" for n in numbers if n]
    text = spark.read.text(folders) if folders else None
    if 0 in numbers:
        plain = spark.read.text(path)  # files of the folder itself
        text = plain if text is None else plain.select("value", "_metadata").unionByName(text.select("value", "_metadata"))
    batch = F.coalesce(F.nullif(F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{12})/[^/]+$", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    lines = text.select(batch.alias("batch"), F.monotonically_increasing_id().alias("at"), "value")
    own = F.from_json("value", LINE, {"mode": "PERMISSIVE"})
    other = F.from_json("value", SAMPLES, {"mode": "PERMISSIVE"})
    parsed = lines.withColumns({"own": own, "other": F.when(F.ltrim("value").startswith("["), other)})
    rows = parsed.select("batch", "at", F.col("own.line").alias("line"), F.posexplode(F.coalesce("own.samples", "other")).alias("i", "s")).where("s.labels is not null")
    return rows.select("s.labels", "s.ts", "s.value", F.struct("batch", F.coalesce("line", F.lit(0).cast("long")).alias("line"), "at", "i").alias("place"))


def replay(spark: SparkSession, path: str, store: MetricStore, should_continue: Callable[[], bool] = lambda: True, at_once: int = 25) -> dict:
    """Ingests the log, some appends at a time, in their order; repeating it changes nothing. May be stopped between them."""
    fs, place = _folder(spark, path)
    numbers = batches(spark, path)
    done = {"samples": 0, "batches": 0, "bytes": fs.getContentSummary(place).getLength() if numbers else 0, "aborted": False}
    for i in range(0, len(numbers), at_once):
        if not should_continue():
            return done | {"aborted": True}
        rows = read(spark, path, numbers[i : i + at_once])
        n = rows.count()
        if n:
            store.ingest(rows, order="place")
        done["samples"] += n
        done["batches"] += len(numbers[i : i + at_once])
    return done


def truncate(spark: SparkSession, path: str, until: int) -> bool:
    """Removes appends up to the epoch ``until``, which the store must hold by then; whether the log is empty now. Later appends stay."""
    fs, place = _folder(spark, path)
    for n in batches(spark, path):
        if 0 < n <= until:
            fs.delete(place.suffix(f"/{n:012d}"), True)
        elif not n:
            for s in fs.listStatus(place):
                if s.isFile():
                    fs.delete(s.getPath(), False)
    return not batches(spark, path)


def at_start(spark: SparkSession, path: str, store: MetricStore, should_continue: Callable[[], bool] = lambda: True) -> dict:
    """What to do with a log that is found: it is only replayed into a store that lost something, and then cleared."""
    last = epoch(spark, path)
    if not store.recovered:
        truncate(spark, path, last)
        return {"mode": "checkpoint", "samples": 0, "batches": 0, "bytes": 0, "aborted": False}
    found = replay(spark, path, store, should_continue)
    if not found["aborted"]:
        truncate(spark, path, last)
    return {"mode": "replay", **found}
