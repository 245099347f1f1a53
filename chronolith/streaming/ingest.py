"""Ingest by Structured Streaming: scraped texts become samples in a store.

There is no watermark on purpose: a sample may be as late as it likes, the last
write wins, and retention alone decides what is too old. A batch is committed to
the store before its offsets are, and repeating one changes nothing, so the
checkpoint plays the part of a recovery log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.exposition import build_samples, health_samples, read_exposition
from ..sources.store import MetricStore

#: A scrape: where from, when, how it went, and its text.
SCRAPE = "job string, instance string, ts long, up boolean, duration_seconds double, text string"


def samples_of(scrapes: DataFrame) -> DataFrame:
    """(labels, ts, value) of scrapes, with the three health samples of each; a failed one has these alone."""
    good = scrapes.where("up").select("job", "instance", F.col("ts").alias("scrape_ms"), "text")
    parsed = build_samples(read_exposition(good), F.col("job"), F.col("instance"), F.col("scrape_ms"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~F.trim(x).rlike(r"^(#|$)"))
    health = health_samples(scrapes.withColumn("samples", F.when(F.col("up"), F.size(lines)).otherwise(0)))
    return parsed.unionByName(health)


def ingest_stream(scrapes: DataFrame, store: MetricStore, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Runs until stopped, every ``interval`` (or, without one, until what is there has been read)."""

    def write(batch: DataFrame, _: int) -> None:
        store.ingest(samples_of(batch))

    writer = scrapes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def scrape_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of scrapes from JSON files that appear in a folder."""
    return spark.readStream.schema(SCRAPE).json(folder)


def window_counts(samples: DataFrame, range_ms: int, step_ms: int, late_ms: int | None = None) -> DataFrame:
    """Running sums and counts of each series over windows (s, e] of a stream of (labels_key, ts, value).

    With ``late_ms`` a window's state goes once samples are so far beyond its end, and later ones for it don't count;
    without it nothing is too late, and the state of all windows is kept.
    """
    rows = samples.withColumn("at", F.timestamp_millis(F.col("ts") - 1))  # windows of Spark hold their start and not their end; those here the reverse
    if late_ms is not None:
        rows = rows.withWatermark("at", f"{late_ms} milliseconds")
    window = F.window("at", f"{range_ms} milliseconds", f"{step_ms} milliseconds")
    sums = rows.groupBy("labels_key", window).agg(F.sum("value").alias("sum"), F.count("value").alias("count"))
    return sums.select("labels_key", F.unix_millis("window.end").alias("step"), "sum", "count")


def summarize_health(statuses: DataFrame, now_ms: int) -> DataFrame:
    """One row of totals from (up, last_scrape_ms, last_error, interval_seconds) of each target."""
    stale = (now_ms - F.col("last_scrape_ms")) > F.greatest(F.col("interval_seconds") * 3000, F.lit(30_000))
    failed = F.when(~F.col("up") & F.col("last_error").isNotNull(), F.struct(F.coalesce("last_scrape_ms", F.lit(0)).alias("ms"), "last_error"))
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    return statuses.agg(
        F.count(F.lit(1)).alias("targets"),
        count(F.col("up")).alias("up"),
        count(~F.col("up")).alias("down"),
        count(F.col("last_scrape_ms").isNull()).alias("pending"),
        count(stale).alias("stale"),
        F.max("last_scrape_ms").alias("last_scrape_ms"),
        F.max(failed)["last_error"].alias("last_error"),
    )
