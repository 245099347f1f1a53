"""What a query is evaluated over: the step grid, sample sources and the kinds of values.

A vector is kept in two planes: numbers, ``(sid, k, value)`` with k the index of
the step, and labels, ``(sid, labels)``, one row a series. Label operations
touch the small plane only; the large one is joined with it where a grouping
needs labels. A step without a sample has no row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import present
from .syntax import NAME, Matcher

LABELS = "map<string,string>"


@dataclass(frozen=True)
class Grid:
    start: int
    step: int
    n: int

    @property
    def end(self) -> int:
        return self.start + (self.n - 1) * self.step

    def steps(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.n).select(F.col("id").alias("k"))

    def time(self, k: str = "k") -> Column:
        return F.col(k) * self.step + self.start


def canonical(labels: Column) -> Column:
    """JSON of the labels with sorted keys: the identity of a series."""
    pairs = F.array_sort(F.map_entries(labels))
    return F.when(F.size(labels) == 0, F.lit("{}")).otherwise(F.to_json(F.map_from_entries(pairs)))


def without_name(labels: Column) -> Column:
    return F.map_filter(labels, lambda k, _: k != NAME)


def only(labels: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(labels, lambda k, _: k.isin(*names) if names else F.lit(False))


def except_for(labels: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(NAME, *names))


def matches(labels: Column, matchers: tuple[Matcher, ...]) -> Column:
    """All matchers hold; a missing label is as good as an empty one, and patterns match the whole value."""
    out = F.lit(True)
    for m in matchers:
        value = F.coalesce(labels[m.name], F.lit(""))
        test = value.rlike(rf"\A(?:{m.value})\z") if m.op.endswith("~") else value == m.value
        out = out & (~test if m.op.startswith("!") else test)
    return out


@dataclass(frozen=True)
class Source:
    """Series ``(sid, labels)`` and samples ``(sid, ts, value)``: one sample for each series and millisecond, no NaN.

    ``in_order``: within a partition a series' samples come by time, and no other
    partition has samples of that series between them; and the ids of all
    series together are few enough to be broadcast.
    """

    series: DataFrame
    samples: DataFrame
    in_order: bool = False

    @staticmethod
    def of(rows: DataFrame) -> Source:
        """From ``(labels, ts, value)``; the series id is 128 bits of a digest of the canonical labels. The last row of a series and time counts."""
        named = rows.where(present(F.col("value"))).select("labels", F.md5(canonical(F.col("labels"))).alias("sid"), F.col("ts").cast("long").alias("ts"), F.col("value").cast("double").alias("value"))
        series = named.groupBy("sid").agg(F.first("labels").alias("labels"))
        return Source(series, named.withColumn("n", F.monotonically_increasing_id()).groupBy("sid", "ts").agg(F.max_by("value", "n").alias("value")))

    def select(self, matchers: tuple[Matcher, ...], after: int | None, until: int | None) -> tuple[DataFrame, DataFrame]:
        """Series that match, and their samples with after < ts <= until. Both tests reach the scan; series ids are a semi join."""
        series = self.series.where(matches(F.col("labels"), matchers))
        samples = self.samples
        if after is not None:
            samples = samples.where(F.col("ts") > after)
        if until is not None:
            samples = samples.where(F.col("ts") <= until)
        ids = series.select("sid")
        return series, samples.join(F.broadcast(ids) if self.in_order else ids, "sid", "left_semi")


@dataclass(frozen=True)
class Vector:
    data: DataFrame
    series: DataFrame

    def mapped(self, value: Column, keep_name: bool = False) -> Vector:
        """A new value for each row; rows that become NaN vanish, and so does the name."""
        data = self.data.select("sid", "k", value.alias("value")).where(present(F.col("value")))
        return Vector(data, self.series) if keep_name else Vector(data, self.series).unnamed()

    def unnamed(self) -> Vector:
        return replace(self, series=self.series.select("sid", without_name(F.col("labels")).alias("labels")))

    def labelled(self) -> DataFrame:
        return self.data.join(self.series, "sid")


@dataclass(frozen=True)
class Scalar:
    """A column over ``k``, or a table ``(k, value)`` of at most one row a step; NaN is kept. ``constant``: the number, where it is a literal."""

    column: Column | None = None
    frame: DataFrame | None = None
    constant: float | None = None

    @staticmethod
    def of(value: float) -> Scalar:
        return Scalar(F.lit(float(value)), None, float(value))

    def table(self, grid: Grid, spark: SparkSession) -> DataFrame:
        if self.frame is not None:
            return self.frame
        return grid.steps(spark).select("k", self.column.cast("double").alias("value"))

    def beside(self, data: DataFrame, name: str) -> DataFrame:
        """``data`` with the scalar of its step; a table is broadcast, having at most as many rows as there are steps."""
        if self.frame is None:
            return data.withColumn(name, self.column.cast("double"))
        return data.join(F.broadcast(self.frame.select("k", F.col("value").alias(name))), "k")


@dataclass(frozen=True)
class String:
    value: str
