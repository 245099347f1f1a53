"""Instant and range selectors.

Samples are first combined in buckets of time, with partial aggregation before
the shuffle, so that what follows sees at most one row for each series and
bucket whatever the sampling rate, and a series with very many samples is
spread over its buckets. Windows over a series then have as many rows as the
query has buckets. No range join is needed: each bucket knows the steps it belongs to.

Functions of successive samples fold runs of a series in the map tasks (first, last,
losses at resets, numbers of changes) where the source keeps samples in order, as the
store does; from other sources samples are put in order first, with one shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import interpolated
from ..plans.syntax import Selector
from ..plans.values import Grid, Scalar, Source, Vector


def _ceil(numerator: Column, by: int) -> Column:
    return F.ceil(numerator.cast("double") / F.lit(float(by)))


def instant(source: Source, selector: Selector, grid: Grid, lookback: int) -> Vector:
    """At each step the latest sample that is younger than ``lookback``."""
    o = selector.offset_ms
    series, samples = source.select(selector.matchers, grid.start - o - lookback, grid.end - o)
    k = F.greatest(F.lit(0).cast("long"), _ceil(F.col("ts") + (o - grid.start), grid.step))
    last = samples.groupBy("sid", k.alias("b")).agg(F.max("ts").alias("t"), F.max_by("value", "ts").alias("value"))
    following = F.lead("b").over(Window.partitionBy("sid").orderBy("b"))
    fresh = _ceil(F.col("t") + (lookback + o - grid.start), grid.step) - 1
    until = F.least(F.coalesce(following, F.lit(grid.n)) - 1, fresh, F.lit(grid.n - 1).cast("long"))
    spread = last.withColumn("until", until).where("b <= until").select("sid", F.explode(F.sequence("b", "until")).alias("k"), "value")
    return Vector(spread, series)


class Windows:
    """The windows (e - o - r, e - o] of a range selector, as runs of buckets."""

    def __init__(self, source: Source, selector: Selector, grid: Grid):
        self.grid, self.range, self.offset = grid, selector.range_ms, selector.offset_ms
        step = grid.step if grid.n > 1 else self.range
        self.width = gcd(self.range, step)
        self.each, self.stride = self.range // self.width, step // self.width
        self.series, samples = source.select(selector.matchers, grid.start - self.offset - self.range, grid.end - self.offset)
        b = _ceil(F.col("ts") + (self.offset - grid.start), self.width).alias("b")
        self.samples, self.in_order = samples.select("sid", "ts", "value", b), source.in_order
        if self.stride > self.each:  # windows leave gaps
            self.samples = self.samples.where(self._first() <= self._last())

    def _first(self) -> Column:
        return F.greatest(F.lit(0).cast("long"), _ceil(F.col("b"), self.stride))

    def _last(self) -> Column:
        return F.least(F.lit(self.grid.n - 1).cast("long"), _ceil(F.col("b") + self.each, self.stride) - 1)

    def spread(self, rows: DataFrame) -> DataFrame:
        """A copy for each window that the bucket ``b`` lies in."""
        return rows.where(self._first() <= self._last()).withColumn("k", F.explode(F.sequence(self._first(), self._last())))

    def begin(self) -> Column:
        """The last bucket before the window."""
        return F.col("k") * self.stride - self.each

    def combined(self, parts: dict[str, Column], merge: dict[str, Column]) -> DataFrame:
        """Aggregates of buckets, merged for each window."""
        return self.spread(self.samples.groupBy("sid", "b").agg(*[c.alias(n) for n, c in parts.items()])).groupBy("sid", "k").agg(*[c.alias(n) for n, c in merge.items()])

    def vector(self, rows: DataFrame, value: Column) -> Vector:
        return Vector(rows, self.series).mapped(value)


def _sum(w: Windows) -> Vector:
    return w.vector(w.combined({"x": F.sum("value")}, {"x": F.sum("x")}), F.col("x"))


def _average(w: Windows) -> Vector:
    rows = w.combined({"x": F.sum("value"), "n": F.count("value")}, {"x": F.sum("x"), "n": F.sum("n")})
    return w.vector(rows, F.col("x") / F.col("n"))


def _least(w: Windows) -> Vector:
    return w.vector(w.combined({"x": F.min("value")}, {"x": F.min("x")}), F.col("x"))


def _most(w: Windows) -> Vector:
    return w.vector(w.combined({"x": F.max("value")}, {"x": F.max("x")}), F.col("x"))


def _count(w: Windows) -> Vector:
    return w.vector(w.combined({"n": F.count("value")}, {"n": F.sum("n")}), F.col("n").cast("double"))


def _present(w: Windows) -> Vector:
    return w.vector(w.combined({"n": F.count("value")}, {"n": F.sum("n")}), F.lit(1.0))


def _last_value(w: Windows) -> Vector:
    return w.vector(w.combined({"x": F.max_by("value", "ts")}, {"x": F.max_by("x", "b")}), F.col("x"))


def _variance(w: Windows) -> tuple[DataFrame, Column]:
    """Buckets have count, mean and the sum of squares about it, which merge without losing digits: what the means add is taken about the window's own."""
    n, total = F.count("value").cast("double"), F.var_pop("value") * F.count("value")
    rows = w.combined({"n": n, "mean": F.avg("value"), "m2": total}, {"n": F.sum("n"), "m2": F.sum("m2"), "parts": F.collect_list(F.struct("n", "mean"))})
    mean = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["n"] * x["mean"]) / F.col("n")
    rows = rows.withColumn("mean", mean)
    between = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean")))
    return rows, (F.col("m2") + between) / F.col("n")


def _stdvar(w: Windows) -> Vector:
    return w.vector(*_variance(w))


def _stddev(w: Windows) -> Vector:
    rows, variance = _variance(w)
    return w.vector(rows, F.sqrt(variance))


#: Rows that a task folds at once.
_FOLDED = 1 << 18
_PIECE = [("n", T.LongType()), ("ft", T.LongType()), ("fv", T.DoubleType()), ("lt", T.LongType()), ("lv", T.DoubleType()), ("pt", T.LongType()), ("pv", T.DoubleType()), ("lost", T.DoubleType()), ("resets", T.LongType()), ("changes", T.LongType())]


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of (sid, ts, value, b) with one series and bucket and rising times."""

    def folded(table: pa.Table) -> pa.RecordBatch:
        sid, ts, value, b = (c.combine_chunks() for c in table.columns)
        t, v, at = (c.to_numpy(zero_copy_only=False) for c in (ts, value, b))
        new = np.ones(len(t), bool)
        new[1:] = pc.not_equal(sid[1:], sid[:-1]).to_numpy(zero_copy_only=False) | (at[1:] != at[:-1]) | (t[1:] <= t[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(t)) - 1
        inner = ~new[1:]
        falls, differs = np.append(False, inner & (v[1:] < v[:-1])), np.append(False, inner & (v[1:] != v[:-1]))
        lost = np.where(falls, np.append(0.0, v[:-1]), 0.0)
        single = last == first
        before = np.maximum(last - 1, 0)
        columns = [last - first + 1, t[first], v[first], t[last], v[last], pa.array(t[before], mask=single), pa.array(v[before], mask=single), np.add.reduceat(lost, first), np.add.reduceat(falls.astype(np.int64), first), np.add.reduceat(differs.astype(np.int64), first)]
        return pa.RecordBatch.from_arrays([sid.take(pa.array(first)), pa.array(at[first]), *[pa.array(c) for c in columns]], names=["sid", "b", *[n for n, _ in _PIECE]])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= _FOLDED:
            yield folded(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield folded(pa.Table.from_batches(held))


def _pieces(w: Windows) -> DataFrame:
    rows = w.samples if w.in_order else w.samples.repartition("sid", "b").sortWithinPartitions("sid", "b", "ts")
    return rows.mapInArrow(_fold, T.StructType([rows.schema["sid"], T.StructField("b", T.LongType()), *[T.StructField(*f) for f in _PIECE]]))


def _ordered(w: Windows) -> DataFrame:
    """What functions of successive samples need, for each window.

    A piece sees the one before it in its bucket; a bucket sees the bucket before,
    which counts where that still lies in the window.
    """
    inner = Window.partitionBy("sid", "b").orderBy("ft")
    rows = _pieces(w).withColumns({"qt": F.lag("lt").over(inner), "qv": F.lag("lv").over(inner)})
    falls, differs = F.col("fv") < F.col("qv"), F.col("fv") != F.col("qv")
    previous = F.when(F.col("n") > 1, F.struct("pt", "pv")).when(F.col("qt").isNotNull(), F.struct(F.col("qt").alias("pt"), F.col("qv").alias("pv")))
    buckets = rows.groupBy("sid", "b").agg(
        F.sum("n").alias("n"),
        F.min("ft").alias("ft"),
        F.min_by("fv", "ft").alias("fv"),
        F.max("lt").alias("lt"),
        F.max_by("lv", "lt").alias("lv"),
        F.max_by(F.struct(previous.alias("x")), "lt")["x"].alias("before"),
        F.sum(F.col("lost") + F.when(falls, F.col("qv")).otherwise(0.0)).alias("lost"),
        F.sum(F.col("resets") + F.when(falls, 1).otherwise(0)).alias("resets"),
        F.sum(F.col("changes") + F.when(differs, 1).otherwise(0)).alias("changes"),
    )
    outer = Window.partitionBy("sid").orderBy("b")
    buckets = buckets.withColumns({"pb": F.lag("b").over(outer), "plt": F.lag("lt").over(outer), "plv": F.lag("lv").over(outer)})
    inside = F.coalesce(F.col("pb") > w.begin(), F.lit(False))
    falls, differs = inside & (F.col("fv") < F.col("plv")), inside & (F.col("fv") != F.col("plv"))
    previous = F.when(F.col("n") > 1, F.col("before")).when(inside, F.struct(F.col("plt").alias("pt"), F.col("plv").alias("pv")))
    return w.spread(buckets).groupBy("sid", "k").agg(
        F.sum("n").alias("n"),
        F.min("ft").alias("ft"),
        F.min_by("fv", "b").alias("fv"),
        F.max("lt").alias("lt"),
        F.max_by("lv", "b").alias("lv"),
        F.max_by(F.struct(previous.alias("x")), "b")["x"].alias("before"),
        F.sum(F.col("lost") + F.when(falls, F.col("plv")).otherwise(0.0)).alias("lost"),
        F.sum(F.col("resets") + falls.cast("int")).alias("resets"),
        F.sum(F.col("changes") + differs.cast("int")).alias("changes"),
    )


def _extrapolated(counter: bool, per_second: bool):
    """The change over a window, carried on to its ends unless they are far from the samples."""

    def run(w: Windows) -> Vector:
        rows = _ordered(w).where("n > 1")
        end = w.grid.time() - w.offset
        change = F.col("lv") - F.col("fv") + (F.col("lost") if counter else F.lit(0.0))
        rows = rows.select("sid", "k", change.alias("d"), ((F.col("lt") - F.col("ft")) / 1000.0).alias("span"), "n", "fv", ((F.col("ft") - end + w.range) / 1000.0).alias("head"), ((end - F.col("lt")) / 1000.0).alias("tail"))
        if counter:  # a counter starts at zero at the earliest
            to_zero = F.col("span") * (F.col("fv") / F.when(F.col("d") > 0, F.col("d")))
            rows = rows.withColumn("head", F.when((F.col("d") > 0) & (F.col("fv") >= 0), F.least("head", to_zero)).otherwise(F.col("head")))
        apart = F.col("span") / (F.col("n") - 1)
        near = lambda gap: F.when(F.col(gap) < apart * 1.1, F.col(gap)).otherwise(apart / 2)
        value = F.col("d") * ((F.col("span") + near("head") + near("tail")) / F.col("span"))
        return w.vector(rows, value / (w.range / 1000.0) if per_second else value)

    return run


def _latest(rate: bool):
    """The change between the last two samples, over the seconds between them for a counter's rate."""

    def run(w: Windows) -> Vector:
        rows = _ordered(w).where("before is not null")
        change = F.col("lv") - F.col("before.pv")
        if rate:
            change = F.when(change < 0, F.col("lv")).otherwise(change) / ((F.col("lt") - F.col("before.pt")) / 1000.0)
        return w.vector(rows, change)

    return run


#: Functions of one range vector.
RANGE = {
    "rate": _extrapolated(True, True),
    "increase": _extrapolated(True, False),
    "delta": _extrapolated(False, False),
    "irate": _latest(True),
    "idelta": _latest(False),
    "sum_over_time": _sum,
    "avg_over_time": _average,
    "min_over_time": _least,
    "max_over_time": _most,
    "count_over_time": _count,
    "last_over_time": _last_value,
    "present_over_time": _present,
    "stddev_over_time": _stddev,
    "stdvar_over_time": _stdvar,
    "changes": lambda w: w.vector(_ordered(w), F.col("changes").cast("double")),
    "resets": lambda w: w.vector(_ordered(w), F.col("resets").cast("double")),
}


def quantile_over_time(w: Windows, phi: Scalar) -> Vector:
    """Of all samples of a window. A literal between 0 and 1 is an aggregate of counted values, combined in the map tasks; others need the sorted samples together."""
    each = w.spread(w.samples).groupBy("sid", "k")
    if phi.constant is not None and 0 <= phi.constant <= 1:
        return w.vector(each.agg(F.percentile("value", F.lit(phi.constant)).alias("x")), F.col("x"))
    rows = each.agg(F.array_sort(F.collect_list("value")).alias("all"))
    return w.vector(phi.beside(rows, "phi"), interpolated(F.col("all"), F.col("phi")))


__all__ = ["RANGE", "Windows", "instant", "quantile_over_time"]
