"""Binary operators between vectors: one-to-one arithmetic and comparisons, and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ARITHMETIC, compare
from ..plans.syntax import COMPARISONS, Binary, Matching, QueryError
from ..plans.values import Vector, canonical, except_for, only


def signature(labels: Column, matching: Matching | None) -> Column:
    matching = matching or Matching()
    return canonical(only(labels, matching.labels) if matching.on else except_for(labels, matching.labels))


def _signed(v: Vector, matching: Matching | None) -> DataFrame:
    return v.series.select("sid", signature(F.col("labels"), matching).alias("sig"))


def _check_unique(v: Vector, signed: DataFrame, side: str) -> None:
    """At most one series of a signature has values. The numbers are only read if labels leave it open."""
    doubtful = signed.groupBy("sig").count().where("count > 1").select("sig")
    if doubtful.limit(1).isEmpty():
        return
    live = v.data.join(signed.join(doubtful, "sig", "left_semi"), "sid").groupBy("sig").agg(F.min("sid").alias("a"), F.max("sid").alias("b"))
    if not live.where("a <> b").limit(1).isEmpty():
        raise QueryError(f"many-to-many matching not allowed: multiple matches on the {side} side")


def one_to_one(left: Vector, right: Vector, tree: Binary) -> Vector:
    l, r = _signed(left, tree.matching), _signed(right, tree.matching)  # noqa: E741
    _check_unique(right, r, "right")
    _check_unique(left, l, "left")
    a = left.data.join(l, "sid").select("sid", "k", "sig", F.col("value").alias("a"))
    b = right.data.join(r, "sid").select("k", "sig", F.col("value").alias("b"))
    rows = a.join(b, ["sig", "k"])
    return Vector(rows, left.series).mapped(*_result(tree, F.col("a"), F.col("b"), F.col("a")))


def _result(tree: Binary, a: Column, b: Column, kept: Column) -> tuple[Column, bool]:
    """The new value (null: no row), and whether the name stays."""
    if tree.op not in COMPARISONS:
        return ARITHMETIC[tree.op](a, b), False
    holds = compare(tree.op, a, b)
    if tree.as_bool:
        return F.when(holds, F.lit(1.0)).otherwise(F.lit(0.0)), False
    return F.when(holds, kept), True


def with_scalar(rows: DataFrame, v: Vector, tree: Binary, scalar: str, scalar_left: bool) -> Vector:
    """``rows``: the vector's numbers with the scalar beside them. A comparison keeps the vector's value."""
    a, b = (F.col(scalar), F.col("value")) if scalar_left else (F.col("value"), F.col(scalar))
    return Vector(rows, v.series).mapped(*_result(tree, a, b, F.col("value")))


def set_operation(left: Vector, right: Vector, tree: Binary) -> Vector:
    a = left.data.join(_signed(left, tree.matching), "sid")
    b = right.data.join(_signed(right, tree.matching), "sid")
    if tree.op in ("and", "unless"):
        how = "left_semi" if tree.op == "and" else "left_anti"
        return Vector(a.join(b.select("sig", "k"), ["sig", "k"], how).select("sid", "k", "value"), left.series)
    rest = b.join(a.select("sig", "k"), ["sig", "k"], "left_anti")

    def renamed(df: DataFrame, side: str) -> DataFrame:
        return df.withColumn("sid", F.concat(F.lit(f"{side}:"), F.col("sid").cast("string")))

    data = renamed(a.select("sid", "k", "value"), "l").unionByName(renamed(rest.select("sid", "k", "value"), "r"))
    return Vector(data, renamed(left.series, "l").unionByName(renamed(right.series, "r")))


__all__ = ["one_to_one", "set_operation", "signature", "with_scalar"]
