"""Aggregations over series, by or without labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import interpolated, present
from ..plans.syntax import Aggregate, QueryError
from ..plans.values import Scalar, Vector, canonical, except_for, only

SIMPLE = {
    "sum": lambda: F.sum("value"),
    "avg": lambda: F.avg("value"),
    "min": lambda: F.min("value"),
    "max": lambda: F.max("value"),
    "count": lambda: F.count("value").cast("double"),
    "stddev": lambda: F.stddev_pop("value"),
    "stdvar": lambda: F.var_pop("value"),
}


def _grouped(v: Vector, tree: Aggregate) -> tuple[DataFrame, DataFrame]:
    """Numbers with the group's key as g, and the groups ``(g, labels)``. One group for all needs no labels at all."""
    spark = v.data.sparkSession
    if not tree.without and not tree.labels:
        one = spark.range(1).select(F.lit("{}").alias("g"), F.create_map().cast("map<string,string>").alias("labels"))
        return v.data.withColumn("g", F.lit("{}")), one
    kept = (except_for if tree.without else only)(F.col("labels"), tree.labels)
    keyed = v.series.select("sid", kept.alias("labels")).withColumn("g", canonical(F.col("labels")))
    return v.data.join(keyed.select("sid", "g"), "sid"), keyed.groupBy("g").agg(F.first("labels").alias("labels"))


def aggregate(v: Vector, tree: Aggregate, param: Scalar | None) -> Vector:
    if tree.op in ("topk", "bottomk"):
        return _ranked(v, tree, param)
    data, groups = _grouped(v, tree)
    if tree.op == "quantile":
        # Values of a group and step are one for each of its series. A literal between 0 and 1 needs only their counts.
        if param.constant is not None and 0 <= param.constant <= 1:
            rows = data.groupBy("g", "k").agg(F.percentile("value", F.lit(param.constant)).alias("value"))
        else:
            rows = data.groupBy("g", "k").agg(F.array_sort(F.collect_list("value")).alias("all"))
            rows = param.beside(rows, "phi").select("g", "k", interpolated(F.col("all"), F.col("phi")).alias("value"))
    elif tree.op in SIMPLE:
        rows = data.groupBy("g", "k").agg(SIMPLE[tree.op]().alias("value"))
    else:
        raise QueryError(f'unsupported aggregation "{tree.op}"')
    rows = rows.select(F.col("g").alias("sid"), "k", "value").where(present(F.col("value")))
    return Vector(rows, groups.select(F.col("g").alias("sid"), "labels"))


def _ranked(v: Vector, tree: Aggregate, param: Scalar) -> Vector:
    """The first or last few of each group and step, with their own labels; ties in the order of their labels."""
    data, _ = _grouped(v, tree)
    data = data.join(v.series.select("sid", canonical(F.col("labels")).alias("name")), "sid")
    order: Column = F.desc("value") if tree.op == "topk" else F.asc("value")
    rank = F.row_number().over(Window.partitionBy("g", "k").orderBy(order, "name", "sid"))
    if param.constant is not None:  # a literal limit lets each task drop rows before the shuffle
        x = param.constant
        data = data.withColumn("rank", rank).where(F.col("rank") <= (0 if x != x else int(max(min(x, 2**31 - 1), 0))))
    else:
        data = param.beside(data.withColumn("rank", rank), "most").where(~F.isnan("most") & (F.col("rank").cast("double") <= F.col("most")))
    return Vector(data.select("sid", "k", "value"), v.series)

