"""Quantiles of cumulative histograms, series that differ in the label ``le``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import INF, NAN
from ..plans.values import Scalar, Vector, canonical, except_for


def _bound(le: Column) -> Column:
    text = F.trim(le)
    number = F.when(text == "", F.lit(0.0)).otherwise(F.expr("try_cast(trim(labels['le']) as double)"))
    return F.when(le == "+Inf", F.lit(INF)).when(le == "-Inf", F.lit(-INF)).when(text.rlike("^[+-]?[0-9.]"), number).when(text == "", number)


def histogram_quantile(v: Vector, phi: Scalar) -> Vector:
    """Each group and step gathers its buckets, one for each bound and metric, in an array; all else is arithmetic on it."""
    rest = except_for(F.col("labels"), ("le",))
    named = v.series.select("sid", rest.alias("labels"), _bound(F.col("labels")["le"]).alias("le")).where("le is not null and not isnan(le)")
    named = named.withColumn("g", canonical(F.col("labels")))
    groups = named.groupBy("g").agg(F.first("labels").alias("labels")).select(F.col("g").alias("sid"), "labels")
    rows = v.data.join(named.select("sid", "g", "le"), "sid").groupBy("g", "k").agg(F.array_sort(F.collect_list(F.struct("le", "sid", "value"))).alias("buckets"))
    rows = phi.beside(rows, "phi").withColumn("n", F.size("buckets"))
    # Counts never fall from one bound to the next.
    rising = F.aggregate(
        "buckets",
        F.struct(F.lit(0.0).alias("top"), F.array().cast("array<double>").alias("all")),
        lambda s, x: F.struct(F.greatest(s["top"], x["value"]).alias("top"), F.concat(s["all"], F.array(F.greatest(s["top"], x["value"]))).alias("all")),
        lambda s: s["all"],
    )
    rows = rows.withColumn("cum", rising).withColumn("rank", F.col("phi") * F.element_at("cum", -1))
    hit = F.array_position(F.transform("cum", lambda c: c >= F.col("rank")), F.lit(True)).cast("int")
    rows = rows.withColumn("at", F.when(hit > 0, hit).otherwise(F.col("n")) - 1)
    le = lambda i: F.get("buckets", i)["le"]
    end, below = le(F.col("at")), F.when(F.col("at") == 0, F.lit(0.0)).otherwise(F.get("cum", F.greatest(F.col("at") - 1, F.lit(0))))
    begin = F.when(F.col("at") == 0, F.least(F.lit(0.0), end)).otherwise(le(F.greatest(F.col("at") - 1, F.lit(0))))
    inside = F.get("cum", F.col("at")) - below
    share = (F.col("rank") - below) / F.when(inside > 0, inside)
    value = (
        F.when(F.isnan("phi") | (F.col("n") < 2) | (F.element_at("buckets", -1)["le"] < INF), F.lit(NAN))
        .when(F.col("phi") < 0, F.lit(-INF))
        .when(F.col("phi") > 1, F.lit(INF))
        .when(F.element_at("cum", -1) == 0, F.lit(NAN))
        .when(F.col("at") == F.col("n") - 1, le(F.col("n") - 2))
        .when(inside <= 0, end)
        .otherwise(begin + (end - begin) * share)
    )
    return Vector(rows.select(F.col("g").alias("sid"), "k", value.alias("value")), groups).mapped(F.col("value"))
