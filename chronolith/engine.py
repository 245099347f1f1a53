"""The query engine: instant and range queries over a sample source."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.lower import LOOKBACK_MS, Lowering
from .plans.syntax import Call, QueryError, Selector, parse
from .plans.values import Grid, Scalar, Source, String, Vector, canonical

MAX_STEPS = 11_000


def number_text(v: float) -> str:
    """A value as the API gives it: the shortest decimal form."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "+Inf" if v > 0 else "-Inf"
    if v == 0:
        return "0"
    sign, digits, exponent = "-" if v < 0 else "", *_shortest(abs(v))
    point = exponent + 1  # digits before the point
    if 0 < point <= 21:
        whole = digits.ljust(point, "0")
        return sign + whole[:point] + ("." + whole[point:] if len(whole) > point else "")
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    return sign + digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'+' if exponent > 0 else '-'}{abs(exponent)}"


def _shortest(v: float) -> tuple[str, int]:
    mantissa, _, exponent = f"{v!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    shift = len(whole) - 1 if whole.strip("0") else -(len(part) - len(part.lstrip("0"))) - 1
    return digits.rstrip("0") or "0", shift + int(exponent or 0)


class Engine:
    """``table`` gives the lazy result of a query, the other methods what the HTTP API returns."""

    def __init__(self, source: Source, lookback_ms: int = LOOKBACK_MS, max_steps: int = MAX_STEPS):
        self.source, self.lookback, self.max_steps = source, lookback_ms, max_steps

    def _grid(self, tree, start: int, end: int, step: int) -> Grid:
        if isinstance(tree, Selector) and tree.range_ms is not None:
            raise QueryError("range queries require an instant vector or scalar expression")
        if not step > 0:
            raise QueryError("step must be positive")
        if end < start:
            raise QueryError("end must not be before start")
        n = (end - start) // step + 1
        if n > self.max_steps:
            raise QueryError(f"query would evaluate {n} steps, exceeding the limit of {self.max_steps}; increase the step")
        return Grid(start, step, n)

    def _value(self, tree, grid: Grid) -> Vector | Scalar | String:
        return Lowering(self.source, grid, self.lookback).value(tree)

    def _rows(self, query: str, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
        """``(sid, labels, step, value)``; series that differ in their name alone stay apart by their id."""
        tree = parse(query)
        grid = self._grid(tree, start_ms, end_ms, step_ms)
        value = self._value(tree, grid)
        if isinstance(value, String):
            raise QueryError("string expressions are not valid in range queries")
        if isinstance(value, Scalar):
            rows = value.table(grid, self.source.samples.sparkSession)
            rows = rows.withColumns({"sid": F.lit("{}"), "labels": F.create_map().cast("map<string,string>")})
        else:
            rows = value.labelled()
        return rows.select("sid", "labels", grid.time().alias("step"), "value")

    def table(self, query: str, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
        """``(labels, step, value)`` of a range query, lazily; the step is the time in milliseconds. A scalar has no labels."""
        return self._rows(query, start_ms, end_ms, step_ms).drop("sid")

    def range_query(self, query: str, start_ms: int, end_ms: int, step_ms: int) -> dict:
        rows = self._rows(query, start_ms, end_ms, step_ms)
        each = rows.groupBy("sid").agg(F.first("labels").alias("metric"), F.array_sort(F.collect_list(F.struct("step", "value"))).alias("points"))
        ordered = each.orderBy(canonical(F.col("metric")), "sid").collect()
        return {"resultType": "matrix", "result": [{"metric": r.metric or {}, "values": [[p.step / 1000, number_text(p.value)] for p in r.points]} for r in ordered]}

    def instant_query(self, query: str, time_ms: int) -> dict:
        tree, at = parse(query), time_ms / 1000
        if isinstance(tree, Selector) and tree.range_ms is not None:
            return self._raw(tree, time_ms)
        value = self._value(tree, Grid(time_ms, 1, 1))
        if isinstance(value, String):
            return {"resultType": "string", "result": [at, value.value]}
        if isinstance(value, Scalar):
            row = value.table(Grid(time_ms, 1, 1), self.source.samples.sparkSession).first()
            return {"resultType": "scalar", "result": [at, number_text(row.value)]}
        rows = value.labelled().withColumn("key", canonical(F.col("labels")))
        order = [F.col("key"), F.col("sid")]
        if isinstance(tree, Call) and tree.func in ("sort", "sort_desc"):
            order.insert(0, F.col("value").asc() if tree.func == "sort" else F.col("value").desc())
        return {"resultType": "vector", "result": [{"metric": r.labels, "value": [at, number_text(r.value)]} for r in rows.orderBy(*order).collect()]}

    def _raw(self, tree: Selector, time_ms: int) -> dict:
        """The samples themselves, of (end - range, end]."""
        end = time_ms - tree.offset_ms
        series, samples = self.source.select(tree.matchers, end - tree.range_ms, end)
        each = samples.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("points")).join(series, "sid")
        rows = each.withColumn("key", canonical(F.col("labels"))).orderBy("key").collect()
        return {"resultType": "matrix", "result": [{"metric": r.labels, "values": [[p.ts / 1000, number_text(p.value)] for p in r.points]} for r in rows]}
