"""Lowers an expression tree to a lazy plan over a sample source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import ARITHMETIC, MATH, NAN, compare, larger, round_to, smaller
from ..operators import aggregates, histogram, matching, selectors
from .syntax import COMPARISONS, SET_OPERATORS, Aggregate, Binary, Call, Number, QueryError, Selector, Text, Unary
from .values import Grid, Scalar, Source, String, Vector

LOOKBACK_MS = 300_000


class Lowering:
    """One query over one grid. Equal selectors are lowered once, so Spark may share their scans and exchanges."""

    def __init__(self, source: Source, grid: Grid, lookback_ms: int = LOOKBACK_MS):
        self.source, self.grid, self.lookback = source, grid, lookback_ms
        self.spark: SparkSession = source.samples.sparkSession
        self.known: dict[Selector, Vector] = {}

    def value(self, tree) -> Vector | Scalar | String:
        return _KINDS[type(tree)](self, tree)

    # Leaves

    def number(self, tree: Number) -> Scalar:
        return Scalar.of(tree.value)

    def text(self, tree: Text) -> String:
        return String(tree.value)

    def selector(self, tree: Selector) -> Vector:
        if tree.range_ms is not None:
            raise QueryError("range vector is not allowed here (did you mean to wrap it in rate()/…_over_time()?)")
        if tree not in self.known:
            self.known[tree] = selectors.instant(self.source, tree, self.grid, self.lookback)
        return self.known[tree]

    # Operators

    def unary(self, tree: Unary):
        value = self.value(tree.expr)
        if tree.op == "+":
            return value
        if isinstance(value, String):
            raise QueryError("unary operator not applicable to strings")
        if isinstance(value, Vector):
            return value.mapped(-F.col("value"))
        return self._scalar(value, None, lambda a, _: -a)

    def aggregate(self, tree: Aggregate) -> Vector:
        value = self.value(tree.expr)
        if not isinstance(value, Vector):
            raise QueryError(f"{tree.op}() expects an instant vector")
        param = self.scalar_argument(tree.param, tree.op) if tree.param is not None else None
        return aggregates.aggregate(value, tree, param)

    def binary(self, tree: Binary):
        left, right = self.value(tree.left), self.value(tree.right)
        if isinstance(left, String) or isinstance(right, String):
            raise QueryError("string literals are not allowed in binary operations")
        vectors = isinstance(left, Vector), isinstance(right, Vector)
        if tree.op in SET_OPERATORS:
            if not all(vectors):
                raise QueryError(f'set operator "{tree.op}" requires vector operands')
            return matching.set_operation(left, right, tree)
        if all(vectors):
            return matching.one_to_one(left, right, tree)
        if vectors[0]:
            return matching.with_scalar(right.beside(left.data, "s"), left, tree, "s", scalar_left=False)
        if vectors[1]:
            return matching.with_scalar(left.beside(right.data, "s"), right, tree, "s", scalar_left=True)
        if tree.op in COMPARISONS:
            if not tree.as_bool:
                raise QueryError("comparisons between scalars must use the bool modifier")
            return self._scalar(left, right, lambda a, b: F.when(compare(tree.op, a, b), F.lit(1.0)).otherwise(F.lit(0.0)))
        return self._scalar(left, right, ARITHMETIC[tree.op])

    def _scalar(self, a: Scalar, b: Scalar | None, f: Callable) -> Scalar:
        if a.frame is None and (b is None or b.frame is None):
            return Scalar(f(a.column, b.column if b else None))
        rows = a.table(self.grid, self.spark).withColumnRenamed("value", "a")
        if b is not None:
            rows = b.beside(rows, "b")
        return Scalar(None, rows.select("k", f(F.col("a"), F.col("b") if b else None).alias("value")))

    # Calls

    def call(self, tree: Call):
        name, args = tree.func, tree.args
        if name in selectors.RANGE:
            self._count(name, args, 1)
            return selectors.RANGE[name](self.range_argument(args[0], name))
        if name in MATH:
            self._count(name, args, 1)
            return self.vector_argument(args[0], name).mapped(MATH[name](F.col("value")))
        if name not in _CALLS:
            raise QueryError(f'unknown or unsupported function "{name}"')
        return _CALLS[name](self, name, args)

    @staticmethod
    def _count(name: str, args: tuple, n: int) -> None:
        if len(args) != n:
            raise QueryError(f"{name}() expects {'exactly 1 argument' if n == 1 else f'{n} arguments'}")

    def range_argument(self, tree, name: str) -> selectors.Windows:
        if not isinstance(tree, Selector) or tree.range_ms is None:
            raise QueryError(f"{name}() expects a range vector like metric[5m] as its argument")
        return selectors.Windows(self.source, tree, self.grid)

    def scalar_argument(self, tree, name: str) -> Scalar:
        value = self.value(tree)
        if not isinstance(value, Scalar):
            raise QueryError(f"{name}() expects a scalar here")
        return value

    def vector_argument(self, tree, name: str) -> Vector:
        value = self.value(tree)
        if not isinstance(value, Vector):
            raise QueryError(f"{name}() expects an instant vector here")
        return value

    def quantile_over_time(self, name: str, args: tuple) -> Vector:
        self._count(name, args, 2)
        phi = self.scalar_argument(args[0], name)
        return selectors.quantile_over_time(self.range_argument(args[1], name), phi)

    def round(self, name: str, args: tuple) -> Vector:
        if len(args) not in (1, 2):
            raise QueryError("round() expects 1 or 2 arguments")
        v = self.vector_argument(args[0], name)
        nearest = self.scalar_argument(args[1], name) if len(args) == 2 else Scalar.of(1)
        return Vector(nearest.beside(v.data, "s"), v.series).mapped(round_to(F.col("value"), F.col("s")))

    def clamp(self, name: str, args: tuple) -> Vector:
        self._count(name, args, 3 if name == "clamp" else 2)
        v = self.vector_argument(args[0], name)
        low = self.scalar_argument(args[1], name) if name != "clamp_max" else None
        high = self.scalar_argument(args[-1], name) if name != "clamp_min" else None
        data, value = v.data, F.col("value")
        if low:
            data, value = low.beside(data, "low"), larger(value, F.col("low"))
        if high:
            data, value = high.beside(data, "high"), smaller(value, F.col("high"))
        return Vector(data, v.series).mapped(value)

    def histogram_quantile(self, name: str, args: tuple) -> Vector:
        self._count(name, args, 2)
        phi = self.scalar_argument(args[0], name)
        return histogram.histogram_quantile(self.vector_argument(args[1], name), phi)

    def scalar(self, name: str, args: tuple) -> Scalar:
        self._count(name, args, 1)
        v = self.vector_argument(args[0], name)
        single = v.data.groupBy("k").agg(F.count("value").alias("n"), F.min("value").alias("x"))
        rows = self.grid.steps(self.spark).join(single, "k", "left")
        return Scalar(None, rows.select("k", F.when(F.col("n") == 1, F.col("x")).otherwise(F.lit(NAN)).alias("value")))

    def vector(self, name: str, args: tuple) -> Vector:
        self._count(name, args, 1)
        rows = self.scalar_argument(args[0], name).table(self.grid, self.spark)
        return Vector(rows.select(F.lit("{}").alias("sid"), "k", "value"), self._one_series({})).mapped(F.col("value"))

    def _one_series(self, labels: dict[str, str]):
        pairs = [F.lit(x) for pair in labels.items() for x in pair]
        return self.spark.range(1).select(F.lit("{}").alias("sid"), F.create_map(*pairs).cast("map<string,string>").alias("labels"))

    def time(self, name: str, args: tuple) -> Scalar:
        if args:
            raise QueryError("time() expects no arguments")
        return Scalar(self.grid.time() / 1000.0)

    def absent(self, name: str, args: tuple) -> Vector:
        self._count(name, args, 1)
        v = self.vector_argument(args[0], name)
        given = args[0].matchers if isinstance(args[0], Selector) else ()
        labels = {m.name: m.value for m in given if m.op == "=" and m.name != "__name__"}
        steps = self.grid.steps(self.spark).join(v.data.select("k").distinct(), "k", "left_anti")
        return Vector(steps.select(F.lit("{}").alias("sid"), "k", F.lit(1.0).alias("value")), self._one_series(labels))

    def sort(self, name: str, args: tuple) -> Vector:
        self._count(name, args, 1)
        value = self.value(args[0])
        if not isinstance(value, Vector):
            raise QueryError(f"{name}() expects an instant vector")
        return value


_KINDS = {Number: Lowering.number, Text: Lowering.text, Selector: Lowering.selector, Unary: Lowering.unary, Aggregate: Lowering.aggregate, Binary: Lowering.binary, Call: Lowering.call}
_CALLS = {
    "quantile_over_time": Lowering.quantile_over_time,
    "round": Lowering.round,
    "clamp": Lowering.clamp,
    "clamp_min": Lowering.clamp,
    "clamp_max": Lowering.clamp,
    "histogram_quantile": Lowering.histogram_quantile,
    "scalar": Lowering.scalar,
    "vector": Lowering.vector,
    "time": Lowering.time,
    "absent": Lowering.absent,
    "sort": Lowering.sort,
    "sort_desc": Lowering.sort,
}
