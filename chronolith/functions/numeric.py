"""Column arithmetic with the rules of IEEE 754, where Spark's ANSI mode would raise or give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: From here on every double is whole.
WHOLE = float(2**52)


def nan() -> Column:
    return F.lit(NAN)


def present(v: Column) -> Column:
    """Neither null nor NaN: what a vector keeps."""
    return v.isNotNull() & ~F.isnan(v)


def divide(a: Column, b: Column) -> Column:
    negative = (F.signum(a) < 0) != (b.cast("string") == "-0.0")
    by_zero = F.when((a == 0) | F.isnan(a), nan()).when(negative, F.lit(-INF)).otherwise(F.lit(INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def remainder(a: Column, b: Column) -> Column:
    return F.when(b == 0, nan()).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": remainder, "^": lambda a, b: F.pow(a, b)}


def compare(op: str, a: Column, b: Column) -> Column:
    """NaN differs from everything and is in no order."""
    plain = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    odd = F.isnan(a) | F.isnan(b)
    return (odd | plain) if op == "!=" else (~odd & plain)


def _log(f) -> object:
    return lambda v: F.when(v == 0, F.lit(-INF)).when(v < 0, nan()).otherwise(f(v))


def _whole(f) -> object:
    return lambda v: F.when((F.abs(v) >= WHOLE) | F.isnan(v), v).otherwise(f(v).cast("double"))


floor, ceil = _whole(F.floor), _whole(F.ceil)


def round_to(v: Column, nearest: Column) -> Column:
    """Halves go up; a step of 0 gives NaN."""
    q = divide(v, nearest)
    return F.when(nearest == 0, nan()).otherwise(floor(q + F.when(F.abs(q) >= WHOLE, F.lit(0.0)).otherwise(F.lit(0.5))) * nearest)


def smaller(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), nan()).otherwise(F.least(a, b))


def larger(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), nan()).otherwise(F.greatest(a, b))


#: Functions of one vector.
MATH = {
    "abs": F.abs,
    "ceil": ceil,
    "floor": floor,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "ln": _log(F.ln),
    "log2": _log(F.log2),
    "log10": _log(F.log10),
    "sgn": F.signum,
}


def interpolated(sorted_values: Column, phi: Column) -> Column:
    """Quantile of a sorted array by linear interpolation; below 0 and above 1 the infinities."""
    n = F.size(sorted_values)
    rank = phi * (n - 1)
    low = F.floor(F.when((phi >= 0) & (phi <= 1), rank).otherwise(0.0)).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, F.least(low + 1, n - 1))
    between = a * (1 - (rank - low)) + b * (rank - low)
    return F.when(F.isnan(phi) | (n == 0), nan()).when(phi < 0, F.lit(-INF)).when(phi > 1, F.lit(INF)).otherwise(between)
