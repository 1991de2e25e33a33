"""Element-wise functions on doubles, with IEEE results where SQL would give null or raise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def log(x: Column, base: float | None = None) -> Column:
    found = F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(F.log(x))
    return found if base is None else found / F.log(F.lit(float(base)))


def log1p(x: Column) -> Column:
    return F.when(x == -1, F.lit(-INF)).when(x < -1, F.lit(NAN)).otherwise(F.log1p(x))


def mod(x: Column, y: Column) -> Column:
    """Remainder with the dividend's sign; NaN for a zero divisor."""
    return F.coalesce(F.try_mod(x, y), F.lit(NAN))


def round_(x: Column, precision: int = 0) -> Column:
    return F.round(x, precision)


def whole(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """floor or ceil of any double: those from 2**53 on, infinities and NaN are as they are."""
    return lambda x: F.when(F.abs(x) < float(2**53), function(x).cast("double")).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


#: Functions of one element.
UNARY: dict[str, Callable[[Column], Column]] = {
    "round": round_, "floor": whole(F.floor), "ceil": whole(F.ceil), "abs": F.abs, "square": lambda x: x * x,
    "sqrt": F.sqrt, "exp": F.exp, "expm1": F.expm1, "log": log, "log1p": log1p, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "negate": lambda x: -x, "reciprocal": lambda x: F.lit(1.0) / x, "sign": F.signum,
    "deg2rad": F.radians, "rad2deg": F.degrees, "as_int": lambda x: x.cast("bigint").cast("double"),
}
#: Functions of two elements.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "multiply": lambda x, y: x * y, "divide": lambda x, y: x / y, "pow": F.pow, "mod": mod,
}


def _truth(x: Column) -> Column:
    return F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))


#: Comparisons give 1 or 0; NaN equals nothing, itself included, and is neither less nor greater.
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "equal": lambda x, y: _truth((x == y) & ~F.isnan(x)), "not_equal": lambda x, y: _truth((x != y) | F.isnan(x)),
    "greater": lambda x, y: _truth((x > y) & ~F.isnan(x)), "greater_equal": lambda x, y: _truth((x >= y) & ~F.isnan(x)),
    "less": lambda x, y: _truth((x < y) & ~F.isnan(y)), "less_equal": lambda x, y: _truth((x <= y) & ~F.isnan(y)),
}
