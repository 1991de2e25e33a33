"""Vectors held as array<double> values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-14


def let(value: Column, body) -> Column:
    """body(value), with value worked out once, not wherever the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def product(v: Column) -> Column:
    return F.aggregate(v, F.lit(1.0), lambda a, x: a * x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def median(v: Column) -> Column:
    n = F.size(v)

    def middle(s: Column) -> Column:
        return (F.get(s, F.floor((n - F.lit(1)) / F.lit(2)).cast("int")) + F.get(s, F.floor(n / F.lit(2)).cast("int"))) / F.lit(2.0)

    return let(F.array_sort(v), middle)


def variance(v: Column, centre: Column | None = None) -> Column:
    """Population variance, about the mean or another centre."""
    mu = mean(v) if centre is None else centre
    return F.aggregate(v, F.struct(F.lit(0.0).alias("s"), mu.alias("m")), lambda a, x: F.struct((a["s"] + (x - a["m"]) * (x - a["m"])).alias("s"), a["m"].alias("m")), lambda a: a["s"]) / F.size(v)


def dot(v: Column, w: Column) -> Column:
    return total(F.zip_with(v, w, lambda x, y: x * y))


def norm(v: Column, p: float = 2) -> Column:
    size = F.transform(v, F.abs)
    if p == 1:
        return total(size)
    if p == 2:
        return F.sqrt(total(F.transform(v, lambda x: x * x)))
    if p == float("inf"):
        return F.array_max(size)
    return F.pow(total(F.transform(size, lambda x: F.pow(x, F.lit(float(p))))), F.lit(1.0 / p))


def normalize(v: Column, p: float = 2) -> Column:
    """The unit vector; one shorter than 1e-14 stays as it is."""
    return let(norm(v, p), lambda n: F.when(n < TINY, v).otherwise(F.transform(v, lambda x: x / n)))


def project(v: Column, w: Column) -> Column:
    return _along(v, w, lambda s: F.transform(w, lambda y: y * s))


def reflect(v: Column, w: Column) -> Column:
    return _along(v, w, lambda s: F.zip_with(v, w, lambda x, y: x - F.lit(2.0) * y * s))


def _along(v: Column, w: Column, make) -> Column:
    zero = F.raise_error(F.lit("cannot project onto a zero vector")).cast("double")
    return let(let(dot(w, w), lambda own: F.when(own < TINY, zero).otherwise(dot(v, w) / own)), make)


def cross(v: Column, w: Column) -> Column:
    def at(a: int, b: int) -> Column:
        return F.get(v, F.lit(a)) * F.get(w, F.lit(b)) - F.get(v, F.lit(b)) * F.get(w, F.lit(a))

    three = (F.size(v) == 3) & (F.size(w) == 3)
    return F.when(three, F.array(at(1, 2), at(2, 0), at(0, 1))).otherwise(F.raise_error(F.lit("cross needs two vectors of three")).cast("array<double>"))


def argmin(v: Column) -> Column:
    """The first place, from 0, of the smallest element."""
    return F.array_position(v, F.array_min(v)) - 1


def argmax(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)) - 1


def quantile(v: Column, q: float) -> Column:
    """Linear interpolation between the two nearest elements."""
    at = (F.size(v) - F.lit(1)) * F.lit(float(q))

    def between(s: Column) -> Column:
        low = F.get(s, F.floor(at).cast("int"))
        return low + (F.get(s, F.ceil(at).cast("int")) - low) * (at - F.floor(at))

    return let(F.array_sort(v), between)


def softmax(v: Column) -> Column:
    shifted = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def convolve(v: Column, kernel: list[float], stride: int = 1) -> Column:
    """Valid cross-correlation (the kernel is not flipped); none where the kernel is longer than the vector."""
    k = len(kernel)

    def at(o: Column) -> Column:
        terms = [F.get(v, o * F.lit(stride) + F.lit(t)) * F.lit(float(w)) for t, w in enumerate(kernel)]
        return reduce(lambda a, b: a + b, terms)

    steps = F.floor((F.size(v) - F.lit(k)) / F.lit(stride)).cast("int")
    return F.when(F.size(v) >= k, F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), at)).otherwise(F.array().cast("array<double>"))


def reduce_(v: Column, function, initial: Column) -> Column:
    """A left fold in the array's order."""
    return F.aggregate(v, initial, function)
