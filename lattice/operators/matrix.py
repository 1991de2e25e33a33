"""Matrices and vectors as DataFrames.

A Matrix is a table (row_id long, v array<double>) with rows numbered from 0; element-wise and row-wise work
is a column expression on v. Work across rows uses the coordinate form (i, j, x), in which a product is a join
and an aggregation. A Vector is a table (i long, x double). Shapes are kept as metadata and counted once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise, vectors
from ..session import map_arrow
from . import profile

INF = float("inf")
#: Columns up to which column aggregates are one wide aggregation rather than a regrouping of cells.
WIDE = 256


def numbers(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows of a matrix, without a copy of each element to Python."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


class ShapeError(ValueError):
    """Shapes that do not fit each other or the operation."""


class Vector:
    def __init__(self, df: DataFrame, n: int | None = None, column: bool = False):
        self.df, self._n, self.column = df.select(F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")), n, column

    @classmethod
    def build(cls, spark: SparkSession, values: list[float], column: bool = False) -> Vector:
        return cls(spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "i long, x double"), len(values), column)

    @classmethod
    def fill(cls, spark: SparkSession, value: float, n: int) -> Vector:
        return cls(spark.range(n).select(F.col("id").alias("i"), F.lit(float(value)).alias("x")), n)

    @classmethod
    def zeros(cls, spark: SparkSession, n: int) -> Vector:
        return cls.fill(spark, 0.0, n)

    @classmethod
    def ones(cls, spark: SparkSession, n: int) -> Vector:
        return cls.fill(spark, 1.0, n)

    @classmethod
    def uniform(cls, spark: SparkSession, n: int, low: float = -1.0, high: float = 1.0, seed: int = 0) -> Vector:
        return cls(spark.range(n).select(F.col("id").alias("i"), (F.lit(low) + F.lit(high - low) * F.rand(seed)).alias("x")), n)

    @classmethod
    def rand(cls, spark: SparkSession, n: int, seed: int = 0) -> Vector:
        return cls.uniform(spark, n, 0.0, 1.0, seed)

    @classmethod
    def gaussian(cls, spark: SparkSession, n: int, seed: int = 0) -> Vector:
        return cls(spark.range(n).select(F.col("id").alias("i"), F.randn(seed).alias("x")), n)

    @property
    def n(self) -> int:
        if self._n is None:
            self._n = self.df.count()
        return self._n

    def shape(self) -> tuple[int, ...]:
        return (self.n, 1) if self.column else (self.n,)

    def is_square(self) -> bool:
        return False

    def array(self) -> DataFrame:
        """One row, one column v: all elements in order. For vectors as long as a matrix is wide."""
        return self.df.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))

    def values(self) -> list[float]:
        return [r.x for r in self.df.orderBy("i").collect()]

    def map(self, function: Callable[[Column], Column]) -> Vector:
        return Vector(self.df.select("i", function(F.col("x")).cast("double").alias("x")), self._n, self.column)

    def apply(self, name: str, *arguments: float) -> Vector:
        return self.map(lambda x: elementwise.UNARY[name](x, *arguments))

    def combine(self, other: Vector | float, function: Callable[[Column, Column], Column]) -> Vector:
        if not isinstance(other, Vector):
            return self.map(lambda x: function(x, F.lit(float(other))))
        if other.column != self.column and self.column or other.n != self.n:
            raise ShapeError(f"{self.shape()} and {other.shape()}")
        joined = self.df.join(other.df.select("i", F.col("x").alias("y")), "i")
        return Vector(joined.select("i", function(F.col("x"), F.col("y")).alias("x")), self._n, self.column)

    def binary(self, name: str, other: Vector | float) -> Vector:
        return self.combine(other, elementwise.BINARY[name])

    def compare(self, name: str, other: Vector | float) -> Vector:
        return self.combine(other, elementwise.COMPARE[name])

    def aggregate(self, **columns: Column) -> DataFrame:
        return self.df.agg(*[c.alias(k) for k, c in columns.items()])

    def _one(self, column: Column) -> float:
        return self.df.agg(column).first()[0]

    def sum(self) -> float:
        return self._one(F.sum("x"))

    def product(self) -> float:
        return self._one(F.product("x"))

    def min(self) -> float:
        return self._one(F.min("x"))

    def max(self) -> float:
        return self._one(F.max("x"))

    def mean(self) -> float:
        return self._one(F.avg("x"))

    def median(self) -> float:
        return self.quantile(0.5)

    def variance(self, centre: float | None = None) -> float:
        return self._one(F.var_pop("x") if centre is None else F.avg((F.col("x") - F.lit(centre)) * (F.col("x") - F.lit(centre))))

    def quantile(self, q: float) -> float:
        return profile.quantile(self.df.select(F.col("x").alias("v")), q)

    def argmin(self) -> int:
        return self._one(F.min(F.struct("x", "i"))["i"])

    def argmax(self) -> int:
        return -self._one(F.max(F.struct("x", -F.col("i")))["col2"])

    def norm(self, p: float = 2) -> float:
        size = F.abs("x")
        if p == INF:
            return self._one(F.max(size))
        if p == 1:
            return self._one(F.sum(size))
        if p == 2:
            return self._one(F.sqrt(F.sum(F.col("x") * F.col("x"))))
        return self._one(F.pow(F.sum(F.pow(size, F.lit(float(p)))), F.lit(1.0 / p)))

    def dot(self, other: Vector) -> float:
        if self.n != other.n:
            raise ShapeError(f"{self.n} and {other.n}")
        return self.df.join(other.df.select("i", F.col("x").alias("y")), "i").agg(F.sum(F.col("x") * F.col("y"))).first()[0]

    def outer(self, other: Vector) -> DataFrame:
        """(i, j, x): every product; as large as its result must be."""
        return self.df.crossJoin(other.df.select(F.col("i").alias("j"), F.col("x").alias("y"))).select("i", "j", (F.col("x") * F.col("y")).alias("x"))

    def normalize(self, p: float = 2) -> Vector:
        n = self.norm(p)
        return self if n < vectors.TINY else self.map(lambda x: x / F.lit(n))

    def _share(self, other: Vector) -> float:
        own = other.dot(other)
        if own < vectors.TINY:
            raise ZeroDivisionError("cannot project onto a zero vector")
        return self.dot(other) / own

    def project(self, other: Vector) -> Vector:
        s = self._share(other)
        return other.map(lambda y: y * F.lit(s))

    def reflect(self, other: Vector) -> Vector:
        s = self._share(other)
        return self.combine(other, lambda x, y: x - F.lit(2.0 * s) * y)

    def cross(self, other: Vector) -> Vector:
        if self.n != 3 or other.n != 3:
            raise ShapeError("cross needs two vectors of three")
        made = self.array().crossJoin(other.array().withColumnRenamed("v", "w")).select(F.posexplode(vectors.cross(F.col("v"), F.col("w"))).alias("i", "x"))
        return Vector(made, 3)

    def convolve(self, kernel: list[float], stride: int = 1) -> Vector:
        """Valid cross-correlation as a join of each element with the outputs it bears on; no ordering of the whole."""
        if self.n < len(kernel):
            return Vector(self.df.limit(0), 0)
        terms = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(w)).alias("w")) for t, w in enumerate(kernel)]))
        at = self.df.select("i", "x", terms.alias("k")).select((F.col("i") - F.col("k.t")).alias("o"), (F.col("x") * F.col("k.w")).alias("y"))
        last = (self.n - len(kernel)) // stride
        at = at.where((F.col("o") >= 0) & (F.col("o") % stride == 0) & (F.col("o") <= last * stride))
        return Vector(at.groupBy((F.col("o") / stride).cast("long").alias("i")).agg(F.sum("y").alias("x")), last + 1)

    def reduce(self, function: Callable[[Column, Column], Column], initial: float) -> float:
        """A left fold in order; it gathers the vector, since a fold without a merge can't be split."""
        return self.array().select(F.aggregate("v", F.lit(float(initial)), function)).first()[0]

    def as_column(self) -> Vector:
        return Vector(self.df, self._n, True)

    def as_row_matrix(self) -> Matrix:
        return Matrix(self.array().select(F.lit(0).cast("long").alias("row_id"), "v"), 1, self._n)

    def as_column_matrix(self) -> Matrix:
        return Matrix(self.df.select(F.col("i").alias("row_id"), F.array("x").alias("v")), self._n, 1)


class Matrix:
    def __init__(self, df: DataFrame, m: int | None = None, n: int | None = None):
        self.df, self._m, self._n = df.select(F.col("row_id").cast("long").alias("row_id"), F.col("v").cast("array<double>").alias("v")), m, n

    # -- making

    @classmethod
    def build(cls, spark: SparkSession, rows: list[list[float]]) -> Matrix:
        if any(len(r) != len(rows[0]) for r in rows):
            raise ShapeError("rows differ in length")
        return cls(spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "row_id long, v array<double>"), len(rows), len(rows[0]) if rows else 0)

    @classmethod
    def from_table(cls, df: DataFrame, row_id: str, v: str) -> Matrix:
        return cls(df.select(F.col(row_id).alias("row_id"), F.col(v).alias("v")))

    @classmethod
    def from_cells(cls, cells: DataFrame, m: int | None = None, n: int | None = None) -> Matrix:
        """From (i, j, x), every cell present."""
        return cls(cells.groupBy(F.col("i").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("v")), m, n)

    @classmethod
    def _made(cls, spark: SparkSession, m: int, n: int, cell: Callable[[Column, Column], Column]) -> Matrix:
        if m < 1 or n < 1:
            raise ShapeError(f"{m} x {n}")
        return cls(spark.range(m).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: cell(F.col("id"), j)).alias("v")), m, n)

    @classmethod
    def fill(cls, spark: SparkSession, value: float, m: int, n: int) -> Matrix:
        return cls._made(spark, m, n, lambda i, j: F.lit(float(value)))

    @classmethod
    def zeros(cls, spark: SparkSession, m: int, n: int) -> Matrix:
        return cls.fill(spark, 0.0, m, n)

    @classmethod
    def ones(cls, spark: SparkSession, m: int, n: int) -> Matrix:
        return cls.fill(spark, 1.0, m, n)

    @classmethod
    def eye(cls, spark: SparkSession, n: int) -> Matrix:
        return cls._made(spark, n, n, lambda i, j: F.when(i == j, 1.0).otherwise(0.0))

    identity = eye

    @classmethod
    def from_diagonal(cls, spark: SparkSession, values: list[float]) -> Matrix:
        given = F.array(*[F.lit(float(x)) for x in values])
        return cls._made(spark, len(values), len(values), lambda i, j: F.when(i == j, F.get(given, j)).otherwise(0.0))

    @classmethod
    def uniform(cls, spark: SparkSession, m: int, n: int, low: float = -1.0, high: float = 1.0, seed: int = 0) -> Matrix:
        return cls._made(spark, m, n, lambda i, j: F.lit(low) + F.lit(high - low) * F.rand(seed))

    @classmethod
    def rand(cls, spark: SparkSession, m: int, n: int, seed: int = 0) -> Matrix:
        return cls.uniform(spark, m, n, 0.0, 1.0, seed)

    @classmethod
    def gaussian(cls, spark: SparkSession, m: int, n: int, seed: int = 0) -> Matrix:
        return cls._made(spark, m, n, lambda i, j: F.randn(seed))

    @classmethod
    def poisson(cls, spark: SparkSession, m: int, n: int, rate: float = 1.0, seed: int = 0) -> Matrix:
        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [np.random.default_rng((seed, i)).poisson(rate, n).astype(float) for i in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["row_id", "v"])

        return cls(map_arrow(spark.range(m), draw, "row_id long, v array<double>"), m, n)

    # -- shape

    @property
    def m(self) -> int:
        if self._m is None:
            self._m = self.df.count()
        return self._m

    @property
    def n(self) -> int:
        if self._n is None:
            low, high = self.df.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
            if low != high:
                raise ShapeError("rows differ in length")
            self._n = low or 0
        return self._n

    def shape(self) -> tuple[int, int]:
        return self.m, self.n

    def shape_string(self) -> str:
        return f"{self.m} x {self.n}"

    def size(self) -> int:
        return self.m * self.n

    def ndim(self) -> int:
        return 2

    def dtype(self) -> str:
        return "double"

    def is_square(self) -> bool:
        return self.m == self.n

    def _square(self) -> None:
        if not self.is_square():
            raise ShapeError(f"{self.shape_string()} is not square")

    def _same(self, other: Matrix) -> None:
        if self.shape() != other.shape():
            raise ShapeError(f"{self.shape_string()} and {other.shape_string()}")

    def cells(self) -> DataFrame:
        return self.df.select(F.col("row_id").alias("i"), F.posexplode("v").alias("j", "x"))

    def local(self) -> np.ndarray:
        """The whole matrix on the driver: for small ones, such as Gram matrices."""
        return np.array([r.v for r in self.df.orderBy("row_id").collect()], float).reshape(-1, self.n)

    def as_text(self) -> str:
        return "\n".join("[" + ", ".join(f"{x:.4f}".rstrip("0").rstrip(".") for x in row) + "]" for row in self.local())

    # -- element-wise

    def map(self, function: Callable[[Column], Column]) -> Matrix:
        return Matrix(self.df.select("row_id", F.transform("v", lambda x: function(x).cast("double")).alias("v")), self._m, self._n)

    def apply(self, name: str, *arguments: float) -> Matrix:
        return self.map(lambda x: elementwise.UNARY[name](x, *arguments))

    def clip(self, low: float, high: float) -> Matrix:
        return self.map(lambda x: elementwise.clip(x, low, high))

    def clip_lower(self, low: float) -> Matrix:
        return self.map(lambda x: F.greatest(F.lit(float(low)), x))

    def clip_upper(self, high: float) -> Matrix:
        return self.map(lambda x: F.least(F.lit(float(high)), x))

    def combine(self, other: Matrix | Vector | float, function: Callable[[Column, Column], Column], rows: bool = True) -> Matrix:
        """With a number, a matrix of this shape, or (where rows allows) a row or column vector that is repeated."""
        if isinstance(other, Matrix):
            self._same(other)
            joined = self.df.join(other.df.withColumnRenamed("v", "w"), "row_id")
            return Matrix(joined.select("row_id", F.zip_with("v", "w", function).alias("v")), self._m, self._n)
        if isinstance(other, Vector):
            if not rows:
                raise ShapeError("only numbers and matrices")
            if other.column:
                if other.n != self.m:
                    raise ShapeError(f"{self.shape_string()} and a column of {other.n}")
                joined = self.df.join(other.df.withColumnRenamed("i", "row_id"), "row_id")
                return Matrix(joined.select("row_id", F.transform("v", lambda a: function(a, F.col("x"))).alias("v")), self._m, self._n)
            if other.n != self.n:
                raise ShapeError(f"{self.shape_string()} and a row of {other.n}")
            # One row, as long as this matrix is wide.
            joined = self.df.crossJoin(F.broadcast(other.array().withColumnRenamed("v", "w")))
            return Matrix(joined.select("row_id", F.zip_with("v", "w", function).alias("v")), self._m, self._n)
        return self.map(lambda x: function(x, F.lit(float(other))))

    def binary(self, name: str, other: Matrix | Vector | float) -> Matrix:
        return self.combine(other, elementwise.BINARY[name], name in ("add", "subtract", "multiply"))

    def compare(self, name: str, other: Matrix | float) -> Matrix:
        return self.combine(other, elementwise.COMPARE[name], False)

    def softmax(self) -> Matrix:
        return Matrix(self.df.select("row_id", vectors.softmax(F.col("v")).alias("v")), self._m, self._n)

    # -- reductions

    def reductions(self) -> DataFrame:
        """One row: sum, product, min, max, mean, variance, in one pass over the rows."""
        v = F.col("v")
        squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
        total, n = F.sum(vectors.total(v)), F.sum(F.size(v))
        mean = total / n
        return self.df.agg(total.alias("sum"), F.product(vectors.product(v)).alias("product"), F.min(F.array_min(v)).alias("min"), F.max(F.array_max(v)).alias("max"), mean.alias("mean"), (F.sum(squares) / n - mean * mean).alias("variance"))

    def _one(self, name: str) -> float:
        return self.reductions().select(name).first()[0]

    def sum(self) -> float:
        return self._one("sum")

    def product(self) -> float:
        return self._one("product")

    def min(self) -> float:
        return self._one("min")

    def max(self) -> float:
        return self._one("max")

    def mean(self) -> float:
        return self._one("mean")

    def median(self) -> float:
        return self.quantile(0.5)

    def quantile(self, q: float) -> float:
        return profile.quantile(self.df.select(F.explode("v").alias("v")), q)

    def variance(self, centre: float | None = None) -> float:
        x = F.col("x")
        return self.cells().agg(F.var_pop(x) if centre is None else F.avg((x - F.lit(centre)) * (x - F.lit(centre)))).first()[0]

    def trace(self) -> float:
        self._square()
        return self.df.agg(F.sum(F.get("v", F.col("row_id").cast("int")))).first()[0]

    def rows(self, function: Callable[[Column], Column]) -> Vector:
        """A column vector of one value a row."""
        return Vector(self.df.select(F.col("row_id").alias("i"), function(F.col("v")).alias("x")), self._m, True)

    def row_sums(self) -> Vector:
        return self.rows(vectors.total)

    def row_means(self) -> Vector:
        return self.rows(vectors.mean)

    def row_maxima(self) -> Vector:
        return self.rows(F.array_max)

    def row_minima(self) -> Vector:
        return self.rows(F.array_min)

    def row_norms(self, p: float = 2) -> Vector:
        return self.rows(lambda v: vectors.norm(v, p))

    def columns(self, *aggregates: Callable[[Column], Column], finish: Callable[..., Column] | None = None) -> Vector:
        """A vector of one value a column: an aggregate of its elements (or `finish` of several)."""
        done = finish or (lambda a: a)
        if self.n <= WIDE:
            made = self.df.agg(F.array(*[done(*[a(F.get("v", F.lit(j))) for a in aggregates]) for j in range(self.n)]).alias("v"))
            return Vector(made.select(F.posexplode("v").alias("i", "x")), self._n)
        return Vector(self.cells().groupBy(F.col("j").alias("i")).agg(done(*[a(F.col("x")) for a in aggregates]).alias("x")), self._n)

    def column_sums(self) -> Vector:
        return self.columns(F.sum)

    def column_means(self) -> Vector:
        return self.columns(F.avg)

    def column_maxima(self) -> Vector:
        return self.columns(F.max)

    def column_minima(self) -> Vector:
        return self.columns(F.min)

    def column_norms(self, p: float = 2) -> Vector:
        if p == INF:
            return self.columns(lambda x: F.max(F.abs(x)))
        if p == 1:
            return self.columns(lambda x: F.sum(F.abs(x)))
        if p == 2:
            return self.columns(lambda x: F.sqrt(F.sum(x * x)))
        return self.columns(lambda x: F.pow(F.sum(F.pow(F.abs(x), F.lit(float(p)))), F.lit(1.0 / p)))

    def reduce(self, function: Callable[[Column, Column], Column], initial: float) -> float:
        """A left fold in row-major order; gathers the matrix, since a fold without a merge can't be split."""
        rows = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "v"))), lambda s: s["v"])
        return self.df.agg(rows.alias("r")).select(F.aggregate(F.flatten("r"), F.lit(float(initial)), function)).first()[0]

    # -- structure

    def row(self, i: int) -> Vector:
        if not 0 <= i < self.m:
            raise IndexError(f"no row {i}")
        return Vector(self.df.where(F.col("row_id") == i).select(F.posexplode("v").alias("i", "x")), self._n)

    def column(self, j: int) -> Vector:
        if not 0 <= j < self.n:
            raise IndexError(f"no column {j}")
        return Vector(self.df.select(F.col("row_id").alias("i"), F.get("v", F.lit(j)).alias("x")), self._m, True)

    def drop_row(self, i: int) -> Matrix:
        if not 0 <= i < self.m:
            raise IndexError(f"no row {i}")
        return Matrix(self.df.where(F.col("row_id") != i).select((F.col("row_id") - (F.col("row_id") > i).cast("long")).alias("row_id"), "v"), self.m - 1, self._n)

    def drop_column(self, j: int) -> Matrix:
        if not 0 <= j < self.n:
            raise IndexError(f"no column {j}")
        return Matrix(self.df.select("row_id", F.filter("v", lambda x, k: k != j).alias("v")), self._m, self.n - 1)

    def diagonal(self) -> Vector:
        k = min(self.m, self.n)
        return Vector(self.df.where(F.col("row_id") < k).select(F.col("row_id").alias("i"), F.get("v", F.col("row_id").cast("int")).alias("x")), k)

    def flatten(self) -> Vector:
        return Vector(self.cells().select((F.col("i") * F.lit(self.n) + F.col("j")).alias("i"), "x"))

    def transpose(self) -> Matrix:
        return Matrix.from_cells(self.cells().select(F.col("j").alias("i"), F.col("i").alias("j"), "x"), self._n, self._m)

    def stack(self, other: Matrix) -> Matrix:
        if self.n != other.n:
            raise ShapeError(f"{self.n} and {other.n} columns")
        return Matrix(self.df.unionByName(other.df.select((F.col("row_id") + F.lit(self.m)).alias("row_id"), "v")), self.m + other.m, self._n)

    def augment(self, other: Matrix) -> Matrix:
        if self.m != other.m:
            raise ShapeError(f"{self.m} and {other.m} rows")
        return Matrix(self.df.join(other.df.withColumnRenamed("v", "w"), "row_id").select("row_id", F.concat("v", "w").alias("v")), self._m, self.n + other.n)

    def repeat(self, m: int, n: int) -> Matrix:
        tiles = self.df.select("row_id", "v", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("t"))
        return Matrix(tiles.select((F.col("row_id") + F.col("t") * F.lit(self.m)).alias("row_id"), F.flatten(F.array_repeat("v", n)).alias("v")), self.m * m, self.n * n)

    def symmetric(self, tolerance: float = 1e-10) -> bool:
        if not self.is_square():
            return False
        c = self.cells()
        other = c.select(F.col("j").cast("long").alias("i"), F.col("i").cast("int").alias("j"), F.col("x").alias("y"))
        return bool(c.where("i > j").join(other, ["i", "j"]).agg(F.coalesce(F.bool_and(F.abs(F.col("x") - F.col("y")) <= tolerance), F.lit(True))).first()[0])

    # -- products

    def matmul(self, other: Matrix) -> Matrix:
        """As a join on the shared index; where the right side is small, as products of row blocks with it."""
        if self.n != other.m:
            raise ShapeError(f"{self.shape_string()} times {other.shape_string()}")
        if other.size() <= 4_000_000:  # at most 32 MB go to every task
            return self.times(other.local())
        a, b = self.cells(), other.cells().select(F.col("i").cast("int").alias("j"), F.col("j").alias("k"), F.col("x").alias("y"))
        made = a.join(b, "j").groupBy("i", "k").agg(F.sum(F.col("x") * F.col("y")).alias("x"))
        return Matrix.from_cells(made.select("i", F.col("k").alias("j"), "x"), self._m, other._n)

    def times(self, right: np.ndarray) -> Matrix:
        sent = self.df.sparkSession.sparkContext.broadcast(np.asarray(right, float))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    made = numbers(batch.column(1)) @ sent.value
                    offsets = pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))], ["row_id", "v"])

        return Matrix(map_arrow(self.df, run, "row_id long, v array<double>"), self._m, int(right.shape[1]))

    def dot(self, x: Vector) -> Vector:
        if self.n != x.n:
            raise ShapeError(f"{self.shape_string()} times a vector of {x.n}")
        # One row, as long as this matrix is wide.
        joined = self.df.crossJoin(F.broadcast(x.array().withColumnRenamed("v", "w")))
        return Vector(joined.select(F.col("row_id").alias("i"), vectors.dot(F.col("v"), F.col("w")).alias("x")), self._m, True)

    def gram_partials(self) -> DataFrame:
        """(g binary): a sum of v v' for each task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = numbers(batch.column(0))
                    total = part.T @ part if total is None else total + part.T @ part
            yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])

        return map_arrow(self.df.select("v"), run, "g array<double>")

    def gram(self) -> Matrix:
        """X'X: each task sums its rows' products; the sums, n x n each, are added in two steps, or cell by cell if large."""
        n = self.n
        if n * n > GRAM_CELLS:
            cells = self.gram_partials().select(F.posexplode("g").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"))
            return Matrix.from_cells(cells.select(F.floor(F.col("p") / F.lit(n)).alias("i"), (F.col("p") % F.lit(n)).alias("j"), "x"), n, n)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = numbers(batch.column(0)).sum(axis=0)
                    total = part if total is None else total + part
            yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tolist()], pa.list_(pa.float64()))], ["g"])

        partials = self.gram_partials()
        some = map_arrow(partials.repartition(GRAM_TASKS), add, "g array<double>")
        whole = map_arrow(some.repartition(1), add, "g array<double>")  # at most GRAM_TASKS rows
        row = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice("g", i * n + 1, n)))
        return Matrix(whole.select(row.alias("i", "v")).select(F.col("i").cast("long").alias("row_id"), "v"), n, n)

    def convolve(self, kernel: list[list[float]], stride: int = 1) -> Matrix:
        """Valid two-dimensional cross-correlation: each cell is sent to the outputs it bears on."""
        km, kn = len(kernel), len(kernel[0])
        om, on = (self.m - km) // stride + 1, (self.n - kn) // stride + 1
        if om < 1 or on < 1:
            raise ShapeError("the kernel is larger than the matrix")
        terms = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(kernel[a][b])).alias("w")) for a in range(km) for b in range(kn)]
        c = self.cells().select("i", "j", "x", F.explode(F.array(*terms)).alias("k"))
        i, j = F.col("i") - F.col("k.a"), F.col("j") - F.col("k.b")
        c = c.where((i >= 0) & (j >= 0) & (i % stride == 0) & (j % stride == 0) & (i <= (om - 1) * stride) & (j <= (on - 1) * stride))
        made = c.groupBy((i / stride).cast("long").alias("i"), (j / stride).cast("int").alias("j")).agg(F.sum(F.col("x") * F.col("k.w")).alias("x"))
        return Matrix.from_cells(made, om, on)


#: Cells of a product that a task adds up as a whole (a batch holds many such rows), and the tasks of the first of two such steps.
GRAM_CELLS, GRAM_TASKS = 65_536, 8


def chain(*matrices: Matrix) -> Matrix:
    """The product of several matrices, in the order of least work (the classic dynamic program)."""
    sizes = [matrices[0].m, *[x.n for x in matrices]]
    best: dict[tuple[int, int], tuple[int, int]] = {(i, i): (0, i) for i in range(len(matrices))}
    for span in range(1, len(matrices)):
        for i in range(len(matrices) - span):
            j = i + span
            best[i, j] = min((best[i, k][0] + best[k + 1, j][0] + sizes[i] * sizes[k + 1] * sizes[j + 1], k) for k in range(i, j))

    def make(i: int, j: int) -> Matrix:
        return matrices[i] if i == j else make(i, best[i, j][1]).matmul(make(best[i, j][1] + 1, j))

    return make(0, len(matrices) - 1)


def sum_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
