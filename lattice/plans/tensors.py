"""Queries over matrices and vectors: the embeddings table as a matrix of one row a vector."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise, vectors
from ..operators import linalg
from ..operators.matrix import Matrix, Vector, chain
from ..sources.tables import with_row_index
from .base import CELLS, Book, cells, embeddings, entries, table, tidy

BOOK = Book()
INF = float("inf")

_R = "round({}, 6) + 0.0"


def _cell_sql(expression: str, source: str = CELLS) -> str:
    return f"SELECT i, CAST(j AS BIGINT) AS j, {_R.format(expression)} AS y FROM {source}"


# -- element-wise; arguments that must lie in -1..1 are x / (1 + |x|)

_UNIT = ("asin", "acos")
_UNARY_SQL = {
    "round": "round(x)", "floor": "floor(x)", "ceil": "ceil(x)", "abs": "abs(x)", "square": "x * x", "sqrt": "CASE WHEN x >= 0 THEN sqrt(x) END",
    "exp": "exp(x)", "expm1": "exp(x) - 1", "log": "CASE WHEN x > 0 THEN ln(x) END", "log1p": "CASE WHEN x > -1 THEN ln(1 + x) END",
    "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "asin": "asin(x / (1 + abs(x)))", "acos": "acos(x / (1 + abs(x)))", "atan": "atan(x)",
    "sinh": "(exp(x) - exp(-x)) / 2", "cosh": "(exp(x) + exp(-x)) / 2", "tanh": "(exp(2 * x) - 1) / (exp(2 * x) + 1)", "negate": "-x", "reciprocal": "1 / x",
    "sign": "CAST(sign(x) AS DOUBLE)", "deg2rad": "radians(x)", "rad2deg": "degrees(x)", "as_int": "trunc(x)",
}


def _unary(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = embeddings(spark, sf_dir)
        if name in _UNIT:
            m = m.map(lambda x: x / (F.lit(1.0) + F.abs(x)))
        if name == "reciprocal":
            m = m.map(lambda x: x + F.lit(10.0))
        return cells(m.apply(name))

    return query


for _name in elementwise.UNARY:
    BOOK[f"vec_{_name}"] = (_unary(_name), _cell_sql(_UNARY_SQL[_name].replace("1 / x", "1 / (x + 10)")))


@BOOK.add("vec_log_base", _cell_sql("CASE WHEN x > 0 THEN ln(x) / ln(2) END"))
def vec_log_base(spark, sf_dir):
    return cells(embeddings(spark, sf_dir).map(lambda x: elementwise.log(x, 2)))


@BOOK.add("vec_round_2", _cell_sql("round(x, 2)"))
def vec_round_2(spark, sf_dir):
    return cells(embeddings(spark, sf_dir).apply("round", 2))


@BOOK.add("vec_clip", f"SELECT i, CAST(j AS BIGINT) AS j, round(greatest(-0.5, least(0.5, x)), 6) + 0.0 AS y, round(greatest(-0.1, x), 6) + 0.0 AS lower, round(least(0.1, x), 6) + 0.0 AS upper FROM {CELLS}")
def vec_clip(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    low = m.clip_lower(-0.1).cells().select("i", "j", tidy("x").alias("lower"))
    high = m.clip_upper(0.1).cells().select("i", "j", tidy("x").alias("upper"))
    both = m.clip(-0.5, 0.5).cells().select("i", "j", tidy("x").alias("y"))
    return both.join(low, ["i", "j"]).join(high, ["i", "j"]).withColumn("j", F.col("j").cast("long"))


@BOOK.add("vec_map", _cell_sql("x * 2 + 1"))
def vec_map(spark, sf_dir):
    return cells(embeddings(spark, sf_dir).map(lambda x: x * 2 + 1))


@BOOK.add("softmax", f"WITH e AS {CELLS}, m AS (SELECT i, j, exp(x - max(x) OVER (PARTITION BY i)) AS e FROM e) SELECT i, CAST(j AS BIGINT) AS j, round(e / sum(e) OVER (PARTITION BY i), 6) + 0.0 AS y FROM m")
def softmax(spark, sf_dir):
    return cells(embeddings(spark, sf_dir).softmax())


# -- two operands

_BINARY_SQL = {"add": "x + {}", "subtract": "x - {}", "multiply": "x * {}", "divide": "x / {}", "pow": "power(abs(x), {})", "mod": "x % {}"}


def _binary(name: str, kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = embeddings(spark, sf_dir)
        m = m.apply("abs") if name == "pow" else m
        other = {"scalar": lambda: 0.75, "matrix": lambda: embeddings(spark, sf_dir).map(lambda x: x * x + 1), "row": m.column_means, "column": m.row_sums}[kind]()
        return cells(m.binary(name, other))

    return query


for _name, _sql in _BINARY_SQL.items():
    BOOK[f"{_name}_scalar"] = (_binary(_name, "scalar"), _cell_sql(_sql.format("0.75::DOUBLE")))
    BOOK[f"{_name}_matrix"] = (_binary(_name, "matrix"), _cell_sql(_sql.format("(x * x + 1)")))
for _name in ("add", "subtract", "multiply"):
    _row = f"(SELECT i, j, x, avg(x) OVER (PARTITION BY j) AS w FROM {CELLS})"
    BOOK[f"{_name}_row_vector"] = (_binary(_name, "row"), _cell_sql(_BINARY_SQL[_name].format("w"), _row))
    _row = f"(SELECT i, j, x, sum(x) OVER (PARTITION BY i) AS w FROM {CELLS})"
    BOOK[f"{_name}_column_vector"] = (_binary(_name, "column"), _cell_sql(_BINARY_SQL[_name].format("w"), _row))

_COMPARE_SQL = {"equal": "=", "not_equal": "<>", "greater": ">", "greater_equal": ">=", "less": "<", "less_equal": "<="}


def _compare(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = embeddings(spark, sf_dir).apply("round", 1)
        by_scalar = cells(m.compare(name, 0.1))
        by_matrix = cells(m.compare(name, embeddings(spark, sf_dir).apply("round", 1).apply("abs"))).withColumnRenamed("y", "z")
        return by_scalar.join(by_matrix, ["i", "j"])

    return query


for _name, _op in _COMPARE_SQL.items():
    BOOK[f"cmp_{_name}"] = (
        _compare(_name),
        f"SELECT i, CAST(j AS BIGINT) AS j, CASE WHEN round(x, 1) {_op} 0.1::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, CASE WHEN round(x, 1) {_op} abs(round(x, 1)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS z FROM {CELLS}",
    )

# -- reductions


@BOOK.add("matrix_reductions", f"SELECT round(sum(x), 4) AS sum, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, count(*) AS size FROM {CELLS}")
def matrix_reductions(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    return m.reductions().select(F.round("sum", 4).alias("sum"), *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "variance")], F.lit(m.size()).cast("long").alias("size"))


@BOOK.add("matrix_product", f"SELECT i, round(product(1 + x / 100), 6) AS y FROM {CELLS} GROUP BY i")
def matrix_product(spark, sf_dir):
    return entries(embeddings(spark, sf_dir).map(lambda x: F.lit(1.0) + x / 100).rows(vectors.product))


def _values(spark, digits: int | dict[str, int], **values: float):
    """One row of the operators' own results, rounded."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in values.items()))
    places = lambda k: digits if isinstance(digits, int) else digits.get(k, 6)
    return row.select(*[F.col(k) if isinstance(v, int) else F.round(k, places(k)).alias(k) for k, v in values.items()])


@BOOK.add("matrix_median", f"SELECT round(median(x), 6) AS median, round(quantile_cont(x, 0.9), 6) AS q90, round(avg((x - 1) * (x - 1)), 6) AS about_one FROM {CELLS}")
def matrix_median(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    return _values(spark, 6, median=m.median(), q90=m.quantile(0.9), about_one=m.variance(1.0))


@BOOK.add("matrix_trace", f"SELECT round(sum(x * x), 4) AS trace FROM {CELLS}")
def matrix_trace(spark, sf_dir):
    """Of the Gram matrix, whose trace is the sum of all squares."""
    return _values(spark, 4, trace=embeddings(spark, sf_dir).gram().trace())


@BOOK.add("matrix_reduce", f"SELECT round(sum(x * power(0.5::DOUBLE, 63 - j)), 6) AS y, i FROM {CELLS} GROUP BY i")
def matrix_reduce(spark, sf_dir):
    return embeddings(spark, sf_dir).df.select(F.col("row_id").alias("i"), tidy(vectors.reduce_(F.col("v"), lambda a, x: a * 0.5 + x, F.lit(0.0))).alias("y"))


_ROW = {"row_sums": "sum(x)", "row_means": "avg(x)", "row_maxima": "max(x)", "row_minima": "min(x)"}
for _name, _sql in _ROW.items():
    BOOK[_name] = (lambda spark, sf_dir, n=_name: entries(getattr(embeddings(spark, sf_dir), n)()), f"SELECT i, {_R.format(_sql)} AS y FROM {CELLS} GROUP BY i")
    _col = _name.replace("row", "column")
    BOOK[_col] = (lambda spark, sf_dir, n=_col: entries(getattr(embeddings(spark, sf_dir), n)(), 4), f"SELECT CAST(j AS BIGINT) AS i, round({_sql}, 4) + 0.0 AS y FROM {CELLS} GROUP BY j")
_NORM = {"1": (1, "sum(abs(x))"), "2": (2, "sqrt(sum(x * x))"), "inf": (INF, "max(abs(x))"), "3": (3, "power(sum(power(abs(x), 3)), 1 / 3::DOUBLE)")}
for _name, (_p, _sql) in _NORM.items():
    BOOK[f"row_norms_{_name}"] = (lambda spark, sf_dir, p=_p: entries(embeddings(spark, sf_dir).row_norms(p), 5), f"SELECT i, round({_sql}, 5) AS y FROM {CELLS} GROUP BY i")
    BOOK[f"column_norms_{_name}"] = (lambda spark, sf_dir, p=_p: entries(embeddings(spark, sf_dir).column_norms(p), 5), f"SELECT CAST(j AS BIGINT) AS i, round({_sql}, 5) AS y FROM {CELLS} GROUP BY j")


@BOOK.add("row_statistics", f"SELECT i, round(median(x), 6) AS median, round(var_pop(x), 6) AS variance, round(quantile_cont(x, 0.25), 6) AS q25, CAST(arg_min(j, x) AS BIGINT) AS argmin, CAST(arg_max(j, x) AS BIGINT) AS argmax FROM {CELLS} GROUP BY i")
def row_statistics(spark, sf_dir):
    v = F.col("v")
    return embeddings(spark, sf_dir).df.select(F.col("row_id").alias("i"), F.round(vectors.median(v), 6).alias("median"), F.round(vectors.variance(v), 6).alias("variance"), F.round(vectors.quantile(v, 0.25), 6).alias("q25"), vectors.argmin(v).cast("long").alias("argmin"), vectors.argmax(v).cast("long").alias("argmax"))


_COL0 = "(SELECT i, x FROM " + CELLS + " WHERE j = 0)"


@BOOK.add("vector_reductions", f"SELECT round(sum(x), 5) AS sum, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(var_pop(x), 6) AS variance, round(sqrt(sum(x * x)), 5) AS norm2, round(sum(abs(x)), 5) AS norm1, round(max(abs(x)), 6) AS norm_inf, round(power(sum(power(abs(x), 3)), 1 / 3::DOUBLE), 5) AS norm3, CAST(arg_min(i, x) AS BIGINT) AS argmin, CAST(arg_max(i, x) AS BIGINT) AS argmax, round(quantile_cont(x, 0.1), 6) AS q10 FROM {_COL0}")
def vector_reductions(spark, sf_dir):
    v = embeddings(spark, sf_dir).column(0)
    digits = {"sum": 5, "norm2": 5, "norm1": 5, "norm3": 5}
    return _values(
        spark, digits, sum=v.sum(), mean=v.mean(), median=v.median(), variance=v.variance(), norm2=v.norm(), norm1=v.norm(1), norm_inf=v.norm(INF), norm3=v.norm(3), argmin=v.argmin(), argmax=v.argmax(), q10=v.quantile(0.1)
    )


# -- structure


@BOOK.add("row_as_vector", f"SELECT CAST(j AS BIGINT) AS i, round(x, 6) + 0.0 AS y FROM {CELLS} WHERE i = 3")
def row_as_vector(spark, sf_dir):
    return entries(embeddings(spark, sf_dir).row(3))


@BOOK.add("column_as_vector", f"SELECT i, round(x, 6) + 0.0 AS y FROM {CELLS} WHERE j = 5")
def column_as_vector(spark, sf_dir):
    return entries(embeddings(spark, sf_dir).column(5))


@BOOK.add("row_exclude", f"SELECT CASE WHEN i > 7 THEN i - 1 ELSE i END AS i, CAST(j AS BIGINT) AS j, round(x, 6) + 0.0 AS y FROM {CELLS} WHERE i <> 7")
def row_exclude(spark, sf_dir):
    return cells(embeddings(spark, sf_dir).drop_row(7))


@BOOK.add("column_exclude", f"SELECT i, CAST(CASE WHEN j > 7 THEN j - 1 ELSE j END AS BIGINT) AS j, round(x, 6) + 0.0 AS y FROM {CELLS} WHERE j <> 7")
def column_exclude(spark, sf_dir):
    return cells(embeddings(spark, sf_dir).drop_column(7))


@BOOK.add("matrix_diagonal", f"SELECT i, round(x, 6) + 0.0 AS y FROM {CELLS} WHERE i = j")
def matrix_diagonal(spark, sf_dir):
    return entries(embeddings(spark, sf_dir).diagonal())


@BOOK.add("transpose", f"SELECT CAST(j AS BIGINT) AS i, i AS j, round(x, 6) + 0.0 AS y FROM {CELLS}")
def transpose(spark, sf_dir):
    return cells(embeddings(spark, sf_dir).transpose())


@BOOK.add("flatten", f"SELECT i * 64 + j AS i, round(x, 6) + 0.0 AS y FROM {CELLS}")
def flatten(spark, sf_dir):
    return entries(embeddings(spark, sf_dir).flatten())


@BOOK.add("stack", f"WITH e AS {CELLS} SELECT i, CAST(j AS BIGINT) AS j, round(x, 6) + 0.0 AS y FROM e UNION ALL SELECT i + (SELECT count(*) FROM embeddings), j, round(x * x, 6) + 0.0 FROM e")
def stack(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    return cells(m.stack(m.apply("square")))


@BOOK.add("augment", f"WITH e AS {CELLS} SELECT i, CAST(j AS BIGINT) AS j, round(x, 6) + 0.0 AS y FROM e UNION ALL SELECT i, j + 64, round(x * x, 6) + 0.0 FROM e")
def augment(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    return cells(m.augment(m.apply("square")))


@BOOK.add("repeat", f"SELECT i + (SELECT count(*) FROM embeddings) * a AS i, CAST(j + 64 * b AS BIGINT) AS j, round(x, 6) + 0.0 AS y FROM {CELLS}, range(2) t(a), range(3) u(b)")
def repeat(spark, sf_dir):
    return cells(embeddings(spark, sf_dir).repeat(2, 3))


@BOOK.add("symmetric", "SELECT true AS gram, false AS oblong")
def symmetric(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    return spark.range(1).select(F.lit(m.gram().symmetric(1e-6)).alias("gram"), F.lit(m.symmetric()).alias("oblong"))


@BOOK.add("shape", "SELECT count(*) AS m, CAST(min(len(embedding)) AS BIGINT) AS n, count(*) = min(len(embedding)) AS square FROM embeddings")
def shape(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    return m.df.agg(F.count("*").alias("m"), F.min(F.size("v")).cast("long").alias("n"), (F.count("*") == F.min(F.size("v"))).alias("square"))


def _factory(make):
    return lambda spark, sf_dir: cells(make(spark))


_GRID = "(SELECT a AS i, b AS j FROM range(4) t(a), range(4) u(b))"
BOOK["factory_zeros"] = (_factory(lambda s: Matrix.zeros(s, 4, 4)), f"SELECT i, j, 0.0::DOUBLE AS y FROM {_GRID}")
BOOK["factory_ones"] = (_factory(lambda s: Matrix.ones(s, 4, 4)), f"SELECT i, j, 1.0::DOUBLE AS y FROM {_GRID}")
BOOK["factory_fill"] = (_factory(lambda s: Matrix.fill(s, 2.5, 4, 4)), f"SELECT i, j, 2.5::DOUBLE AS y FROM {_GRID}")
BOOK["factory_eye"] = (_factory(lambda s: Matrix.eye(s, 4)), f"SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM {_GRID}")
BOOK["factory_diagonal"] = (_factory(lambda s: Matrix.from_diagonal(s, [1, 2, 3, 4])), f"SELECT i, j, CASE WHEN i = j THEN (i + 1)::DOUBLE ELSE 0.0::DOUBLE END AS y FROM {_GRID}")
for _name in ("rand", "uniform", "gaussian", "poisson"):
    BOOK[f"random_{_name}"] = (lambda spark, sf_dir, n=_name: cells(getattr(Matrix, n)(spark, 50, 8, seed=3)), None)

# -- products


_WITH_GRAM = f"WITH e AS {CELLS}, g AS (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) / 1000 AS x FROM e a JOIN e b ON a.i = b.i GROUP BY a.j, b.j)"
_TIMES_GRAM = _WITH_GRAM + " SELECT e.i, CAST(g.j AS BIGINT) AS j, round(sum(e.x * g.x), 5) + 0.0 AS y FROM e JOIN g ON e.j = g.i GROUP BY e.i, g.j"


def _small_gram(m: Matrix) -> Matrix:
    return m.gram().map(lambda x: x / 1000)


@BOOK.add("matmul", _TIMES_GRAM)
def matmul(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    return cells(m.matmul(_small_gram(m)), 5)


@BOOK.add("matmul_join", _TIMES_GRAM)
def matmul_join(spark, sf_dir):
    """The same product as a join of cells, the way of large right sides."""
    m = embeddings(spark, sf_dir)
    other = _small_gram(m).cells().select(F.col("i").cast("int").alias("j"), F.col("j").alias("k"), F.col("x").alias("y"))
    made = m.cells().join(other, "j").groupBy("i", F.col("k").cast("long").alias("j")).agg(F.sum(F.col("x") * F.col("y")).alias("x"))
    return made.select("i", "j", tidy("x", 5).alias("y"))


@BOOK.add("matmul_gram", f"WITH e AS {CELLS} SELECT CAST(a.j AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, round(sum(a.x * b.x), 4) + 0.0 AS y FROM e a JOIN e b ON a.i = b.i GROUP BY a.j, b.j")
def matmul_gram(spark, sf_dir):
    return cells(embeddings(spark, sf_dir).gram(), 4)


@BOOK.add("matmul_chain", _WITH_GRAM + ", p AS (SELECT a.i, b.j, sum(a.x * b.x) AS x FROM g a JOIN g b ON a.j = b.i GROUP BY a.i, b.j) SELECT e.i, CAST(p.j AS BIGINT) AS j, round(sum(e.x * p.x), 4) + 0.0 AS y FROM e JOIN p ON e.j = p.i GROUP BY e.i, p.j")
def matmul_chain(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    g = _small_gram(m)
    return cells(chain(m, g, g), 4)


@BOOK.add("matvec", f"WITH e AS {CELLS}, w AS (SELECT j, avg(x) AS w FROM e GROUP BY j) SELECT i, round(sum(x * w), 6) + 0.0 AS y FROM e JOIN w USING (j) GROUP BY i")
def matvec(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    return entries(m.dot(m.column_means()))


@BOOK.add("dot", f"WITH e AS {CELLS} SELECT round(sum(a.x * b.x), 5) AS y FROM e a JOIN e b ON a.i = b.i WHERE a.j = 0 AND b.j = 1")
def dot(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    return _values(spark, 5, y=m.column(0).dot(m.column(1)))


@BOOK.add("outer", f"WITH e AS {CELLS}, c AS (SELECT j, avg(x) AS m, max(x) AS h FROM e GROUP BY j) SELECT CAST(a.j AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, round(a.m * b.h, 6) + 0.0 AS y FROM c a, c b")
def outer(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    return m.column_means().outer(m.column_maxima()).select("i", "j", tidy("x").alias("y"))


_PAIR = "(SELECT vec_id AS i, [CAST(x AS DOUBLE) FOR x IN embedding[1:3]] AS v, [CAST(x AS DOUBLE) FOR x IN embedding[4:6]] AS w FROM embeddings)"


def _pair(spark, sf_dir):
    d = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.slice(d, 1, 3).alias("v"), F.slice(d, 4, 3).alias("w"))


@BOOK.add("vector_cross", f"SELECT i, round(v[2] * w[3] - v[3] * w[2], 6) + 0.0 AS a, round(v[3] * w[1] - v[1] * w[3], 6) + 0.0 AS b, round(v[1] * w[2] - v[2] * w[1], 6) + 0.0 AS c FROM {_PAIR}")
def vector_cross(spark, sf_dir):
    p = _pair(spark, sf_dir).select("i", vectors.cross(F.col("v"), F.col("w")).alias("z"))
    return p.select("i", *[tidy(F.get("z", F.lit(k))).alias(n) for k, n in enumerate("abc")])


_D = "(v[1] * w[1] + v[2] * w[2] + v[3] * w[3]) / (w[1] * w[1] + w[2] * w[2] + w[3] * w[3])"


@BOOK.add("vector_project_reflect", f"SELECT i, round(w[1] * {_D}, 5) + 0.0 AS a, round(v[1] - 2 * w[1] * {_D}, 5) + 0.0 AS b, round(v[1] / sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]), 6) + 0.0 AS c FROM {_PAIR}")
def vector_project_reflect(spark, sf_dir):
    v, w = F.col("v"), F.col("w")
    first = lambda x, d: tidy(F.get(x, F.lit(0)), d)
    return _pair(spark, sf_dir).select("i", first(vectors.project(v, w), 5).alias("a"), first(vectors.reflect(v, w), 5).alias("b"), first(vectors.normalize(v), 6).alias("c"))


@BOOK.add("convolve_rows", f"WITH e AS {CELLS}, c AS (SELECT i, j, 0.25 * x + 0.5 * lead(x, 1) OVER w + 0.25 * lead(x, 2) OVER w AS y FROM e WINDOW w AS (PARTITION BY i ORDER BY j)) SELECT i, CAST(j // 2 AS BIGINT) AS j, round(y, 6) + 0.0 AS y FROM c WHERE j % 2 = 0 AND y IS NOT NULL")
def convolve_rows(spark, sf_dir):
    m = embeddings(spark, sf_dir)
    return cells(Matrix(m.df.select("row_id", vectors.convolve(F.col("v"), [0.25, 0.5, 0.25], 2).alias("v"))))


@BOOK.add("convolve1d", f"WITH c AS (SELECT i, 0.5 * x - x1 + 0.25 * x2 AS y FROM (SELECT i, x, lead(x, 1) OVER (ORDER BY i) AS x1, lead(x, 2) OVER (ORDER BY i) AS x2 FROM {_COL0})) SELECT i // 3 AS i, round(y, 6) + 0.0 AS y FROM c WHERE i % 3 = 0 AND y IS NOT NULL")
def convolve1d(spark, sf_dir):
    return entries(Vector(embeddings(spark, sf_dir).column(0).df).convolve([0.5, -1.0, 0.25], 3))


@BOOK.add("convolve2d", f"WITH e AS {CELLS}, k AS (SELECT * FROM (VALUES (0, 0, 1.0::DOUBLE), (0, 1, 0.5), (0, 2, -1.0), (1, 0, 0.25), (1, 1, 2.0), (1, 2, -0.5)) t(a, b, w)), n AS (SELECT max(i) AS m FROM e) SELECT CAST((i - a) // 2 AS BIGINT) AS i, CAST((j - b) // 2 AS BIGINT) AS j, round(sum(x * w), 5) + 0.0 AS y FROM e, k, n WHERE i >= a AND j >= b AND (i - a) % 2 = 0 AND (j - b) % 2 = 0 AND i - a <= m - 1 AND j - b <= 61 GROUP BY ALL")
def convolve2d(spark, sf_dir):
    return cells(embeddings(spark, sf_dir).convolve([[1.0, 0.5, -1.0], [0.25, 2.0, -0.5]], 2), 5)


# -- linear algebra on the 3 x 3 Gram matrix of three sums of an embedding's components (each third one)

_G = f"""WITH e AS (SELECT i, sum(x) FILTER (WHERE j % 3 = 0) AS x, sum(x) FILTER (WHERE j % 3 = 1) AS y, sum(x) FILTER (WHERE j % 3 = 2) AS z FROM {CELLS} GROUP BY i),
g AS (SELECT sum(x * x) / 1000 AS a, sum(x * y) / 1000 AS b, sum(x * z) / 1000 AS c, sum(y * y) / 1000 AS d, sum(y * z) / 1000 AS e, sum(z * z) / 1000 AS f FROM e),
h AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM g)"""


def _gram3(spark, sf_dir) -> np.ndarray:
    m = embeddings(spark, sf_dir)
    return m.times((np.arange(m.n)[:, None] % 3 == np.arange(3)).astype(float)).gram().local() / 1000


def _rows(spark, values: np.ndarray, digits: int = 5) -> DataFrame:
    values = np.atleast_2d(values)
    return spark.createDataFrame([(i, j, float(np.round(values[i, j], digits) + 0.0)) for i in range(values.shape[0]) for j in range(values.shape[1])], "i long, j long, y double")


def _matrix_sql(entries_: list[list[str]], digits: int = 5, more: str = "", source: str = "h") -> str:
    return _G + more + " " + " UNION ALL ".join(f"SELECT {i}::BIGINT AS i, {j}::BIGINT AS j, round({x}, {digits}) + 0.0 AS y FROM {source}" for i, r in enumerate(entries_) for j, x in enumerate(r))


_A = [["a", "b", "c"], ["b", "d", "e"], ["c", "e", "f"]]
_INVERSE = [["(d * f - e * e) / det", "(c * e - b * f) / det", "(b * e - c * d) / det"], ["(c * e - b * f) / det", "(a * f - c * c) / det", "(b * c - a * e) / det"], ["(b * e - c * d) / det", "(b * c - a * e) / det", "(a * d - b * b) / det"]]
_SOLVED = ["(" + " + 2 * ".join(r[:2]) + " + 3 * " + r[2] + ")" for r in _INVERSE]
_RIGHT = np.array([[1.0], [2.0], [3.0]])
BOOK["linalg_det"] = (lambda s, d: _rows(s, np.array([[linalg.det(_gram3(s, d))]]), 3), _matrix_sql([["det"]], 3))
BOOK["linalg_inverse"] = (lambda s, d: _rows(s, linalg.inverse(_gram3(s, d))), _matrix_sql(_INVERSE))
BOOK["linalg_pseudoinverse"] = (lambda s, d: _rows(s, linalg.pseudoinverse(_gram3(s, d))), _matrix_sql(_INVERSE))
BOOK["linalg_solve"] = (lambda s, d: _rows(s, linalg.solve(_gram3(s, d), _RIGHT)), _matrix_sql([[x] for x in _SOLVED]))
_L = [["sqrt(a)", "0.0::DOUBLE", "0.0::DOUBLE"], ["b / sqrt(a)", "sqrt(d - b * b / a)", "0.0::DOUBLE"], ["c / sqrt(a)", "(e - b * c / a) / sqrt(d - b * b / a)", "sqrt(det / (a * d - b * b))"]]
BOOK["linalg_cholesky"] = (lambda s, d: _rows(s, linalg.cholesky(_gram3(s, d))), _matrix_sql(_L))
BOOK["linalg_rank"] = (lambda s, d: _rows(s, np.array([[linalg.rank(_gram3(s, d))]]), 0), _matrix_sql([["CASE WHEN abs(det) > 1e-10 THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END"]], 0))
# Of the matrix beside a right side: the identity beside the solution.
BOOK["linalg_rref"] = (
    lambda s, d: _rows(s, linalg.rref(np.hstack([_gram3(s, d), _RIGHT]))),
    _matrix_sql([["1.0::DOUBLE" if i == j else "0.0::DOUBLE" for j in range(3)] + [_SOLVED[i]] for i in range(3)]),
)

# Elimination: p, q, t are the rows in the order in which they become pivots.
_ELIMINATION = """, m AS (SELECT 0 AS k, a AS c0, b AS c1, c AS c2 FROM g UNION ALL SELECT 1, b, d, e FROM g UNION ALL SELECT 2, c, e, f FROM g),
p AS (SELECT * FROM m ORDER BY abs(c0) DESC, k LIMIT 1),
s AS (SELECT m.k, m.c0 / p.c0 AS l0, m.c1 - m.c0 / p.c0 * p.c1 AS c1, m.c2 - m.c0 / p.c0 * p.c2 AS c2 FROM m, p WHERE m.k <> p.k),
q AS (SELECT * FROM s ORDER BY abs(c1) DESC, k LIMIT 1),
t AS (SELECT s.k, s.l0, s.c1 / q.c1 AS l1, s.c2 - s.c1 / q.c1 * q.c2 AS c2 FROM s, q WHERE s.k <> q.k)"""
_ZERO = "0.0::DOUBLE"
_U = [["p.c0", "p.c1", "p.c2"], [_ZERO, "q.c1", "q.c2"], [_ZERO, _ZERO, "t.c2"]]


def _lu(a: np.ndarray) -> np.ndarray:
    """L without its diagonal and U in one, and the rows' order below."""
    x = linalg.lu(a)
    return np.vstack([x["L"] - np.eye(3) + x["U"], x["P"].argmax(axis=1)])


def _ref(a: np.ndarray) -> np.ndarray:
    u, swaps = linalg.ref(a)
    return np.vstack([u, [swaps, 0, 0]])


def _qr(a: np.ndarray) -> np.ndarray:
    q, r = linalg.qr(a)
    return np.vstack([r, q])


def _svd(a: np.ndarray) -> np.ndarray:
    """Singular values, and below them the product of the parts."""
    x = linalg.svd(a)
    return np.vstack([x["s"], x["U"] @ np.diag(x["s"]) @ x["VT"]])


def _eig_symmetric(a: np.ndarray) -> np.ndarray:
    x = linalg.eig(a, True)
    return np.vstack([x["values"], x["vectors"] @ np.diag(x["values"]) @ x["vectors"].T])


def _eig_general(a: np.ndarray) -> np.ndarray:
    """Of the matrix with its rows times 1, 2 and 3: the symmetric functions of the values, and their imaginary parts."""
    x = linalg.eig(np.diag([1.0, 2.0, 3.0]) @ a)
    v = x["values"]
    return np.vstack([[v.sum(), v[0] * v[1] + v[0] * v[2] + v[1] * v[2], v.prod()], x["values_imag"]])


# R is the Cholesky factor of A'A, and Q follows from it column by column.
_QR = """, n AS (SELECT *, a * a + b * b + c * c AS aa, a * b + b * d + c * e AS ab, a * c + b * e + c * f AS ac, b * b + d * d + e * e AS bb, b * c + d * e + e * f AS bc FROM h),
r AS (SELECT *, sqrt(aa) AS r00, ab / sqrt(aa) AS r01, ac / sqrt(aa) AS r02, sqrt(bb - ab * ab / aa) AS r11, (bc - ab * ac / aa) / sqrt(bb - ab * ab / aa) AS r12, abs(det) / sqrt(aa * bb - ab * ab) AS r22 FROM n),
u AS (SELECT *, a / r00 AS q00, b / r00 AS q10, c / r00 AS q20 FROM r),
v AS (SELECT *, (b - r01 * q00) / r11 AS q01, (d - r01 * q10) / r11 AS q11, (e - r01 * q20) / r11 AS q21 FROM u),
w AS (SELECT *, (c - r02 * q00 - r12 * q01) / r22 AS q02, (e - r02 * q10 - r12 * q11) / r22 AS q12, (f - r02 * q20 - r12 * q21) / r22 AS q22 FROM v)"""
# The values of a symmetric 3 x 3 matrix by the trigonometric solution of its cubic.
_VALUES = """, k AS (SELECT *, (a + d + f) / 3 AS q, sqrt(((a - (a + d + f) / 3) ** 2 + (d - (a + d + f) / 3) ** 2 + (f - (a + d + f) / 3) ** 2 + 2 * (b * b + c * c + e * e)) / 6) AS p FROM h),
o AS (SELECT *, acos(greatest(-1.0, least(1.0, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - c * e) + c * (b * e - c * (d - q))) / (2 * p * p * p)))) / 3 AS phi FROM k),
x AS (SELECT *, q + 2 * p * cos(phi) AS v1, q + 2 * p * cos(phi + 2 * pi() / 3) AS v3, 3 * q - (q + 2 * p * cos(phi)) - (q + 2 * p * cos(phi + 2 * pi() / 3)) AS v2 FROM o)"""
_FALLING, _RISING = ["v1", "v2", "v3"], ["v3", "v2", "v1"]


def _of_gram(make, digits: int = 5):
    return lambda spark, sf_dir: _rows(spark, make(_gram3(spark, sf_dir)), digits)


BOOK["linalg_lu"] = (_of_gram(_lu), _matrix_sql([_U[0], ["q.l0", *_U[1][1:]], ["t.l0", "t.l1", "t.c2"], ["p.k::DOUBLE", "q.k::DOUBLE", "t.k::DOUBLE"]], 5, _ELIMINATION, "p, q, t"))
_SWAPS = "(CASE WHEN p.k <> 0 THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN q.k <> CASE WHEN p.k = 1 THEN 0 ELSE 1 END THEN 1.0::DOUBLE ELSE 0 END)"
BOOK["linalg_ref"] = (_of_gram(_ref), _matrix_sql([*_U, [_SWAPS, _ZERO, _ZERO]], 5, _ELIMINATION, "p, q, t"))
BOOK["linalg_qr"] = (_of_gram(_qr), _matrix_sql([["r00", "r01", "r02"], [_ZERO, "r11", "r12"], [_ZERO, _ZERO, "r22"], *[[f"q{i}{j}" for j in range(3)] for i in range(3)]], 5, _QR, "w"))
BOOK["linalg_svd"] = (_of_gram(_svd), _matrix_sql([_FALLING, *_A], 5, _VALUES, "x"))
BOOK["linalg_eig_symmetric"] = (_of_gram(_eig_symmetric), _matrix_sql([_RISING, *_A], 5, _VALUES, "x"))
BOOK["linalg_eig_general"] = (_of_gram(_eig_general, 3), _matrix_sql([["a + 2 * d + 3 * f", "2 * (a * d - b * b) + 3 * (a * f - c * c) + 6 * (d * f - e * e)", "6 * det"], [_ZERO] * 3], 3))
BOOK["linalg_eigenvalues"] = (_of_gram(lambda a: linalg.eig(a, True)["values"]), _matrix_sql([_RISING], 5, _VALUES, "x"))
BOOK["linalg_singular_values"] = (_of_gram(lambda a: linalg.svd(a)["s"]), _matrix_sql([_FALLING], 5, _VALUES, "x"))
# By the signs of the leading minors; the third matrix is the first less its mean diagonal.
BOOK["linalg_definite"] = (
    lambda s, d: (lambda g: s.range(1).select(F.lit(linalg.positive_definite(g)).alias("definite"), F.lit(linalg.positive_semidefinite(g)).alias("semidefinite"), F.lit(linalg.positive_definite(-g)).alias("negated"), F.lit(linalg.positive_semidefinite(g - np.eye(3) * np.trace(g) / 3)).alias("shifted")))(_gram3(s, d)),
    _G + _VALUES + " SELECT a > 0 AND a * d - b * b > 0 AND det > 0 AS definite, v3 >= 0 AS semidefinite, a < 0 AND a * d - b * b > 0 AND det < 0 AS negated, v3 - q >= 0 AS shifted FROM x",
)


@BOOK.add("truncated_svd", f"WITH e AS {CELLS}, g AS (SELECT sum(a.x * b.x) / 1000 AS x FROM e a JOIN e b ON a.i = b.i GROUP BY a.j, b.j) SELECT 0::BIGINT AS i, 0::BIGINT AS j, round((SELECT sum(x * x) / 1000 FROM e), 4) AS y UNION ALL SELECT 0, 1, round((SELECT sum(x * x) FROM g), 4)")
def truncated_svd(spark, sf_dir):
    """Of all singular values the sums of squares and of fourth powers, which are those of the matrix and its Gram matrix."""
    m = embeddings(spark, sf_dir)
    s, _ = linalg.truncated_svd(m, m.n)
    return _rows(spark, np.array([(s**2).sum() / 1e3, (s**4).sum() / 1e6]), 4)


@BOOK.add("least_squares", "SELECT 0::BIGINT AS i, 0::BIGINT AS j, round(regr_intercept(l_extendedprice, l_quantity), 3) + 0.0 AS y FROM lineitem UNION ALL SELECT 0, 1, round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem")
def least_squares(spark, sf_dir):
    """Intercept and slope of the price on the quantity."""
    rows = with_row_index(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y")))
    x = Matrix(rows.select(F.col("row_idx").alias("row_id"), F.array(F.lit(1.0), "x").alias("v")), n=2)
    return _rows(spark, linalg.least_squares(x, rows.select(F.col("row_idx").alias("row_id"), "y")), 3)


@BOOK.add("batched_det", "SELECT vec_id AS i, round(CAST(embedding[1] AS DOUBLE) * embedding[4]::DOUBLE - embedding[2]::DOUBLE * embedding[3]::DOUBLE, 6) + 0.0 AS y FROM embeddings")
def batched_det(spark, sf_dir):
    d = F.col("embedding").cast("array<double>")
    small = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.array(F.slice(d, 1, 2), F.slice(d, 3, 2)).alias("m"))
    return linalg.batched(small, _det_row, "i long, y double").select("i", tidy("y").alias("y"))


def _det_row(i, m):
    return [(i, float(m[0, 0] * m[1, 1] - m[0, 1] * m[1, 0]))]
