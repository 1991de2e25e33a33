"""What query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import Matrix

Query = Callable[[SparkSession, str], DataFrame]
#: The embeddings as cells in SQL: i, j, x.
CELLS = "(SELECT vec_id AS i, generate_subscripts(embedding, 1) - 1 AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


class Book(dict):
    """name -> (query, SQL or None)."""

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(query: Query) -> Query:
            self[name] = (query, sql)
            return query

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> Matrix:
    return Matrix.from_table(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def tidy(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero; NaN is null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.isnan(x), None).otherwise(F.round(x, digits) + F.lit(0.0))


def cells(m: Matrix, digits: int = 6) -> DataFrame:
    return m.cells().select("i", F.col("j").cast("long").alias("j"), tidy("x", digits).alias("y"))


def entries(v, digits: int = 6) -> DataFrame:
    return v.df.select("i", tidy("x", digits).alias("y"))
