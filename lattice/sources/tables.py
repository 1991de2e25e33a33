"""Scans and sinks of record tables."""

from __future__ import annotations

import os
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 100 * 1024 * 1024


def check_upload(path: str, size: int | None = None, max_bytes: int = MAX_BYTES) -> str:
    """The format of a file to be taken in, csv or json; else ValueError. Larger limits suit a cluster."""
    kind = PurePosixPath(path).suffix.lower().lstrip(".")
    if kind == "txt":
        kind = "csv"
    if kind not in ("csv", "json"):
        raise ValueError(f"only CSV and JSON files are taken, not {path}")
    if (size if size is not None else os.path.getsize(path)) > max_bytes:
        raise ValueError(f"{path} is larger than {max_bytes} bytes")
    return kind


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """df with the rows' places from 0 in file order (file, block, line), without a shuffle of the rows.

    One counting job over the input's blocks; a row's place is its block's offset and its place in the block.
    Tables not read from files are indexed in partition order.
    """
    try:
        df.select("_metadata.file_path")
        block = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")]
    except Exception:  # noqa: BLE001  any analysis error: no file source below
        block = [F.lit("").alias("_f"), F.spark_partition_id().cast("long").alias("_b")]
    marked = df.select("*", *block, F.monotonically_increasing_id().alias("_m"))
    blocks = marked.groupBy("_f", "_b").agg(F.count("*").alias("n"), F.min("_m").alias("first")).orderBy("_f", "_b").collect()
    offsets, at = [], 0
    for r in blocks:  # a row for each block of the input
        offsets.append((r._f, r._b, at - r.first))
        at += r.n
    shift = df.sparkSession.createDataFrame(offsets, "_f string, _b long, _o long")
    placed = marked.join(F.broadcast(shift), ["_f", "_b"]).withColumn(name, F.col("_m") + F.col("_o"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], name)


def read_csv(spark: SparkSession, path: str, row_index: bool = True) -> DataFrame:
    """A headed CSV file, all columns as text, blank cells as ''."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    df = with_row_index(df) if row_index else df
    return df.na.fill("")  # a CSV file tells no blank cell from a null one


def read_json(spark: SparkSession, path: str, row_index: bool = True) -> DataFrame:
    """A file of JSON rows; scalars as text, as in CSV."""
    df = spark.read.option("primitivesAsString", True).json(path)
    return with_row_index(df) if row_index else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def labeled_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV file whose last column is the label."""
    df = read_csv(spark, path)
    names = [c for c in df.columns if c != "row_idx"]
    return df.select("row_idx", *[F.col(f"`{c}`") for c in names[:-1]], F.col(f"`{names[-1]}`").alias("label"))


def from_rows(spark: SparkSession, rows: list, names: list[str] | None = None) -> DataFrame:
    """Literal rows (lists, or dicts by position) as text columns with a row index."""
    if rows and isinstance(rows[0], dict):
        names = names or list(rows[0])
        rows = [[r.get(n) for n in names] for r in rows]
    names = names or [f"c{i}" for i in range(len(rows[0]) if rows else 0)]
    if any(len(r) != len(names) for r in rows):
        raise ValueError("rows differ in length")
    schema = T.StructType([T.StructField("row_idx", T.LongType()), *[T.StructField(n, T.StringType()) for n in names]])
    return spark.createDataFrame([(i, *[None if x is None else str(x) for x in r]) for i, r in enumerate(rows)], schema)


def sample(df: DataFrame, n: int = 50, by: str = "row_idx") -> DataFrame:
    """The first n rows."""
    return df.orderBy(by).limit(n)


def as_text(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The named columns (or all) as text."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names or df.columns])


def row_json(df: DataFrame, name: str = "json") -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name)


def append(df: DataFrame, path: str) -> None:
    """The prediction log: rows are added, never replaced."""
    df.write.mode("append").parquet(path)
