"""Streams of rows through fitted pipelines and windowed summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.tuning import Pipeline


def score_stream(rows: DataFrame, pipeline: Pipeline, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Predictions for each batch of a stream are appended to a Parquet table; the checkpoint makes a restart safe.

    A batch is written under its own number, so a batch that runs again after a failure replaces itself.
    """

    def one(batch: DataFrame, number: int) -> None:
        pipeline.transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_summary(rows: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "2 hours", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, min, max and population deviation of a value by tumbling window; later rows than `late` are left out."""
    v = F.col(f"`{value}`").cast("double")
    marked = rows.withWatermark(time, late) if rows.isStreaming else rows
    return marked.groupBy(F.window(F.col(time), width).alias("w"), *by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std")).select(F.col("w.start").alias("start"), *by, "n", "mean", "min", "max", "std")
