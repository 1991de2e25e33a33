"""Best-fit packing of tokenized documents into sequences, by vector best-fit.

Every open bin has a residual vector (tokens, documents, attention cost); a piece is the vector (its tokens, 1,
its tokens squared). A piece goes, in order of falling length, to an admissible bin (each residual component
is at least the piece's) chosen either by the smallest weighted norm of what would be left or by the largest
weighted dot product of piece and residual; with none, it opens a bin. Pieces are packed in groups of about
GROUP pieces, so no task's work grows with the corpus and each group leaves at most a few bins part-filled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Pieces of a packing group.
GROUP = 8_000


@dataclass(frozen=True)
class Capacity:
    """A sequence's capacities and the weights of their components (each divided by its capacity)."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    choose: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.float64)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; pieces are taken by falling length, equal ones in their order."""
    full, weights = capacity.vector(), np.asarray(capacity.weights)
    scale = np.sqrt(weights) / full
    if capacity.choose not in ("norm", "dot"):
        raise ValueError(f"choose is norm or dot, not {capacity.choose}")
    if len(lengths) and (int(lengths.max()) > capacity.tokens or int(lengths.max()) ** 2 > capacity.attention or capacity.documents < 1):
        raise ValueError("a piece is larger than an empty sequence")
    residual = np.empty((max(16, len(lengths)), 3))
    names = np.empty(len(residual), np.int64)  # of open bins
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n_open, n_bins, smallest = 0, 0, int(lengths.min()) if len(lengths) else 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        item = np.array([n, 1, n * n], np.float64)
        left = residual[:n_open] - item
        fits = np.flatnonzero((left >= 0).all(axis=1))
        if len(fits):
            if capacity.choose == "norm":
                at = int(fits[np.argmin(((left[fits] * scale) ** 2).sum(axis=1))])
            else:
                at = int(fits[np.argmax((residual[fits] * scale * (item * scale)).sum(axis=1))])
            residual[at] -= item
        else:
            at = n_open
            residual[at] = full - item
            names[at] = n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i] = names[at]
        offsets[i] = capacity.tokens - residual[at, 0] - n
        if residual[at, 0] < smallest or residual[at, 1] < 1 or residual[at, 2] < smallest * smallest:
            n_open -= 1  # nothing fits any more: the last open bin takes its place
            residual[at], names[at] = residual[n_open], names[n_open]
    return bins, offsets


def cut(n_ids: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first is the remainder, the others are full."""
    first = n_ids % most or min(n_ids, most)
    return [(0, first), *((start, most) for start in range(first, n_ids, most))]


def tokenize_pieces(docs: DataFrame, model: str, most: int, end_id: int = 0) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, _salt (a number to group by)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _salt long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.worker_encoder(sent.value, False)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch), strict=True):
                ids = encoder.ids(text) + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, most)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + n)])
                    out.append((doc_id, k, start, n, crc, crc))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "_salt"])

    return common.map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), pieces, schema)


def pack(docs: DataFrame, model_path: str | None = None, capacity: Capacity | None = None, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Rows with equal or null ids are packed each for itself, repeated ones
    too. Only a document longer than a sequence, however long, is cut; its first piece may be shorter. Full pieces
    fill a sequence each. Of equally long pieces the one of smaller check sum (then id and start) goes first. Other
    columns are not read, whatever their names. An empty table gives an empty result.
    """
    capacity = capacity or Capacity()
    model = tokens.read_model(model_path or tokens.default_path())
    most = min(capacity.tokens, int(capacity.attention**0.5))
    pieces = common.materialise(tokenize_pieces(docs, model, most, end_id))
    n_groups = max(1, -(-pieces.where(F.col("length") < most).count() // group))
    # A copy's pieces have the same check sums; ids and starts keep copies from meeting in one group.
    which = F.pmod(F.xxhash64("_salt", "doc_id", "start"), F.lit(n_groups))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.sorted_groups(batches, ["_group"]):
            bins, offsets = best_fit(rows.column("length").to_numpy(), capacity)
            names = bins + (rows.column("_group")[0].as_py() << 32)
            kept = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(names, pa.int64()))
            yield from kept.append_column("offset", pa.array(offsets, pa.int64())).to_batches()

    part = pieces.where(F.col("length") < most).select("doc_id", "piece", "start", "length", "ids_crc32", which.alias("_group"))
    part = part.repartition("_group").sortWithinPartitions("_group", "length", "ids_crc32", "doc_id", "start")
    packed = part.mapInArrow(fill, schema)
    # Full pieces: numbers below zero are never a group's.
    full = pieces.where(F.col("length") == most).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
