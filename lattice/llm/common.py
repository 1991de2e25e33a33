"""What the operators of this subpackage share: shared-folder tables, Arrow group iteration, words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import map_arrow, materialise

__all__ = ["map_rows", "materialise"]

#: Rows and bytes of an Arrow batch sent to Python; with long texts a larger batch would not fit a worker.
ARROW_ROWS, ARROW_BYTES = 1024, 32 << 20

#: Bytes to lower-case ASCII letters and digits; every other ASCII byte becomes a blank, others stay.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of an Arrow batch, as texts may be long; Spark has these settings for a whole session only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def space_words(text: str) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def plain_bytes(text: str) -> bytes:
    """The text with A-Z lower-cased and every other ASCII byte but letters and digits a blank."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE)


def plain_words(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return plain_bytes(text).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over an unsigned array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_key(*extra: str) -> list:
    """Columns that tell rows of documents apart where doc_id is null or repeated: the id and the text's hash."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), *extra]


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows that agree in integer keys, from batches in which such rows follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        first = tuple(int(c[0]) for c in columns)
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts, starts[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(int(c[-1]) for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def map_rows(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return map_arrow(df, function, schema)


class Cache(dict):
    """Values of words or pre-tokens, worked out by value(key). Keys of more than LONG are not kept; at LIMIT entries it starts anew.

    So it holds at most LIMIT * (LONG + about 150) bytes, whatever the texts.
    """

    LIMIT, LONG = 300_000, 64

    def value(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.value(key)
        if len(key) <= self.LONG:
            if len(self) >= self.LIMIT:
                self.clear()
            self[key] = value
        return value


class WordHashes(Cache):
    """Stable 64-bit hashes of words (bytes)."""

    def value(self, key: bytes) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(key)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
