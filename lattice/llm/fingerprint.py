"""Document fingerprints from improbable byte windows.

Every window of WIDTH bytes has an entropy; over all documents, the commoner an entropy level is, the less a
window of that level tells. A window is a feature if its level is the rarest within REACH windows on both sides;
among equal levels the window of least hash counts as the rarest (then the first). A text shorter than a window
is one window. This holds for texts of every length. Features go, in order, into a chain of Bloom filters of BITS
bits, PER_FILTER in each. Two fingerprints are compared filter by filter: the bits they share beyond those
expected by chance, over the most that could be shared, the best match for each filter of the shorter chain,
averaged by bits.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH, REACH = 16, 8
BITS, PER_FILTER, HASHES = 2048, 128, 4
LEVELS = 512
#: Bytes that are looked at together, and characters of a range of documents.
BLOCK, RANGE_CHARS = 1 << 18, 2_000_000
#: Ranges at most: more documents make longer ranges, which are sorted and streamed, not held.
MOST_RANGES = 20_000

_N = np.arange(WIDTH + 1)
_F = np.rint(_N * np.log2(np.maximum(_N, 1)) * 1024).astype(np.int32)
#: What a byte adds to the sum of n log2 n over a window's bytes when the others hold it n times already.
_GAIN = np.concatenate([np.diff(_F), np.zeros(256 - WIDTH, np.int32)]).astype(np.int32)
_TOP = int(_F[WIDTH])


def levels(data: np.ndarray) -> np.ndarray:
    """The entropy level (0: one byte only, LEVELS - 1: all differ) of each window of the bytes."""
    n = len(data)
    if n < WIDTH:
        return np.empty(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for t in range(1, WIDTH):
        same = (data[t:] == data[:-t]).view(np.uint8)
        before[t:] += same
        after[:-t] += same
    total = np.empty(n - WIDTH + 1, np.int32)
    total[0] = _F[np.bincount(data[:WIDTH], minlength=256)].sum()
    np.cumsum(_GAIN[before[WIDTH:]] - _GAIN[after[: n - WIDTH]], out=total[1:])
    total[1:] += total[0]
    return (_TOP - total).astype(np.int64) * (LEVELS - 1) // _TOP


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of x[i : i + n] (n a power of two), for each i that has n."""
    width = 1
    while width < n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x


def block_features(parts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The features (64-bit hashes, in order) of each text of a block; rank: rarity of each level, 0 the rarest."""
    joined = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    if len(joined) < WIDTH:
        return [_whole(p) for p in parts]
    of_windows = np.lib.stride_tricks.sliding_window_view(joined, WIDTH)
    h = np.zeros(len(of_windows), np.uint64)
    for j in range(0, WIDTH, 8):
        h = common.mix(h ^ (np.ascontiguousarray(of_windows[:, j : j + 8]).view(np.uint64)[:, 0] + np.uint64(0x9E3779B97F4A7C15)))
    worst = np.iinfo(np.uint64).max
    value = (rank[levels(joined)].astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    for e in ends[:-1].tolist():  # windows across texts
        value[max(0, e - WIDTH + 1) : e] = worst
    # Texts shorter than a window have none, so every window that is left lies within one text; a window's
    # neighbours in another text count as worst only within WIDTH - 1 >= REACH places, which is all that is seen.
    fill = np.full(REACH, worst, np.uint64)
    low = _sliding_min(np.concatenate([fill, value, fill]), REACH)
    picked = np.flatnonzero((value < worst) & (value < low[: len(value)]) & (value <= low[REACH + 1 : REACH + 1 + len(value)]))
    h = h[picked]
    cuts = np.searchsorted(picked, np.concatenate([starts, [ends[-1]]]))
    return [h[cuts[k] : cuts[k + 1]] if len(p) >= WIDTH else _whole(p) for k, p in enumerate(parts)]


def _whole(text: bytes) -> np.ndarray:
    """The one feature of a text shorter than a window; an empty one has none."""
    return np.frombuffer(hashlib.blake2b(text, digest_size=8).digest() if text else b"", np.uint64)


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= BLOCK:
            out += block_features(part, rank)
            part, size = [], 0
    return out + (block_features(part, rank) if part else [])


def chain(found: np.ndarray) -> np.ndarray:
    """(filters, BITS / 8) bytes of the chained Bloom filters."""
    n = -(-len(found) // PER_FILTER)
    bits = np.zeros((n, BITS), np.uint8)
    rows = np.arange(len(found)) // PER_FILTER
    step = BITS.bit_length() - 1
    for k in range(HASHES):
        bits[rows, ((found >> np.uint64(k * step)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def encode(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for equal fingerprints, two empty ones among them."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    of_b = np.bitwise_count(b).sum(axis=1).astype(np.float64)
    total = weight = 0.0
    for f in a:
        own = float(np.bitwise_count(f).sum())
        shared = np.bitwise_count(b & f).sum(axis=1)
        chance = own * of_b / BITS
        most = np.minimum(own, of_b)
        total += own * float(np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
        weight += own
    return round(total / weight, 6)


def level_ranks(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy level by how many windows of all documents have it, rarest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(LEVELS, np.int64)
        for batch in batches:
            part, size = [], 0
            rows = [t.encode("utf-8", "surrogatepass") for t in common.texts(batch)]
            for k, t in enumerate(rows):
                part.append(t)
                size += len(t)
                if size < BLOCK and k < len(rows) - 1:
                    continue
                found = levels(np.frombuffer(b"".join(part), np.uint8))
                inside = np.ones(len(found), bool)
                for e in np.cumsum([len(p) for p in part])[:-1].tolist():
                    inside[max(0, e - WIDTH + 1) : e] = False
                seen += np.bincount(found[inside], minlength=LEVELS)
                part, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(seen)], ["level", "n"])

    rows = common.map_rows(docs.select("text"), count, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(LEVELS, np.int64)
    for r in rows:  # as many as there are levels
        counts[r.level] = r.n
    rank = np.empty(LEVELS, np.int64)
    rank[np.lexsort((np.arange(LEVELS), counts))] = np.arange(LEVELS)
    return rank


def _range_of(cuts: list[int], key: Column) -> Column:
    """How many cuts (sorted) are at or below the key, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    at = F.array(*[F.lit(c).cast("long") for c in cuts])

    def step(low: Column, s: Column) -> Column:
        here = low + s
        return F.when((here <= len(cuts)) & (F.get(at, here - F.lit(1)) <= key), here).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def with_next(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """docs (doc_id, text) dealt into ranges of ids: _range, _extra, sorted so that the next document follows.

    Within a range, documents stand by falling id; after them, marked _extra, stands the first document of the
    next lower range (after the last range: of the highest). Rows without an id come last, by falling text hash,
    in ranges of text hashes.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *common.row_key())
    size = F.coalesce(F.sum(F.length("text")), F.lit(0))
    chars = {r.without: r.n for r in keyed.groupBy(F.col("doc_id").isNull().alias("without")).agg(size.alias("n")).collect()}  # two rows

    def cuts(rows: DataFrame, key: str, n: int) -> list[int]:
        ranges = min(MOST_RANGES, max(1, -(-n // range_chars)))
        if ranges < 2:
            return []
        got = rows.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], max(10_000, 20 * ranges))).first()[0]
        return sorted(set(got or []))

    by_hash, by_id = cuts(keyed.where("doc_id IS NULL"), "_th", chars.get(True, 0)), cuts(keyed.where("doc_id IS NOT NULL"), "_id", chars.get(False, 0))
    first = len(by_hash) + 1 if True in chars else 0  # the ranges of rows without an id are the lowest
    keyed = keyed.withColumn("_range", F.when(F.col("doc_id").isNull(), _range_of(by_hash, F.col("_th"))).otherwise(_range_of(by_id, F.col("_id")) + F.lit(first)).cast("int"))
    # One row a range; a range's document of largest id is what the next higher range needs.
    tops = sorted(keyed.groupBy("_range").agg(F.max(F.struct("_id", "_th")).alias("top")).collect(), key=lambda r: r._range)
    heads = [(r.top._id, r.top._th, tops[(k + 1) % len(tops)]._range) for k, r in enumerate(tops)]
    head = docs.sparkSession.createDataFrame(heads, "_id long, _th long, _to int")
    own = F.struct(F.col("_range"), F.lit(False).alias("_extra"))
    sent = F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_to").alias("_range"), F.lit(True).alias("_extra"))))
    rows = keyed.join(F.broadcast(head), ["_id", "_th"], "left").select("doc_id", "text", "_id", "_th", F.explode(sent).alias("_s")).select("doc_id", "text", "_id", "_th", "_s.*")
    return rows.repartition(max(1, len(tops)), "_range").sortWithinPartitions("_range", "_extra", F.desc("_id"), F.desc("_th")).select("doc_id", "text", "_range", "_extra")


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) characters replaced by as many of the first
    ones (or all) of the document that follows by falling doc_id; the first follows the last. Null texts count
    as empty; an empty text has an empty fingerprint. Rows of equal id stand by falling text hash; null ids
    come last. A single document follows itself. Repeated rows have equal fingerprints. A very long text has as
    many filters as its features fill; nothing of it is left out. Other columns are not read, whatever their
    names; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    rank = level_ranks(docs)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, still without its follower
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "_range", "_extra"))
            rows = held + list(zip(*columns, strict=True))
            texts = [r[1].encode("utf-8", "surrogatepass") for r in rows]
            pairs = [k for k in range(len(rows) - 1) if rows[k][2] == rows[k + 1][2] and not rows[k][3]]
            edited = [edited_text(rows[k][1], rows[k + 1][1]).encode("utf-8", "surrogatepass") for k in pairs]
            own = [chain(f) for f in features(texts, rank)]
            new = [chain(f) for f in features(edited, rank)]
            out = [
                (rows[k][0], len(rows[k][1]), hashlib.sha256(e).hexdigest(), encode(own[k]), encode(n), likeness(own[k], n), likeness(own[k], own[k + 1]))
                for k, e, n in zip(pairs, edited, new, strict=True)
            ]
            held = rows[-1:]
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return common.map_rows(with_next(docs, range_chars), run, schema)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
