"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 poor, 2 good. One weight vector over hashed text features, shared by all thresholds, gives a
document's place f on one axis; ordered thresholds t0 < t1 give P(grade <= k) = 1 / (1 + exp(f - t_k)), and from
that the expected grade and the tail probability P(grade = 2) by which documents are selected. The weights are
fitted with an L1 penalty, so words without a bearing on the grade weigh nothing, however long the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rated documents that the fit takes (those of smallest id hash), hash buckets, and buckets kept by screening.
SAMPLE, BUCKETS, SCREENED = 5_000, 1 << 20, 4_096
#: The L1 penalty a rated document, and the tail probability from which a document is accepted.
L1, ACCEPT = 3e-4, 0.5
STEM = 5
_RUNS = re.compile(rb"[!-/:-@\[-`{-~]{2,}|\|")


def _bucket(kind: bytes, value: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(kind + value) % BUCKETS


def stems(types: set[bytes]) -> set[bytes]:
    """The first bytes of the longer words."""
    return {w[:STEM] for w in types if len(w) > STEM}


def shape(raw: bytes, words: list[bytes], types: set[bytes]) -> list[int]:
    """Buckets of what the text looks like: capitals, symbols, repetition, length, symbol runs."""
    letters = len(raw)
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(raw) - len(raw.translate(None, b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"))
    lines = raw.split(b"\n")
    marks = {
        b"capitals": int(10 * capitals / letters), b"symbols": int(20 * symbols / letters), b"types": int(10 * len(types) / len(words)),
        b"length": len(words).bit_length(), b"lines": int(10 * len(set(lines)) / len(lines)), b"spread": int(4 * len(types) / (1 + len(words) ** 0.75)),
    }
    found = [_bucket(b"m", k + str(v).encode()) for k, v in marks.items()]
    return found + [_bucket(b"r", run[:8]) for run in set(_RUNS.findall(raw))]


def features(text: str) -> list[int]:
    """A text's buckets: those of its distinct words and stems and of its shape; none without a word."""
    words = common.plain_words(text)
    if not words:
        return []
    types = set(words)
    found = shape(text.encode("utf-8", "surrogatepass"), words, types)
    return found + [_bucket(b"w", w) for w in types] + [_bucket(b"s", w) for w in stems(types)]


class Ordinal:
    """Thresholds and sparse weights of a cumulative-link model."""

    def __init__(self, grades: int = 3):
        self.grades, self.thresholds, self.weights = grades, np.array([-np.inf] * (grades - 1)), {}

    def fit(self, rows: list[np.ndarray], grade: np.ndarray, l1: float = L1, screened: int = SCREENED, steps: int = 400) -> Ordinal:
        """rows: the bucket numbers of each document, those that meet in one bucket counting each. Unseen grades get thresholds that give them no weight."""
        n = len(rows)
        seen = np.unique(grade)
        if len(seen) < 2:  # nothing to tell apart: every document gets the one grade seen, or the highest
            top = int(seen[0]) if len(seen) else self.grades - 1
            self.thresholds = np.array([-np.inf if k < top else np.inf for k in range(self.grades - 1)])
            return self
        owner = np.repeat(np.arange(n), [len(r) for r in rows])
        flat = np.concatenate(rows).astype(np.int64)
        both, count = np.unique(owner * BUCKETS + flat, return_counts=True)
        owner, flat = both // BUCKETS, both % BUCKETS
        kept, place = np.unique(flat, return_inverse=True)
        df = np.bincount(place).astype(float)
        centred = grade - grade.mean()
        # Screening: each bucket's mean grade difference in standard errors; rare ones drop out.
        score = np.abs(np.bincount(place, centred[owner])) / np.sqrt(df + 3)
        score[df < 3] = 0
        use = np.argsort(-score, kind="stable")[:screened]
        use = use[score[use] > 0]
        number = np.full(len(kept), -1)
        number[use] = np.arange(len(use))
        inside = number[place] >= 0
        row, col, value = owner[inside], number[place[inside]], count[inside].astype(float)
        d = len(use)
        norm = np.sqrt(np.bincount(col, minlength=d) / n) + 0.05  # rare marks may weigh as much as common ones
        value = value / norm[col]
        weights, cuts = np.zeros(d), np.quantile(np.linspace(0, 1, 3), np.linspace(0.2, 0.8, self.grades - 1)) * 2 - 1
        for k in range(self.grades - 1):
            p = min(max((grade <= k).mean(), 1e-3), 1 - 1e-3)
            cuts[k] = np.log(p / (1 - p))
        v, u, t, step = weights.copy(), cuts.copy(), 1.0, 1.0

        def loss(w: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            f = np.bincount(row, value * w[col], minlength=n)
            edges = np.concatenate([np.full((n, 1), -40.0), c[None, :] - f[:, None], np.full((n, 1), 40.0)], axis=1)
            edges = np.clip(edges, -40, 40)
            cdf = 1 / (1 + np.exp(-edges))
            hi, lo = cdf[np.arange(n), grade + 1], cdf[np.arange(n), grade]
            p = np.maximum(hi - lo, 1e-12)
            dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
            df_ = (dhi - dlo) / n  # of minus log p by f
            dc = np.array([(-dhi[grade == k]).sum() + dlo[grade == k + 1].sum() for k in range(self.grades - 1)]) / n
            return float(-np.log(p).mean()), np.bincount(col, value * df_[row], minlength=d), dc

        for _ in range(steps):
            here, gw, gc = loss(v, u)
            while True:  # a proximal step, shortened until it keeps its promise
                w_new = v - step * gw
                w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * l1, 0)
                c_new = np.maximum.accumulate(u - step * gc)
                dw, dc = w_new - v, c_new - u
                if loss(w_new, c_new)[0] <= here + gw @ dw + gc @ dc + (dw @ dw + dc @ dc) / (2 * step) + 1e-12 or step < 1e-6:
                    break
                step /= 2
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            moved = np.abs(w_new - weights).max(initial=0)
            v, u = w_new + (t - 1) / t_new * (w_new - weights), c_new + (t - 1) / t_new * (c_new - cuts)
            weights, cuts, t, step = w_new, c_new, t_new, step * 1.1
            if moved < 1e-4:
                break
        kept_weights = weights / norm
        self.weights = {int(kept[use[k]]): float(kept_weights[k]) for k in np.flatnonzero(weights)}
        self.thresholds = cuts
        return self

    def score(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, tail probability of the highest grade) at the places f."""
        with np.errstate(over="ignore"):
            cdf = 1 / (1 + np.exp(np.clip(f[:, None] - self.thresholds[None, :], -500, 500)))
        return (1 - cdf).sum(axis=1), 1 - cdf[:, -1]


def rated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of at most `sample` rated documents: those whose id hashes lowest."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1)
    graded = labels.select(F.col("doc_id").cast("long").alias("_id"), grade.alias("grade")).where("_id IS NOT NULL AND grade IS NOT NULL")
    graded = graded.groupBy("_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most `sample` rows of two numbers are sent to every task.
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(graded), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(features(t)) for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("grade"), pa.array(found, pa.list_(pa.int32()))], ["_id", "grade", "f"])

    # Rows that repeat an id bring no more than `sample` texts of the fit.
    found = common.map_rows(rows, run, "_id long, grade int, f array<int>").orderBy("_id", "grade", F.size("f"), F.xxhash64("f")).limit(sample)
    got = sorted(found.collect(), key=lambda r: (r._id, r.grade, len(r.f), r.f))
    got = [r for r in got if r.f]
    return [np.asarray(r.f) for r in got], np.asarray([r.grade for r in got], np.int64)


class _Weights(common.Cache):
    """The weight of each word, or of each stem."""

    def __init__(self, kind: bytes, weights: dict[int, float]):
        super().__init__()
        self.kind, self.weights = kind, weights

    def value(self, key: bytes) -> float:
        return self.weights.get(_bucket(self.kind, key), 0.0)

    def total(self, words: set[bytes]) -> float:
        return sum(map(self.__getitem__, words))


def classify(docs: DataFrame, model: Ordinal, accept: float = ACCEPT) -> DataFrame:
    """docs with expected_grade, tail_probability (double) and accepted (boolean) added, in this order.

    Null, empty and blank texts and texts without a word have expected grade 0, tail 0 and are not accepted.
    Every row is scored by its text alone, the whole of it however long, so repeated rows score alike and no order
    matters; null ids are scored like others; columns of docs with these names are replaced; an empty table gives an
    empty result.
    """
    names = [c for c in docs.columns if c not in ("expected_grade", "tail_probability", "accepted")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(list(docs.schema.fields)).add("expected_grade", "double").add("tail_probability", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Ordinal = sent.value
        of_words, of_stems = _Weights(b"w", model.weights), _Weights(b"s", model.weights)
        for batch in batches:
            rows = common.texts(batch)
            place, some = np.zeros(len(rows)), np.zeros(len(rows), bool)
            for i, text in enumerate(rows):
                words = common.plain_words(text)
                if not words:
                    continue
                types = set(words)
                raw = text.encode("utf-8", "surrogatepass")
                marks = sum(model.weights.get(b, 0.0) for b in shape(raw, words, types))
                place[i] = round(of_words.total(types) + of_stems.total(stems(types)) + marks, 9)
                some[i] = True
            grade, tail = model.score(place)
            grade, tail = np.where(some, grade, 0.0), np.where(some, tail, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(grade, 9)), pa.array(np.round(tail, 9)), pa.array(tail >= accept)], [*batch.schema.names, "expected_grade", "tail_probability", "accepted"])

    return common.map_rows(docs, run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """The model of the rated documents; with none, every text with a word gets the highest grade."""
    return Ordinal().fit(*rated(docs, labels, sample))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text"), model).drop("text")
