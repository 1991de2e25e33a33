"""Language identification with string kernels.

A text is cut into windows of WINDOW characters. A window is the set of its character n-grams of lengths 1 to
ORDER (a blended spectrum, by presence); the kernel of two windows is the size of the sets' intersection over the
geometric mean of their sizes, and a text's kernel the mean of its windows', by their length, so that a very long
text, whose own set would hold every n-gram, is scored like its parts. Sets are exact, nothing is hashed. Nyström
landmarks, windows taken evenly from the languages of the training sample, turn kernel ridge regression, one
language against the rest, into a linear model: scores are two matrix products for each batch of windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER, WINDOW = 3, 1024
#: Windows that are scored together; a training set's texts and landmarks; the ridge.
TOGETHER, SAMPLE, LANDMARKS, RIDGE = 256, 4_000, 192, 1e-2
#: Characters of a sampled text that are learned from.
LEARNED = 2 * WINDOW
_WORD = re.compile(r"[^\W\d_]")
#: Bits of a code point in an n-gram's number.
_BITS = 21


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _WORD.finditer(text))


def window_codes(text: str) -> list[np.ndarray]:
    """The code points of each window of the text, lower-cased between blanks, and those that its last n-grams take from the next."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    return [codes[a : a + WINDOW + ORDER - 1] for a in range(0, max(1, len(codes) - ORDER + 1), WINDOW)]


def spectra(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(window, n-gram) of the distinct n-grams of each window, as two arrays; an n-gram's number tells it from all others."""
    flat = np.concatenate(windows).astype(np.int64) if windows else np.empty(0, np.int64)
    size = np.array([len(w) for w in windows], np.int64)
    of = np.repeat(np.arange(len(windows)), size)
    known, small = np.unique(flat, return_inverse=True)  # few characters: shorter numbers sort together with the window's
    bits = max(1, int(len(known)).bit_length())
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(flat))
    found_of, found = [], []
    for n in range(1, ORDER + 1):
        inside = at[(at + n <= end)]
        number = of[inside]
        for j in range(n):
            number = (number << bits) | small[inside + j]
        number = np.unique(number)
        gram = np.zeros(len(number), np.int64)
        for j in range(n):
            gram = (gram << _BITS) | (known[(number >> (bits * (n - 1 - j))) & ((1 << bits) - 1)] + (j == 0))
        found_of.append(number >> (bits * n))
        found.append(gram)
    return np.concatenate(found_of), np.concatenate(found)


@dataclass
class Kernel:
    """languages, the landmarks' n-grams (sorted) and scaled presence vectors, and each language's weights for the landmarks' kernels."""

    languages: list[str]
    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def kernel(self, windows: list[np.ndarray]) -> np.ndarray:
        """(windows, landmarks)."""
        of, gram = spectra(windows)
        size = np.bincount(of, minlength=len(windows))
        found = np.zeros((len(windows), len(self.grams)), np.float32)
        if len(self.grams):
            place = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
            same = self.grams[place] == gram
            found[of[same], place[same]] = 1
        return (found @ self.landmarks.T) / np.sqrt(np.maximum(size, 1))[:, None]

    def of_texts(self, texts: list[str]) -> np.ndarray:
        """(texts, landmarks): the mean over each text's windows, by their length."""
        total, weight = np.zeros((len(texts), len(self.landmarks))), np.zeros(len(texts))
        owners: list[int] = []
        windows: list[np.ndarray] = []

        def take() -> None:
            own, share = np.array(owners, np.int64), np.array([len(w) for w in windows], np.float64)
            np.add.at(total, own, self.kernel(windows) * share[:, None])
            np.add.at(weight, own, share)
            owners.clear()
            windows.clear()

        for k, text in enumerate(texts):
            for w in window_codes(text):
                owners.append(k)
                windows.append(w)
                if len(windows) == TOGETHER:
                    take()
        if windows:
            take()
        return total / np.maximum(weight, 1)[:, None]

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.of_texts(texts) @ self.weights + self.bias


def fit_kernel(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Kernel:
    """Fit to texts and their languages, in this order; with none, a model without languages. A landmark is a text's middle window."""
    names = sorted(set(languages))
    if not names:
        return Kernel([], np.empty(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    of = np.array([names.index(x) for x in languages])
    turns = np.zeros(len(of), np.int64)
    for k in range(len(names)):
        turns[of == k] = np.arange((of == k).sum())
    chosen = np.lexsort((of, turns))[:landmarks]  # the languages take turns
    marks = []
    for k in chosen.tolist():
        cut = window_codes(texts[k])
        marks.append(cut[len(cut) // 2])
    owner, gram = spectra(marks)
    grams, place = np.unique(gram, return_inverse=True)
    scaled = np.zeros((len(marks), len(grams)), np.float32)
    scaled[owner, place] = (1 / np.sqrt(np.bincount(owner, minlength=len(marks))))[owner]
    model = Kernel(names, grams, scaled, np.zeros((0, 0)), np.zeros(0))
    within = model.kernel(marks).astype(np.float64)
    values, vectors = np.linalg.eigh((within + within.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-6 * values.max()))  # the Nyström map: kernel @ root
    mapped = model.of_texts(texts) @ root
    target = np.where(of[:, None] == np.arange(len(names))[None, :], 1.0, -1.0)
    share = np.sqrt(len(of) / (len(names) * np.bincount(of)))[of][:, None]  # rare languages count as much
    mapped_w, target_w = np.hstack([mapped, np.ones((len(of), 1))]) * share, target * share
    solved = np.linalg.solve(mapped_w.T @ mapped_w + ridge * np.eye(mapped_w.shape[1]), mapped_w.T @ target_w)
    model.weights = root @ solved[:-1]
    model.bias = solved[-1]
    return model


def train(docs: DataFrame, sample: int = SAMPLE) -> Kernel:
    """Learn from at most `sample` rows with text and lang whose id's check sum mod 4 is not 2: those of lowest hash."""
    key = F.col("doc_id").cast("long").cast("string")
    usable = docs.where((F.pmod(F.crc32(key), F.lit(4)) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = usable.select(F.xxhash64(key).alias("_h"), F.col("doc_id").cast("long").alias("_id")).distinct().orderBy("_h", "_id").limit(sample)
    # At most `sample` rows of two numbers go to every task.
    rows = usable.select(F.col("doc_id").cast("long").alias("_id"), "text", "lang").join(F.broadcast(chosen), "_id").select("_h", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A sample's text is the middle of the whole one where that is longer than what is learned from.
            texts = [t[max(0, (len(t) - LEARNED) // 2) :][:LEARNED] if has_letter(t) else None for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("_h"), pa.array(texts, pa.string()), batch.column("lang")], ["h", "text", "lang"])

    got = common.map_rows(rows, run, "h long, text string, lang string").where("text IS NOT NULL").orderBy("h", "lang", "text").limit(sample).collect()
    return fit_kernel([r.text for r in got], [r.lang for r in got])


def identify(docs: DataFrame, model: Kernel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs, from its text alone.

    lang_pred is `und` with score 0 where text is null, empty, blank or without a letter, or where the model has
    no language; held_out tells whether the id's check sum mod 4 is 2 (a null id: false). Equal scores go to the
    language first in order. Repeated rows are judged alike. A very long text is judged by all its windows.
    Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Kernel = sent.value
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            rows = common.texts(batch)
            best, top = np.zeros(len(rows), int), np.zeros(len(rows))
            if model.languages:
                found = model.scores(rows)
                best = found.argmax(axis=1) if len(rows) else best
                top = np.clip((found.max(axis=1, initial=-1) + 1) / 2, 0, 1)
            for text, k, s in zip(rows, best.tolist(), top.tolist(), strict=True):
                known = bool(model.languages) and has_letter(text)
                names.append(model.languages[k] if known else "und")
                scores.append(round(s, 9) if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = common.map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
