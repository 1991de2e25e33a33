import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """make(texts) -> documents with ids from 0; None is a null text; an item (id, text) sets the id itself."""

    def build(items, extra=""):
        rows = []
        for i, x in enumerate(items):
            doc_id, text = x if isinstance(x, tuple) else (i, x)
            rows.append((doc_id, text, "en", "s", len(text or "")))
        df = spark.createDataFrame(rows, DOCS)
        for name in extra.split():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
        return df

    return build


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed) -> n invented words with some punctuation and line ends."""

    def write(n, seed=0):
        rng = random.Random(seed)
        syllables = ["th", "er", "on", "an", "ré", "in", "ß", "lo", "ci", "ón", "the", "of"]
        out = []
        for k in range(n):
            word = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
            out.append(word + rng.choice(["", "", "", ",", ".", "!"]) + ("\n" if rng.random() < 0.1 else " "))
        return "".join(out).strip()

    return write


#: Nulls, empty and blank texts, one word, special strings, separators, repeats.
ODD = [None, "", " ", "\n\n", "one", "<|endoftext|> a <|endoftext|>", "a\x1cb\x1d c\u0085d e f", "it's 12½ x² we'll  \t go\n\n\n!", "漢字 かな 한국어 عربى", "😀 ok 👍🏽", "A" * 5000, "İKſ ́x"]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
