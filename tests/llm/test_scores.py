import random

import numpy as np
import pytest

from lattice.llm import fingerprint, language_id, quality


def rated(prose, n=400, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = prose(rng.randint(20, 300), i).split(" ")
        kind = i % 5
        if kind == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "nasty", "badword", "cursing"])
        text = " ".join(words)
        if kind == 1:
            text = text.upper().replace(" ", "!! ")
        docs.append((i, text))
        labels.append((i, 0 if kind == 1 else 1, 1 if kind == 0 else 0))
    return docs, labels


def test_classifier_on_held_out_documents(spark, make, prose):
    docs, labels = rated(prose)
    known = spark.createDataFrame(labels[:300] + [(5000, 1, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    df = make(docs, "accepted _id grade")
    model = quality.fit(df, known)
    assert (np.diff(model.thresholds) >= 0).all()
    rows = {r.doc_id: r for r in quality.classify(df, model).collect()}
    wrong = [i for i, q, t in labels[300:] if rows[i].accepted != (q == 1 and t == 0)]
    assert len(wrong) <= 4
    grades = [np.mean([rows[i].expected_grade for i in range(300, 400) if i % 5 == k]) for k in (0, 1, 2)]
    assert grades[0] < 0.4 < 0.7 < grades[1] < 1.3 < 1.7 < grades[2]


def test_scoring_is_the_plain_sum(make, prose, odd):
    model = quality.Ordinal()
    model.thresholds = np.array([-1.0, 0.5])
    texts = [*odd, *[prose(40, k) for k in range(5)], prose(30_000, 7)]
    rng = np.random.default_rng(1)
    used = sorted({b for t in texts for b in quality.features(t or "")})
    model.weights = {b: float(w) for b, w in zip(used, rng.normal(0, 0.05, len(used)), strict=True)}
    for r in quality.classify(make(texts), model).collect():
        found = quality.features(texts[r.doc_id] or "")
        f = sum(model.weights[b] for b in found)
        tail, grade = 1 / (1 + np.exp(0.5 - f)), 1 / (1 + np.exp(-1 - f)) + 1 / (1 + np.exp(0.5 - f))
        assert (abs(r.tail_probability - tail) < 1e-6 and abs(r.expected_grade - grade) < 1e-6) if found else (r.tail_probability, r.accepted) == (0, False)


def test_classifier_without_ratings_and_without_rows(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(make(["a b"]), none)
    assert [(r.accepted, r.expected_grade) for r in quality.classify(make(["a b", None, "", "."]), model).collect()] == [(True, 2.0), (False, 0.0), (False, 0.0), (False, 0.0)]
    assert quality.classify(make([]).limit(0), model).count() == 0


@pytest.fixture(scope="module")
def tongues():
    rng = random.Random(6)
    parts = {"aa": ["ka", "lu", "mi", "ton"], "bb": ["sch", "ei", "ung", "er"], "cc": ["été", "oux", "que", "le"]}

    def write(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))

    return write


def test_language_id_held_out(spark, make, tongues, odd):
    import zlib

    from pyspark.sql import functions as F

    langs = ["aa", "bb", "cc"]
    texts = [tongues(langs[i % 3], 3 + i % 60) for i in range(240)] + odd + [tongues("bb", 20_000), "123 %%", "ß"]
    df = make(texts, "score held_out").withColumn("lang", F.when(F.col("doc_id") < 240, F.element_at(F.array(*map(F.lit, langs)), (F.col("doc_id") % 3 + 1).cast("int"))))
    rows = {r.doc_id: r for r in language_id.identify(df, language_id.train(df)).collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[i] or "")))
    assert np.mean([rows[i].lang_pred == langs[i % 3] for i in range(240) if rows[i].held_out]) > 0.97
    assert rows[240 + len(odd)].lang_pred == "bb"
    blank = language_id.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in language_id.identify(df.limit(5), blank).collect()} == {("und", 0.0)}
    assert language_id.identify(make([]).limit(0), blank).count() == 0


def grams(window):
    return {window[i : i + n] for n in (1, 2, 3) for i in range(len(window) - n + 1)}


def cut(text):
    text = f" {text.lower()} "
    return [text[a : a + language_id.WINDOW + 2] for a in range(0, max(1, len(text) - 2), language_id.WINDOW)]


def exact_kernel(texts, marks):
    """The windows' mean kernel, by Python sets."""
    out = []
    for t in texts:
        windows = cut(t)
        k = [[len(grams(w) & grams(m)) / np.sqrt(len(grams(w)) * len(grams(m))) for m in marks] for w in windows]
        out.append(np.average(k, axis=0, weights=[len(w) for w in windows]))
    return np.array(out)


def test_kernel_is_exact(tongues, odd):
    texts = [t or "" for t in odd] + [tongues("aa", 40), tongues("cc", 900), tongues("bb", 7), "\U0010ffff\x00a" * 700]
    model = language_id.fit_kernel(texts, ["xy"[k % 2] for k in range(len(texts))], landmarks=10)
    chosen = sorted(range(len(texts)), key=lambda k: (k // 2, k % 2))[:10]
    marks = [cut(texts[k])[len(cut(texts[k])) // 2] for k in chosen]
    assert np.abs(model.of_texts(texts) - exact_kernel(texts, marks)).max() < 1e-6


def test_all_texts_as_landmarks_give_exact_kernel_ridge(tongues):
    langs = ["aa", "bb", "cc"]
    texts = [tongues(langs[k % 3], 12) for k in range(36)]
    model = language_id.fit_kernel(texts, [langs[k % 3] for k in range(36)], landmarks=36)
    new = [tongues(langs[k % 3], 9) for k in range(12)]
    marks = [cut(t)[0] for t in texts]
    target = np.where(np.arange(36)[:, None] % 3 == np.arange(3), 1.0, -1.0)
    alpha = np.linalg.solve(exact_kernel(texts, marks) + 1 + language_id.RIDGE * np.eye(36), target)  # + 1: the bias, under the same ridge
    assert np.abs(model.scores(new) - (exact_kernel(new, marks) + 1) @ alpha).max() < 1e-3


@pytest.mark.parametrize("lang", ["aa", "bb", "cc"])
def test_language_of_ten_million_characters(tongues, lang):
    rng = random.Random(4)
    mixed = lambda x, n: " ".join(tongues(x, 1) if rng.random() < 0.9 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789.,!?") for _ in range(5)) for _ in range(n))
    model = language_id.fit_kernel([mixed(x, 60) for x in ("aa", "bb", "cc") * 20], ["aa", "bb", "cc"] * 20)
    text = mixed(lang, 150_000)
    text *= -(-10_000_000 // len(text))
    scores = model.scores([text, mixed(lang, 3_000)])  # of many windows both
    assert model.languages[scores[0].argmax()] == lang and abs(scores[0].max() - scores[1].max()) < 0.1


def brute_levels(data):
    out = []
    for i in range(len(data) - fingerprint.WIDTH + 1):
        n = np.bincount(data[i : i + fingerprint.WIDTH])
        total = fingerprint._F[n].sum()
        out.append((fingerprint._TOP - total) * (fingerprint.LEVELS - 1) // fingerprint._TOP)
    return np.array(out)


def test_levels_are_the_windows_entropies():
    rng = np.random.default_rng(2)
    for data in (rng.integers(0, 6, 500), np.zeros(100, int), rng.integers(0, 256, 300), np.arange(32)):
        data = data.astype(np.uint8)
        assert (fingerprint.levels(data) == brute_levels(data)).all()


def test_features_do_not_depend_on_the_block(prose):
    rank = np.random.default_rng(1).permutation(fingerprint.LEVELS)
    texts = [prose(n, n).encode() for n in (1, 3, 80, 500, 7, 2000)] + [b"", b"a" * 500, b"x" * 15, b"y" * 16, b"a" * 17]
    together = fingerprint.features(texts, rank)
    for t, f in zip(texts, together, strict=True):
        assert (fingerprint.features([t], rank)[0] == f).all() and (len(f) > 0) == (len(t) > 0)


def plain_fingerprint(text, rank):
    """Features and filters by their definition, one window at a time."""
    import hashlib
    from collections import Counter
    from math import log2

    width, reach, mask = fingerprint.WIDTH, fingerprint.REACH, 2**64 - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def digest(window):
        h = 0
        for j in range(0, width, 8):
            h = mix(h ^ (int.from_bytes(window[j : j + 8], "little") + 0x9E3779B97F4A7C15 & mask))
        return h

    def level(window):
        part = lambda n: round(n * log2(n) * 1024)
        return (part(width) - sum(part(n) for n in Counter(window).values())) * (fingerprint.LEVELS - 1) // part(width)

    windows = [text[i : i + width] for i in range(len(text) - width + 1)]
    value = [(int(rank[level(w)]), digest(w) >> 16) for w in windows]
    found = [digest(w) for i, w in enumerate(windows) if all(value[i] < v for v in value[max(0, i - reach) : i]) and all(value[i] <= v for v in value[i + 1 : i + reach + 1])]
    if not windows:
        found = [int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")] if text else []
    filters = []
    for a in range(0, len(found), fingerprint.PER_FILTER):
        bits = set()
        for h in found[a : a + fingerprint.PER_FILTER]:
            bits |= {(h >> (k * 11)) % fingerprint.BITS for k in range(fingerprint.HASHES)}
        filters.append(bits)
    return found, filters


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    best = []
    for f in a:
        of = [(len(f & g), len(f) * len(g) / fingerprint.BITS, min(len(f), len(g))) for g in b]
        best.append(max(min(1, max(0, (s - c) / max(m - c, 1e-9))) for s, c, m in of))
    return sum(len(f) * x for f, x in zip(a, best)) / sum(map(len, a))


def test_fingerprints_by_their_definition(prose):
    rank = np.random.default_rng(4).permutation(fingerprint.LEVELS)
    whole = prose(900, 3).encode()
    texts = [b"", b"a", whole[:15], whole[:16], whole[:17], b"ab" * 300, whole, whole[700:] + prose(50, 8).encode(), *[whole[k : k + n] for k, n in enumerate((100, 500, 511, 512, 513, 530))]]
    plain = [plain_fingerprint(t, rank) for t in texts]
    found = fingerprint.features(texts, rank)
    chains = [fingerprint.chain(f) for f in found]
    for (features, filters), f, c in zip(plain, found, chains, strict=True):
        assert features == f.tolist()
        assert filters == [set(np.flatnonzero(np.unpackbits(row)).tolist()) for row in c]
    for (_, x), c in zip(plain, chains, strict=True):
        for (_, y), d in zip(plain, chains, strict=True):
            assert abs(fingerprint.likeness(c, d) - plain_likeness(x, y)) < 2e-6


def test_one_rule_for_all_lengths(prose):
    """A text and its beginning share their features, whatever lengths they have; so do a short text and its edit."""
    rank = np.arange(fingerprint.LEVELS)
    whole = prose(200, 1).encode()[:1100]
    for n in (60, 200, 505, 511, 512, 520, 1000):
        a, b = fingerprint.features([whole, whole[:n]], rank)
        assert len(set(b.tolist()) - set(a.tolist())) <= 2 and n / 35 < len(b) < n / 5
    near = []
    for k in range(30):
        text, other = prose(12, 2 * k)[:60], prose(12, 2 * k + 1)[:60]
        a, b, c = (fingerprint.chain(fingerprint.features([t.encode()], rank)[0]) for t in (text, text[:30] + other[:30], other))
        near.append((fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    assert np.mean([x for x, _ in near]) > 0.25 and np.mean([y for _, y in near]) < 0.1


def test_rows_without_an_id_are_dealt(make, prose):
    rows = [(None, prose(100, k)) for k in range(60)] + [(k, prose(100, 100 + k)) for k in range(40)]
    dealt = fingerprint.with_next(make(rows).select("doc_id", "text"), range_chars=4000).where("NOT _extra")
    sizes = {(r.without, r._range): r["count"] for r in dealt.groupBy(dealt.doc_id.isNull().alias("without"), "_range").count().collect()}
    assert sum(n for (w, _), n in sizes.items() if w) == 60 and sum(w for w, _ in sizes) > 3 and max(sizes.values()) < 30
    assert len({r for _, r in sizes}) == len(sizes)
    got = fingerprint.fingerprints(make(rows), range_chars=4000).collect()
    assert len(got) == 100 and sorted(r.edited_sha256 for r in got) == sorted(r.edited_sha256 for r in fingerprint.fingerprints(make(rows), range_chars=10**9).collect())


def test_fingerprints(spark, make, prose, odd):
    import hashlib

    texts = [*odd, *[prose(n, n) for n in (5, 50, 300, 300, 800, 20_000)], prose(90, 1), prose(90, 1)]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    random.Random(2).shuffle(rows)
    got = {r.doc_id: r for r in fingerprint.fingerprints(make(rows, "_range _extra"), range_chars=20_000).collect()}
    assert len(got) == len(rows)
    down = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(down):
        t, following = t or "", down[(k + 1) % len(down)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own = fingerprint.decode(r.fingerprint)
        assert r.near_edited == fingerprint.likeness(own, fingerprint.decode(r.edited_fingerprint))
        assert r.near_next == fingerprint.likeness(own, fingerprint.decode(got[down[(k + 1) % len(down)][0]].fingerprint))
    a, b = [r for r in got.values() if r.n_chars == len(prose(90, 1))][:2]
    assert a.fingerprint == b.fingerprint
    long = [r for r in got.values() if r.n_chars > 500 and r.near_next < 1]
    assert len(long) > 3 and all(r.near_edited > 0.3 and r.near_next < 0.4 for r in long)


def test_fingerprints_of_null_repeated_and_single_rows(make):
    rows = fingerprint.fingerprints(make([(None, "abc"), (1, "xy"), (1, "xy"), (1, "zw")])).collect()
    assert sorted(r.doc_id or -1 for r in rows) == [-1, 1, 1, 1]
    assert [(r.near_next, r.n_chars) for r in fingerprint.fingerprints(make(["one"])).collect()] == [(1.0, 3)]
    assert fingerprint.fingerprints(make([]).limit(0)).count() == 0
