import hashlib
import random
import re

import pytest

from lattice.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, window=8):
    w, hit, found, longest = words(text), set(), set(), 0
    for item_id, t in items:
        v = words(t)
        n = min(window, len(v))
        for a in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[a : a + n]:
                    found.add(item_id)
                    hit |= set(range(p, p + n))
                    m = n
                    while p + m < len(w) and a + m < len(v) and w[p + m] == v[a + m]:
                        m += 1
                    longest = max(longest, m)
    return len(w), len(hit), sorted(found, key=lambda x: (x is None, x or 0)), longest


def cases(prose, odd):
    rng = random.Random(1)
    items = [(10 * k, prose(rng.randint(9, 30), 1000 + k)) for k in range(12)] + [(7, "Tiny item"), (8, "a a a a a a a a a a"), (9, None), (11, "..."), (7, "Tiny item"), (12, "wo rd")]
    texts = [*odd, "tiny ITEM, tiny item", "a " * 30, "x tiny"]
    for k in range(40):
        base = prose(rng.randint(5, 120), k).split(" ")
        for _ in range(rng.randint(0, 3)):
            v = rng.choice(items[:12])[1].split(" ")
            a = rng.randrange(len(v))
            at = rng.randrange(len(base) + 1)
            base[at:at] = v[a : a + rng.randint(4, 30)]
        texts.append(" ".join(base).upper() if k % 7 == 0 else " ".join(base))
    return items, texts


@pytest.mark.parametrize("part_words", [10**6, 60])
def test_matches_brute_force(spark, make, prose, odd, part_words):
    items, texts = cases(prose, odd)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.find_contamination(make(texts, "item_id n_words"), benchmark, part_words=part_words).collect()}
    assert len(rows) == len(texts)
    hits = 0
    for i, t in enumerate(texts):
        n, hit, found, longest = brute(t, items)
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.item_ids, r.longest) == (n, hit, len(found), found, longest), i
        hits += bool(found)
    assert hits > 10


def test_long_repeated_and_empty_input(spark, make, prose):
    item = prose(20, 3)
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [(5, (prose(30_000, 1) + " " + item) * 2), (None, item), (None, item), (6, "clean words")]
    rows = decontaminate.find_contamination(make(texts), benchmark).collect()
    assert len(rows) == 4 and sum(r.n_items for r in rows) == 3
    assert decontaminate.find_contamination(make(texts), benchmark.limit(0)).where("n_items > 0").count() == 0
    assert decontaminate.find_contamination(make([]).limit(0), benchmark).count() == 0
    kept = decontaminate.decontaminate(make(texts, "n_items _th"), benchmark)
    assert kept.columns[-2:] == ["n_items", "_th"] and [r.doc_id for r in kept.collect()] == [6]


def test_query_columns(spark, tmp_path, make, prose):
    a, b = prose(12, 1), prose(12, 2)
    make([a + " " + b, a]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, a), (9, b)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in decontaminate.op6_decontamination(spark, str(tmp_path)).collect()}
    assert rows[0].items_sha256 == hashlib.sha256(b"10,9").hexdigest() and rows[0].contaminated
    assert rows[1].items_sha256 == hashlib.sha256(b"10").hexdigest() and not rows[1].contaminated


def test_repetitive_words_against_brute_force(spark, make):
    """Few distinct words, so that windows repeat and overlap in documents and items; items without an id and copies among them."""
    rng = random.Random(5)
    say = lambda n, k=2: " ".join(rng.choice("abcd"[:k]) for _ in range(n))
    items = [(k, say(rng.randint(1, 40))) for k in range(8)] + [(20, "a " * 25), (21, "a " * 25), (22, "a " * 12), (None, "c d " * 9), (23, "b")]
    texts = [say(rng.randint(1, 60), rng.choice([1, 2, 3, 4])) for _ in range(60)] + ["a " * 300, "b a " * 50, "c d " * 30, "c d c d c d c d", "d", "b"]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for part_words in (10**6, 50):
        rows = {r.doc_id: r for r in decontaminate.find_contamination(make(texts), benchmark, part_words=part_words).collect()}
        for i, t in enumerate(texts):
            n, hit, found, longest = brute(t, items)
            found = [x for x in found if x is not None]
            assert (rows[i].n_words, rows[i].n_hit, rows[i].item_ids, rows[i].longest) == (n, hit, found, longest), (i, t)
    kept = {r.doc_id for r in decontaminate.decontaminate(make(texts), benchmark).collect()}
    assert kept == {i for i, t in enumerate(texts) if not brute(t, items)[1]}


def test_where_the_longest_match_is(spark, make):
    said = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(5, "x " + said), (3, said + " eleven"), (9, said)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.find_contamination(make([f"p q {said} r", f"{said} eleven, x {said}"]), benchmark).collect()}
    assert (rows[0].longest, rows[0].longest_item, rows[0].longest_at) == (10, 3, 2)
    assert (rows[1].longest, rows[1].longest_item, rows[1].longest_at) == (11, 3, 0)


def test_suffix_array_and_common_prefixes():
    np = decontaminate.np
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (300, 2), (300, 9), (200, 70_000)):
        words = rng.integers(0, top + 1, n)
        words[n // 3 : n // 2] = 1
        a = decontaminate.SuffixArray(words, top)
        stretch = lambda p: next((tuple(words[p:q].tolist()) for q in range(p, n) if words[q] == 0), tuple(words[p:].tolist()))
        found = [stretch(p) for p in a.array.tolist()]
        assert found == sorted(found) and sorted(a.array.tolist()) == np.flatnonzero(words).tolist()
        if len(found) > 1:
            same = [next((k for k, (x, y) in enumerate(zip(f, g)) if x != y), min(len(f), len(g))) for f, g in zip(found, found[1:])]
            assert a.common(a.array[:-1], a.array[1:]).tolist() == same


def test_memory_of_repetitive_text():
    """60,000 equal words and an item of 1,000: nothing is laid out by pairs of places."""
    import tracemalloc

    index = decontaminate.TestIndex([(1, [b"a"] * 1000), (2, [b"a"] * 40)], 8)
    tracemalloc.start()
    (spans, items, longest, who, at), = decontaminate._judged(index, [index.numbers("a " * 60_000)], True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (spans, items, longest, who, at) == ([(0, 60_000)], {1, 2}, 1000, 1, 0)
    assert peak < 100 << 20


def test_very_long_documents_in_pieces(monkeypatch, prose):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 200)
    items = [(k, decontaminate.common.plain_words(prose(30, k))) for k in range(5)]
    index = decontaminate.TestIndex(items, 8)
    rng = random.Random(2)
    text = " ".join(prose(rng.randint(5, 90), 100 + k) + " " + prose(30, rng.randrange(5)) for k in range(30))
    n, hit, found, longest = brute(text, [(k, prose(30, k)) for k in range(5)])
    (spans, got, length, _, _), = decontaminate._judged(index, [index.numbers(text)], True)
    union = decontaminate._union(spans)
    assert (sum(x["b"] - x["a"] for x in union), sorted(got), length) == (hit, found, longest)
