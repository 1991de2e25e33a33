import random
import re

import numpy as np

from lattice.llm import near_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i == j or s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def families(prose, n=60, seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = prose(rng.choice([3, 5, 8, 40, 120, 400]), k).split(" ")
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(["xx", "yy", "zz", ""])
            rows.append(" ".join(copy))
            if rng.random() < 0.5:
                words = copy  # drifts
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


def test_matches_brute_force(spark, make, prose, odd):
    rows = families(prose) + [(9000 + k, t) for k, t in enumerate(odd + odd[3:] + ["a b c", "A  b\tc", "a b c d e", "a b c d e f"])]
    got = near_dedup.near_duplicates(make(rows, "id key component"))
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()}
    assert got == {(i, n, c, i == c) for i, n, c in brute(rows)}


def test_blocks_do_not_change_the_result(spark, make, prose, monkeypatch):
    words = prose(150, 4).split(" ")
    rng = random.Random(8)
    rows = []
    for i in range(90):
        copy = list(words)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(50)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(near_dedup, "KEY_BLOCK", 20)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 16)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(make(rows)).collect()}
    assert got == brute(rows)


def test_null_repeated_and_empty(spark, make, prose):
    text, other = prose(30, 1), prose(30, 2)
    rows = [(4, text), (4, text), (2, text), (7, other), (7, text), (None, text), (None, None), (5, None), (6, "")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in near_dedup.near_duplicates(make(rows)).collect())
    assert [x for x in got if x[0] >= 0] == [(2, 2, True), (4, 2, False), (4, 2, False), (5, 5, True), (6, 6, True), (7, 2, False), (7, 2, False)]
    assert [x for x in got if x[0] < 0] == [(-1, None, True)] * 2
    assert near_dedup.near_duplicates(make([]).limit(0)).count() == 0
    kept = near_dedup.drop_near_duplicates(make(rows, "_gone kept"))
    assert kept.columns[-2:] == ["_gone", "kept"] and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 2, 5, 6]


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 2**16, near_dedup.SYMBOLS).astype(np.uint16)
        b = a.copy()
        at = rng.choice(near_dedup.SYMBOLS, 2 * near_dedup.CHUNKS - 1, replace=False)
        b[at] ^= 1
        ka, kb = near_dedup.index_keys(np.stack([a, b]))
        assert set(ka.tolist()) & set(kb.tolist())


def test_long_text(make, prose):
    text = prose(60_000, 3)
    rows = [(1, text), (2, text + " end"), (3, prose(60_000, 4))]
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(make(rows)).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_rows_grow_with_the_cluster_not_its_square(make, prose):
    """Distinct near copies of one text: stars join them; what is left to compare stays in proportion."""
    words = prose(300, 4).split(" ")
    rng = random.Random(8)
    sent = []
    for n in (600, 2400):
        rows = []
        for i in range(n):
            copy = list(words)
            copy[rng.randrange(len(copy))] = f"v{i}"
            rows.append((i, " ".join(copy)))
        classes = near_dedup.common.materialise(near_dedup.sketch(make(rows)).selectExpr("doc_id AS id", "sig", "n_shingles"))
        members = near_dedup.common.materialise(near_dedup.shared_keys(classes.select("id", "sig")))
        stars = near_dedup.stars(members, classes.select("id", "sig"))
        linked = near_dedup.components(near_dedup.star_links(make(rows), stars, classes.select("id", "n_shingles"), 5, 75))
        assert stars.count() == n and linked.where("component = 0").count() == n
        alone = near_dedup.F.when(near_dedup.F.col("id") % 100 == 7, near_dedup.F.col("id")).otherwise(0)  # as if one in a hundred were not joined
        sent.append(near_dedup.dealt(members.select("key", "id", alone.alias("comp")), "key", 256).count() / members.count())
    assert sent[1] < 1.5 * sent[0] < 3


def test_any_two_of_different_components_meet(spark):
    from pyspark.sql import functions as F

    for n, block in ((5, 10), (60, 8), (61, 7)):
        rows = spark.range(n).select(F.lit(1).alias("g"), "id", F.when(F.col("id") < n // 2, 0).otherwise(F.col("id") % 11 + 1).cast("long").alias("comp"))
        blocks: dict = {}
        for r in near_dedup.dealt(rows, "g", block, F.lit(1), 10**6).collect():
            blocks.setdefault((r.kind, r.bi, r.bj), []).append((r.id, r.comp))
        met = {(a, b) for x in blocks.values() for a, p in x for b, q in x if a < b and p != q}
        comp = lambda i: 0 if i < n // 2 else i % 11 + 1
        assert met == {(a, b) for a in range(n) for b in range(a + 1, n) if comp(a) != comp(b)}
        assert all(len(set(x)) == len(x) for x in blocks.values())
