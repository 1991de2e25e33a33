import random

import pytest

from lattice.llm import line_dedup
from lattice.llm.line_dedup import MIN_LINES, MIN_WORDS


def corpus(prose, seed):
    rng = random.Random(seed)
    pool = [prose(rng.randint(2, 9), k).replace("\n", " ") for k in range(25)] + [prose(60, 500 + k).replace("\n", " ") for k in range(6)]
    runs = [[rng.choice(pool) for _ in range(rng.randint(2, 8))] for _ in range(8)]
    rows = []
    for i in range(70):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice(runs) if rng.random() < 0.4 else [rng.choice(pool + ["", "  ", prose(7, rng.randrange(10**6)).replace("\n", " ") + " \t"])]
        rows.append((i, "\n".join(lines)))
    return rows


def test_passages_of_over_fifty_words(make, prose):
    passage = prose(52, 9).replace("\n", " ")
    rows = [(3, "x y\n" + passage), (1, passage + "\nown text"), (2, "before\n" + passage + "\nafter")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(rows)).collect()}
    assert got == {1: passage + "\nown text", 2: "before\nafter", 3: "x y"}


def test_null_repeated_and_empty(make, prose):
    text = "\n".join(prose(50, k).replace("\n", " ") for k in range(3))
    rows = [(5, text), (5, text), (None, text), (6, text), (7, None), (8, "")]
    got = sorted((r.doc_id or -1, r.text, r.n_removed) for r in line_dedup.dedup_lines(make(rows, "_id _th runs")).collect() if r.doc_id != 7)
    assert got == [(-1, text, 0), (5, "", 3), (5, "", 3), (6, "", 3), (8, "", 0)]
    assert line_dedup.dedup_lines(make([]).limit(0)).count() == 0
    assert line_dedup.dedup_lines(make(rows, "_id")).columns == ["doc_id", "text", "lang", "source", "n_chars", "_id", "n_lines", "n_removed"]


def test_very_long(make, prose):
    lines = [prose(6, k).replace("\n", " ") for k in range(8000)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(make([(1, "\n".join(lines)), (2, "\n".join(lines[:4000]))])).collect()}
    assert got == {1: 0, 2: 4000}


def whole(rows, key):
    """Texts after dedup by the docstring of dedup_lines(): each line of each run that holds enough and stands earlier, anywhere, goes."""
    docs = []
    for i, t in rows:
        lines = (t or "").split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        docs.append((i, t, lines, solid, [lines[k].strip(" \t\r") for k in solid]))

    def runs(d):
        x = docs[d][4]
        for a in range(len(x)):
            for b in range(a + 1, len(x) + 1):
                if b - a >= MIN_LINES or sum(y.count(" ") + 1 for y in x[a:b]) >= MIN_WORDS:
                    yield a, b, tuple(x[a:b]), key(*docs[d][:2]) + (a,)

    first, gone = {}, [set() for _ in docs]
    for d in range(len(docs)):
        for _, _, run, place in runs(d):
            first[run] = min(first.get(run, place), place)
    for d in range(len(docs)):
        for a, b, run, place in runs(d):
            if first[run] < place:
                gone[d] |= set(docs[d][3][a:b])
    return [(i, t if not g else "\n".join(x for k, x in enumerate(lines) if k not in g), len(g)) for (i, t, lines, _, _), g in zip(docs, gone, strict=True)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_the_definition(make, prose, odd, seed):
    rows = corpus(prose, seed) + [(1000 + k, t) for k, t in enumerate(odd)]
    rows += [(2000, "a\n" * 12), (2001, "\n".join("abcdefgh")), (2002, "\n".join("zabcdefghz"))]
    random.Random(seed).shuffle(rows)
    got = {(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(make(rows, "runs _lines")).collect()}
    assert got == set(whole(rows, lambda i, t: (i,)))
    assert sum(r[2] > 0 for r in got) > 15


def test_run_that_stands_longer_after_its_first_place(make, prose):
    hot = prose(50, 9).replace("\n", " ")
    rows = [(1, hot + "\nown"), (2, f"{hot}\ny\nz\nafter 2"), (3, f"{hot}\ny\nz\nafter 3"), (4, f"y\nz\n{hot}\n4"), (5, f"y\nz\n{hot}\n5")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(rows)).collect()}
    assert got == {1: hot + "\nown", 2: "y\nz\nafter 2", 3: "after 3", 4: "y\nz\n4", 5: "5"}


@pytest.mark.parametrize("lines, words", [(2, 10), (3, 25), (6, 1000)])
def test_other_sizes(make, prose, lines, words, monkeypatch):
    monkeypatch.setitem(globals(), "MIN_LINES", lines)
    monkeypatch.setitem(globals(), "MIN_WORDS", words)
    rows = corpus(prose, 7)
    got = {(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(make(rows), lines, words).collect()}
    assert got == set(whole(rows, lambda i, t: (i,)))


def test_only_selected_lines_are_sent(make, prose):
    """Short lines: of each window the least hash only, and each line of a window's size on its own."""
    short = make(["\n".join(f"l{i} {j}" for j in range(400)) for i in range(20)])
    got = line_dedup.fingerprints(short).count()
    assert 20 * 400 / 4 <= got < 0.55 * 20 * 400
    assert line_dedup.fingerprints(make([prose(50, k).replace("\n", " ") for k in range(9)])).count() == 9
