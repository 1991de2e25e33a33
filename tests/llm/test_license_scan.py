import random
import re

from lattice.llm import license_scan
from lattice.llm.license_scan import STRIDE, TEMPLATES, THRESHOLD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text):
    w = words(text)
    places, base, labels, score = [], set(), set(), 0.0
    for t in TEMPLATES:
        v = t.words()
        if t.phrase:
            at = [i for i in range(len(w)) if w[i : i + len(v)] == v]
            if at:
                labels.add(t.label)
                score = 1.0
                if t.base:
                    places += at
                    base.add(t.label)
        else:
            for a in range(0, max(1, len(w)), STRIDE):
                share = len(set(v) & set(w[a : a + 2 * STRIDE])) / len(set(v))
                if share >= THRESHOLD:
                    labels.add(t.label)
                    score = max(score, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)


def test_matches_brute_force(make, prose, odd):
    rng = random.Random(4)
    texts = [*odd, "GNU general, public-license gnu General Public License", "CC BY CC BY-NC CC-BY", "mit MIT license mit license", "cc", "by cc", "gnu general public", "Apache license " * 200]
    for k in range(60):
        base = prose(rng.randint(1, 150), k).split(" ")
        for _ in range(rng.randint(0, 3)):
            said = rng.choice(TEMPLATES).text.split(" ")
            for _ in range(rng.randint(0, 3)):
                said[rng.randrange(len(said))] = "other"
            at = rng.randrange(len(base) + 1)
            base[at:at] = said
        texts.append(" ".join(base))
    texts.append(prose(20_000, 3) + " Apache License, " + prose(50, 2))
    got = {r.doc_id: r for r in license_scan.scan_licenses(make(texts, "label token _w n_words")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == brute(t), (i, t[:200])
    assert sum(r.labels != "" for r in got.values()) > 30


def test_repeated_rows_null_ids_and_empty_table(make):
    rows = license_scan.scan_licenses(make([(None, "mit license"), (1, "cc by x"), (1, "cc by x"), (2, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_base, r.labels) for r in rows) == [(-1, 1, "mit"), (1, 1, "cc-by"), (1, 1, "cc-by"), (2, 0, "")]
    assert license_scan.scan_licenses(make([]).limit(0)).count() == 0


def test_no_python_on_the_main_path(make):
    plan = license_scan.scan_licenses(make(["mit license"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_only_ascii_letters_are_lowered_and_rows_stay(make):
    rows = [(1, "apache \u212aicense; MIT LICENSE"), (1, "apache \u212aicense; MIT LICENSE"), (2, "BY\u212a cc by"), (2, "other"), (None, "mit license"), (None, "mit license")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.base_labels) for r in license_scan.scan_licenses(make(rows, "_th _copies")).collect())
    assert got == sorted([(1, 4, 1, 2, "mit")] * 2 + [(2, 3, 1, 1, "cc-by"), (2, 1, 0, None, ""), *[(0, 2, 1, 0, "mit")] * 2], key=lambda r: (r[0], r[1]))
    kelvin = license_scan.Template("k", "k one", True, True)
    got = {r.doc_id: r.n_base for r in license_scan.scan_licenses(make(["\u212a one", "K one"]), (kelvin,)).collect()}
    assert got == {0: 0, 1: 1}
