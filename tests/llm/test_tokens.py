import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lattice.llm import packing, token_count, tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def test_split_agrees_with_the_library_for_every_character(library):
    pre = library.pre_tokenizer
    encoder = tokens.Encoder(tokens.read_model(tokens.default_path()), True)
    checked = 0
    for code in range(0x2FFF):
        c = chr(code)
        if tokens._OTHER.search(c):
            continue
        checked += 1
        text = f"a{c}b {c}1{c} {c}{c}  {c}'s\n{c} .{c}"
        spans = [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]
        assert encoder.pre_tokens(text) == spans, hex(code)
    assert checked > 600


def test_counts_are_the_librarys(spark, make, prose, odd, library):
    rng = random.Random(5)
    texts = [*odd, *odd[:4], *[prose(rng.randint(1, 400), k) for k in range(60)], prose(20_000, 99)]
    got = {}
    for r in token_count.count_tokens(make(texts, "n_tokens token"), limit=100).collect():
        got[r.doc_id] = r
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100)


def test_counts_of_empty_table_and_null_ids(spark, make):
    assert token_count.count_tokens(make([]).limit(0)).count() == 0
    assert sorted(r.n_tokens for r in token_count.count_tokens(make([(None, "a b"), (None, "a b"), (3, None)])).collect()) == [0, 2, 2]


def test_cache_is_bounded_and_keeps_the_given_table(library, monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "LIMIT", 3)
    encoder = tokens.Encoder(tokens.read_model(tokens.default_path()), True, {"the": 1})
    for text in ("ab cd ef gh", "zz yy", "ab the zz", "a" * 1000 + " ab"):
        assert encoder.count(text) == len(library.encode(text).ids)
        assert len(encoder) <= 3 and max(map(len, encoder)) <= encoder.LONG
    assert encoder["the"] == 1


#: A passage of several scripts, symbols, combining marks and unassigned characters.
SCRIPTS = ["Ελληνικά γράμματα, και αριθμοί 12½", "Русский текст с числами 2024!", "漢字とかな交じり文。一二三", "한국어 문장입니다", "مرحبا بالعالم ١٢٣", "हिन्दी में लिखा", "😀 emoji 👍🏽 and ﬁ ﬂ ǅ", "a\u0301 e\u0308 \u2003 x\u00a0y \u3000z", "mixed English и русский we'll", "\U0010ffff\ue000 \ud7ff"]


def test_every_script_takes_both_tiers(spark, make, library):
    encoder = tokens.Encoder(tokens.read_model(tokens.default_path()), True)
    whole = []
    encoder._encode = lambda text: whole.append(text) or library.encode(text, add_special_tokens=False).ids
    rng = random.Random(3)
    texts = SCRIPTS + [" ".join(rng.choices(" ".join(SCRIPTS).split(" "), k=30)) for _ in range(40)]
    for t in texts:
        assert "".join(encoder.pre_tokens(t)) == t
        assert encoder.count(t) == len(library.encode(t, add_special_tokens=False).ids)
    assert not whole
    found = token_count.frequent_pre_tokens(make(texts), tokens.read_model(tokens.default_path()))
    assert " γράμματα" in found and " числами" in found
    ids = tokens.Encoder(tokens.read_model(tokens.default_path()), False)
    assert all(np.frombuffer(ids.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)
    counts = {r.doc_id: r.n_tokens for r in token_count.count_tokens(make(texts)).collect()}
    assert counts == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(choose):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 700)
    capacity = packing.Capacity(100, 3, 10_000, (1.0, 0.1, 0.2), choose)
    bins, offsets = packing.best_fit(lengths, capacity)
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        assert len(own) <= 3 and (lengths[own] ** 2).sum() <= 10_000
        order = own[np.argsort(offsets[own])]
        assert offsets[order].tolist() == np.concatenate([[0], np.cumsum(lengths[order])[:-1]]).tolist()
        assert lengths[own].sum() <= 100


def test_pack_is_whole_gapless_and_tight(spark, make, prose, odd, library):
    rng = random.Random(7)
    texts = [*odd, *[prose(rng.randint(1, 300), k) for k in range(200)], prose(9000, 5), prose(60, 1), prose(60, 1)]
    rows = packing.pack(make(texts, "piece offset"), group=100).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    total = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and sum(r.length for r in pieces) == len(ids)
        at = 0
        for k, r in enumerate(pieces):
            assert r.start == at and (r.length == 2048 or k == 0) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert len(pieces) == -(-len(ids) // 2048)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 3
    assert packing.pack(make([]).limit(0)).count() == 0
