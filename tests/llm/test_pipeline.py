import numpy as np
import pytest

import corpus_pipeline
from lattice.llm import packing


@pytest.fixture(scope="module")
def corpus(spark, make, prose, tmp_path_factory):
    """Documents of every kind that a stage decides on; ratings for the first hundred."""
    rows, labels = [], []
    item = prose(30, 777).replace("\n", " ")
    for i in range(120):
        words = prose(60 + i, i)
        if i % 4 == 0:
            words = words.replace(" ", " vile ", 3)
        if i % 4 == 1:
            words = words.upper().replace(" ", "!! ")
        rows.append((i, words))
        if i < 100:
            labels.append((i, int(i % 4 != 1), int(i % 4 == 0)))
    clean = prose(200, 5000).replace("\n", " ")
    passage = prose(55, 6000).replace("\n", " ")
    rows += [(200, clean), (201, clean.replace(" ", " extra ", 1)), (202, prose(40, 1) + "\n" + passage), (203, prose(50, 2) + "\n" + passage)]
    rows += [(204, prose(50, 3) + " " + item + " " + prose(20, 4)), (205, None), (206, ""), (207, prose(9000, 8))]
    path = tmp_path_factory.mktemp("corpus")
    make(rows, "runs kept accepted n_removed n_lines tail_probability _gone _id").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict(rows), passage


def test_each_stage_decides_on_what_it_is_given(spark, corpus, tmp_path):
    path, rows, passage = corpus
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{k}"
        stage(spark, docs, path).write.parquet(out)
        docs = spark.read.parquet(out)
        if k < 4:
            assert docs.columns == columns
            assert docs.select(*columns[5:]).distinct().collect() == [("x",) * len(columns[5:])]
            kept.append({r.doc_id: r.text for r in docs.collect()})
    quality, lines, near, clean = kept
    good = {i for i in rows if i < 120 and i % 4 > 1} | {200, 201, 202, 203, 204, 207}
    assert len(set(quality) ^ good) <= 3 and not {205, 206} & set(quality)
    assert passage in lines[202] and passage not in lines[203] and set(lines) == set(quality)
    assert set(lines) - set(near) == {201}
    assert set(near) - set(clean) == {204}
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(clean)


def test_run_is_the_stages_in_turn(spark, corpus):
    path, _, _ = corpus
    got = corpus_pipeline.run(spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
    want = packing.pack(docs).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, want))
    for own in {r.sequence_id for r in got}:
        ends = sorted((r.offset, r.offset + r.length) for r in got if r.sequence_id == own)
        assert [a for a, _ in ends] == [0, *[b for _, b in ends[:-1]]] and ends[-1][1] <= 2048
    assert np.array([r.length for r in got]).sum() > 0


def test_stages_on_an_empty_table(spark, corpus):
    path, _, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0
