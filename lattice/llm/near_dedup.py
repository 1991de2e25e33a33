"""Near-duplicate groups by a multi-index Hamming join over b-bit MinHash signatures.

1. A document is its set of distinct word shingles (64-bit hashes); equal sets form a class, and one member of
   each goes on. Its signature has SYMBOLS MinHash symbols of 16 bits.
2. A signature is split into CHUNKS chunks. By pigeonhole, two signatures that differ in fewer than
   2 * CHUNKS symbols differ in at most one symbol of some chunk; so each chunk is indexed once for each symbol
   left out (the allowed error), and any such pair shares an index key. Shingle sets at the similarity
   threshold of 0.75 miss each other with a probability of about 2e-6.
3. Stars: each document takes, of the smallest and largest of each key's documents, the one whose signature agrees
   most with its own (in AGREE symbols or more: a pair at the threshold has 30 expected; fewer than 15 with a
   probability under 1e-6). Exact intersections of the full sets confirm these links, one for each document, and
   join most near copies, however many there are, in time and rows in proportion to their number.
4. Keys whose documents are now in more than one component go on: documents of different components whose
   signatures agree in AGREE symbols or more are joined to candidate clusters, and within a cluster exact
   intersections confirm links between different components. Documents of the largest component of a key or
   cluster meet the others only, not each other; large ones are dealt in blocks. What is passed on is a spanning
   forest for each block, never all pairs; components follow from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from . import common

SHINGLE, PERCENT = 5, 75
CHUNKS, CHUNK = 10, 4
SYMBOLS = CHUNKS * CHUNK
AGREE = 15
#: Symbols from which on a pair is all but sure to be linked (a pair at the threshold has so many with a probability of 0.1).
SURE = 34
#: Documents of a block of a key, and documents and shingles of a block of a cluster.
KEY_BLOCK, BLOCK_DOCS, BLOCK_SHINGLES = 512, 512, 200_000
#: Rows of (id, cluster) that are broadcast instead of dealing all texts by id (about 32 MB).
BROADCAST_ROWS = 1_000_000

_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 2**63, SYMBOLS, np.uint64)[:, None]
_MUL = _RNG.integers(0, 2**63, SYMBOLS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_HASHES = common.WordHashes()


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle; without words there is none."""
    words = _HASHES.of(common.space_words(text))
    n = min(size, len(words))
    if not n:
        return np.empty(0, np.uint64)
    total = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        total += words[j : len(words) - n + 1 + j] * _PLACE[j % 64]
        if j % 64 == 63:
            total = common.mix(total)
    return np.unique(common.mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    lowest = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        np.minimum(lowest, ((shingles[None, a : a + 2048] ^ _XOR) * _MUL).min(axis=1), out=lowest)
    return (common.mix(lowest) & np.uint64(0xFFFF)).astype(np.uint16)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """(documents, SYMBOLS) keys: for each chunk and each of its symbols, the chunk's others and its number."""
    n = len(signatures)
    chunks = signatures.reshape(n, CHUNKS, CHUNK).astype(np.int64)
    keys = np.empty((n, CHUNKS, CHUNK), np.int64)
    for left_out in range(CHUNK):
        key = np.broadcast_to((np.arange(CHUNKS) * CHUNK + left_out)[None, :], (n, CHUNKS)).copy()
        for j in range(CHUNK):
            if j != left_out:
                key = (key << 16) | chunks[:, :, j]
        keys[:, :, left_out] = key
    return keys.reshape(n, SYMBOLS)


def _signed(x: np.ndarray) -> list[int]:
    return np.asarray(x, np.uint64).view(np.int64).tolist()


def sketch(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (a 128-bit digest of the set) and sig for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, f1, f2, sigs = [], [], [], []
            for text in common.texts(batch):
                s = shingle_set(text, size)
                counts.append(len(s))
                f1.append(int(s.sum(dtype=np.uint64)) if len(s) else 0)
                f2.append(int(np.bitwise_xor.reduce(common.mix(s))) if len(s) else 0)
                sigs.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(_signed(f1), pa.int64()), pa.array(_signed(f2), pa.int64()), pa.array(sigs, pa.binary())],
                ["doc_id", "n_shingles", "f1", "f2", "sig"],
            )

    return common.map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, f1 long, f2 long, sig binary")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def forest(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(id, smallest id reachable) of the nodes of a symmetric boolean matrix that have a link."""
    order = np.argsort(ids, kind="stable")
    open_ = linked.any(axis=1)
    out = []
    for start in order.tolist():
        if not open_[start]:
            continue
        front = np.array([start])
        open_[start] = False
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & open_)
            open_[front] = False
            out += [(int(ids[k]), int(ids[start])) for k in front.tolist()]
    return [(a, b) for a, b in out if a != b]


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _flush(function):
    """An Arrow function that yields the edges that function(group) finds for each group of rows that agree in keys."""

    def run(keys: list[str]):
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple[int, int]] = []
            for group in common.sorted_groups(batches, keys):
                out += function(group)
                if len(out) > 50_000:
                    yield _edges(out)
                    out = []
            yield _edges(out)

        return over

    return run


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many symbols signatures agree, by rows (or as they broadcast)."""
    agree = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.uint8)
    for j in range(SYMBOLS):
        agree += a[..., j] == b[..., j]
    return agree


def _alike(group: pa.Table) -> list[tuple[int, int]]:
    """Of a block: links of documents of different components whose signatures agree in AGREE symbols, as a forest."""
    ids, sigs, comp = group.column("id").to_numpy(), _matrix(group.column("sig")), group.column("comp").to_numpy()
    linked = np.zeros((len(ids), len(ids)), bool)
    for a in range(0, len(ids), 64):
        linked[a : a + 64] = (agreement(sigs[a : a + 64, None], sigs[None]) >= AGREE) & (comp[a : a + 64, None] != comp[None])
    return forest(linked, ids)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of sorted sets (the diagonal is not filled)."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets) if m else np.empty(0, np.uint64)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    count = np.diff(np.concatenate([first, [len(values)]])).astype(np.int64)
    found = np.zeros(m * m, np.int64)
    for d in range(2, 7):  # elements of few sets: their pairs; those of one set can't be in an intersection
        at = first[count == d]
        for a in range(d):
            for b in range(a + 1, d):
                found += np.bincount(owner[at + a] * m + owner[at + b], minlength=m * m)
    found = found.reshape(m, m)
    found = found + found.T
    many = np.flatnonzero(count > 6)
    for a in range(0, len(many), 4096):
        some = many[a : a + 4096]
        dense = np.zeros((m, len(some)), np.float32)
        n = count[some]
        columns = np.repeat(np.arange(len(some)), n)
        at = np.repeat(first[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        dense[owner[at], columns] = 1
        found += np.rint(dense @ dense.T).astype(np.int64)
    return found


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _confirm(percent: int):
    def one(group: pa.Table) -> list[tuple[int, int]]:
        """Of a block: exact links of documents of different components, as a forest."""
        ids, sets, comp = group.column("id").to_numpy(), _sets(group.column("shingles")), group.column("comp").to_numpy()
        both = intersections(sets)
        size = np.array([len(s) for s in sets], np.int64)
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        return forest(linked & (comp[:, None] != comp[None, :]), ids)

    return _flush(one)


def _confirm_star(percent: int):
    def one(group: pa.Table) -> list[tuple[int, int]]:
        """Of a block of a star: exact links of its documents with the one in the middle."""
        ids, sets, star = group.column("id").to_pylist(), _sets(group.column("shingles")), group.column("star")[0].as_py()
        middle = sets[ids.index(star)]
        out = []
        for i, s in zip(ids, sets, strict=True):
            both = np.intersect1d(s, middle, assume_unique=True).size if i != star else 0
            if both and 100 * both >= percent * (len(s) + len(middle) - both):
                out.append((i, star))
        return out

    return _flush(one)


def _own(n: Column, id_: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), F.col(id_)), n).cast("int")


def dealt(members: DataFrame, group: str, block: int, weight: Column | None = None, heavy: int = 0) -> DataFrame:
    """members (group, id, comp, more) in blocks (kind, bi, bj) in which any two of a group that differ in comp meet.

    A group of up to `block` rows (and `heavy` weight) is one block. Of a larger one, the rows of the largest
    component, if that alone is more than a block, are dealt to blocks of kind 0, each with one block of the
    others'; the others' blocks meet each other in kind 1. So rows grow with the group times the others' blocks,
    not with its square.
    """
    weight = weight if weight is not None else F.lit(0)
    size = members.groupBy(group, "comp").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    size = size.groupBy(group).agg(F.max(F.struct("n", "w", "comp")).alias("most"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / F.lit(block)), F.ceil(w / F.lit(heavy)) if heavy else F.lit(0), F.lit(1)).cast("int")
    small = (F.col("n") <= block) & (F.col("w") <= heavy) if heavy else F.col("n") <= block
    # A largest component of a block or less is dealt like the others: it would add a block to each of theirs.
    large = (F.col("most.n") > block) | ((F.col("most.w") > heavy) if heavy else F.lit(False))
    rest = lambda c: F.col(c) - F.when(large, F.col(f"most.{c}")).otherwise(0)
    size = size.select(group, small.alias("_small"), F.when(large, F.col("most.comp")).alias("_most"), F.when(large, blocks(F.col("most.n"), F.col("most.w"))).otherwise(0).alias("_nm"), blocks(rest("n"), rest("w")).alias("_no"))
    rows = members.join(size, group)
    place = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("bi"), b.cast("int").alias("bj"))
    each = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - F.lit(1))).otherwise(F.array().cast("array<int>"))
    one = F.array(place(1, F.lit(0), F.lit(0)))
    main = F.transform(each(F.col("_no")), lambda k: place(0, _own(F.col("_nm"), "id"), k))
    own = _own(F.col("_no"), "id")
    other = F.concat(F.transform(each(F.col("_nm")), lambda k: place(0, k, own)), F.transform(each(F.col("_no")), lambda k: place(1, F.least(own, k), F.greatest(own, k))))
    where = F.when(F.col("_small"), one).when(F.col("comp").eqNullSafe(F.col("_most")), main).otherwise(other)
    return rows.select(*members.columns, F.explode(where).alias("_b")).select(*members.columns, "_b.kind", "_b.bi", "_b.bj")


def shared_keys(classes: DataFrame) -> DataFrame:
    """(key, id, lo, hi) of the classes (id, sig) that share an index key, lo and hi being the key's smallest and largest."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = index_keys(_matrix(pa.chunked_array([batch.column("sig")])))
                ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(ids)], ["key", "id"])

    index = common.map_rows(classes, keys, "key long, id long")
    # Grouped by another key than the join's, so that the join deals both sides anew and can split a hot key.
    shared = index.groupBy(F.bitwise_not("key").alias("g")).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("who")).where("lo < hi")
    # Copies of an edited text meet under many keys: one key stands for each set of documents.
    shared = shared.groupBy("n", "lo", "hi", "who").agg(F.min(F.bitwise_not("g")).alias("key")).select("key", "lo", "hi")
    return index.join(shared, "key")


def stars(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, star): for each document, that of its keys' smallest and largest ones whose signature agrees most with its own, if in AGREE symbols.

    Agreement counts up to SURE symbols; equally good ones: the smallest.
    """
    asked = members.select("id", F.explode(F.array("lo", "hi")).alias("star")).where("id != star").distinct()
    both = asked.join(classes.select("id", "sig"), "id").join(classes.select(F.col("id").alias("star"), F.col("sig").alias("of")), "star")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_matrix(pa.chunked_array([batch.column(c)])) for c in ("sig", "of"))
                agree = agreement(a, b)
                keep = pa.array(agree >= AGREE)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("star"), pa.array(agree.astype(np.int32))], ["id", "star", "agree"]).filter(keep)

    close = common.map_rows(both.select("id", "star", "sig", "of"), compare, "id long, star long, agree int")
    # All that agree in SURE symbols are as good: the smallest of them, so that a group's documents meet at few others.
    rank = F.least("agree", F.lit(SURE)).alias("agree")
    return close.groupBy("id").agg(F.max(F.struct(rank, (-F.col("star")).alias("m"))).alias("x")).select("id", (-F.col("x.m")).alias("star"))


def _with_sets(docs: DataFrame, wanted: DataFrame, size: int, rows: int | None = None) -> DataFrame:
    """wanted (id and other columns) with the documents' shingle sets; sent to all tasks if it has few rows."""
    wanted = F.broadcast(wanted) if rows is not None and rows <= BROADCAST_ROWS else wanted.hint("shuffle_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id")
    names = [c for c in texts.columns if c != "text"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in texts.drop("text").schema.fields), "shingles binary"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, size).tobytes() for t in common.texts(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.binary())], [*names, "shingles"])

    return common.map_rows(texts, sets, schema)


def star_links(docs: DataFrame, stars: DataFrame, counts: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): the stars' links that full sets confirm. A star's documents are dealt to blocks, each with the one in the middle."""
    n = stars.join(counts, "id").groupBy("star").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_DOCS)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("n"))
    arms = stars.join(n, "star").select("id", "star", _own(F.col("n"), "id").alias("a"), _own(F.col("n"), "id").alias("b"))
    middles = n.select(F.col("star").alias("id"), "star", F.lit(0).alias("a"), (F.col("n") - F.lit(1)).alias("b"))
    # A document may be the middle of its own star and an arm of another: its set is worked out once.
    wanted = arms.union(middles).groupBy("id").agg(F.collect_list(F.struct("star", "a", "b")).alias("at"))
    rows = _with_sets(docs, wanted, size).select("id", "shingles", F.explode("at").alias("x"))
    rows = rows.select("id", "shingles", "x.star", F.explode(F.sequence("x.a", "x.b")).alias("block"))
    return rows.repartition("star", "block").sortWithinPartitions("star", "block").mapInArrow(_confirm_star(percent)(["star", "block"]), "u long, v long")


def candidate_clusters(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, cluster) of the documents (members: key, id, comp) whose signature is close to one of another component."""
    rows = dealt(members, "key", KEY_BLOCK).join(classes.select("id", "sig"), "id")
    close = rows.repartition("key", "kind", "bi", "bj").sortWithinPartitions("key", "kind", "bi", "bj").mapInArrow(_flush(_alike)(["key", "kind", "bi", "bj"]), "u long, v long")
    return components(close).withColumnRenamed("component", "cluster")


def exact_links(docs: DataFrame, clusters: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): links of documents of each cluster (id, cluster, comp, n_shingles) that are in different components, confirmed on full sets, as forests."""
    rows = dealt(clusters, "cluster", BLOCK_DOCS, F.col("n_shingles"), BLOCK_SHINGLES)
    wanted = rows.groupBy("id", "cluster", "comp").agg(F.collect_list(F.struct("kind", "bi", "bj")).alias("at"))
    found = _with_sets(docs, wanted, size, clusters.count()).select("cluster", "id", "comp", "shingles", F.explode("at").alias("x")).select("cluster", "id", "comp", "shingles", "x.*")
    return found.repartition("cluster", "kind", "bi", "bj").sortWithinPartitions("cluster", "kind", "bi", "bj").mapInArrow(_confirm(percent)(["cluster", "kind", "bi", "bj"]), "u long, v long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= percent * |A or B| for their shingle sets; component_id is the
    smallest doc_id reachable over links, kept tells whether it is the document's own. Null, empty and blank
    texts have no shingles and are linked with nothing. Rows of one doc_id are one document: linked with each
    other, kept or dropped together. Rows with a null doc_id are linked with nothing: null component_id, kept.
    A very long text is one set like any other. Of equal sets, and of a component, the smallest doc_id is kept;
    no other order matters. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    rows = common.materialise(sketch(docs, size))
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = common.materialise(some.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    counts = classes.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"))
    signatures = classes.select("id", "sig")
    members = common.materialise(shared_keys(signatures))
    first = components(star_links(docs, stars(members, signatures), counts, size, percent))
    of = lambda df: df.join(first.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    members = common.materialise(of(members.select("key", "id")))
    clusters = common.materialise(of(candidate_clusters(members, signatures)).join(counts, "id"))
    links = exact_links(docs, clusters, size, percent).union(first.where("id != component"))
    # Rows that share an id but not a set: their classes are one document.
    pairs = some.join(classes.select("n_shingles", "f1", "f2", "id"), ["n_shingles", "f1", "f2"]).select("doc_id", "id")
    several = pairs.groupBy("doc_id").agg(F.min("id").alias("v"), F.max("id").alias("w")).where("v != w").select("doc_id")
    same = pairs.join(several, "doc_id").where("doc_id != id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    found = components(links.union(same))
    member = rows.join(classes.select("n_shingles", "f1", "f2", "id"), ["n_shingles", "f1", "f2"], "left")
    node = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("id"))
    member = member.select("doc_id", "n_shingles", node.alias("id")).join(found, "id", "left")
    member = member.select("doc_id", "n_shingles", F.least("id", F.coalesce("component", "id")).alias("component_id"))
    return member.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs, with all columns, whatever their names, without the documents that near_duplicates() doesn't keep.

    Null, empty and blank texts and rows without an id stay; repeated rows of a kept id stay as they are; very long
    texts and ties as there. An empty table gives an empty result.
    """
    gone = near_duplicates(docs, size, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct().hint("shuffle_hash")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
