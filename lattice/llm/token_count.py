"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of the corpus's most frequent pre-tokens and their lengths in tokens, broadcast to
all workers (at most TABLE entries); tier two is each worker's own cache, in which a pre-token that the table
lacks is encoded once. No pre-token is shuffled: what travels is at most PER_TASK summed counts per task, from
which the table is chosen. The table decides speed only; every count is the library's own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Entries of the broadcast table, and the most frequent pre-tokens that one task reports.
TABLE, PER_TASK = 30_000, 3_000
#: Distinct pre-tokens that a task counts at once; beyond it the rare half is forgotten (this only costs speed).
DISTINCT = 300_000
LIMIT = 1024


def frequent_pre_tokens(docs: DataFrame, model: str, top: int = TABLE, per_task: int = PER_TASK) -> list[str]:
    """The most frequent pre-tokens over all texts, most frequent first; a bounded list."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.worker_encoder(sent.value, True)
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in common.texts(batch):
                if parts := encoder.pre_tokens(text):
                    seen.update(x for x in parts if len(x) <= common.Cache.LONG)
                    if len(seen) > DISTINCT:
                        seen = Counter(dict(seen.most_common(DISTINCT // 2)))
        best = seen.most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["token", "n"])

    parts = common.map_rows(docs.select("text"), count, "token string, n long")
    rows = parts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(top).collect()
    return [r.token for r in rows]


def count_tokens(docs: DataFrame, model_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text; other columns are not read).

    Null and empty texts have 0 bytes and 0 tokens; rows with equal or null ids are counted each for itself,
    repeated ones alike, and no order matters; a very long text is counted whole; an empty table gives an empty
    result. Special strings inside a text are handled as the library does.
    """
    model = tokens.read_model(model_path or tokens.default_path())
    spark = docs.sparkSession
    frequent = frequent_pre_tokens(docs, model)
    local = tokens.Encoder(model, lengths=True)
    packed = tokens.pack_table((t, local[t]) for t in frequent)
    sent = spark.sparkContext.broadcast((model, packed))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.worker_encoder(sent.value[0], True, sent.value[1])
        for batch in batches:
            rows = common.texts(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in rows], pa.int64()), pa.array([encoder.count(t) for t in rows], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = common.map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"))
