"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm import common, decontaminate, line_dedup, near_dedup, packing, quality


def _hidden(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with private names for all columns but doc_id and text, so that no operator's own columns meet them."""
    names = [c if c in ("doc_id", "text") else f"_column_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts: neither toxic nor poor.

    Null and empty texts and texts without a word go too. Rows are judged each by its whole text, repeated ones
    alike; without ratings all that have a word stay. Other columns keep their values, whatever their names. An empty
    table gives an empty result.
    """
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    rows, names = _hidden(docs)
    return quality.classify(rows, model).where("accepted").select(*names).toDF(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document of which nothing is left goes with its last line.

    n_chars is counted anew where lines went. Null and empty texts stay. Rows equal in id and text count as one
    place, of equal ids the smaller text hash as earlier. Very long texts are dealt with whole. Other columns keep
    their values, whatever their names. An empty table gives an empty result.
    """
    rows, names = _hidden(docs)
    cleaned = line_dedup.dedup_lines(rows).where("n_removed = 0 OR trim(text) != ''")
    if "n_chars" in docs.columns:
        own = names[docs.columns.index("n_chars")]
        cleaned = cleaned.withColumn(own, F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own)))
    return cleaned.select(*names).toDF(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near duplicates.

    Null and empty texts and rows without an id stay; rows of one id stay or go together; very long texts are compared
    whole. Other columns keep their values, whatever their names. An empty table gives an empty result.
    """
    rows, _ = _hidden(docs)
    return near_dedup.drop_near_duplicates(rows).toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts stay; rows are judged each for itself, by the whole text; items without an id count too.
    Other columns keep their values, whatever their names. An empty table gives an empty result; without items all
    rows stay.
    """
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens.

    A null or empty text is one token; rows of equal or null ids are packed each for itself; long texts are cut, none
    is left out; equally long pieces go by check sum. Other columns are not read. An empty table gives an empty result.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("near dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("packing", best_fit_packing),
]

#: SQL can't express the fitted classifier and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
