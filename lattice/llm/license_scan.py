"""License scans by an exact set-similarity join; DataFrame functions only.

Text blocks are windows of 2 * STRIDE words that start every STRIDE words, so any STRIDE consecutive words lie
whole in one. Template tokens are ordered by their frequency over all documents, rarest first. A template of t
tokens that must share o of them with a block (o = ceil(threshold * t)) shares one of its t - o + 1 rarest: the
join meets blocks and templates on these prefix tokens only, then drops pairs by length (too few template
tokens in the block) and position (too few left in the order), and counts the exact overlap of the rest.
Phrases are templates with threshold 1 whose words must also stand consecutively.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

STRIDE = 32
THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False
    phrase: bool = False

    def words(self) -> list[str]:
        return [w.decode() for w in common.plain_words(self.text)]


#: The phrases that are always looked for, and well-known license notices.
TEMPLATES = (
    Template("gpl", "gnu general public license", True, True),
    Template("apache", "apache license", True, True),
    Template("cc-by", "cc by", True, True),
    Template("mit", "mit license", True, True),
    Template("cc-by-nc", "cc by nc", False, True),
    Template("cc-by-sa", "cc by sa", False, True),
    Template("lgpl", "gnu lesser general public license", False, True),
    Template("mpl", "mozilla public license", False, True),
    Template("bsd", "bsd license", False, True),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)


def words_column(text: Column) -> Column:
    # Not lower(): of other letters, some fall on a-z.
    text = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def token_frequencies(docs: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many of all documents each template token occurs; as many rows as tokens at most."""
    found = F.array_distinct(F.filter(words_column(F.col("text")), lambda w: w.isin(tokens)))
    return {r.token: r.n for r in docs.select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD, stride: int = STRIDE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    Null and empty texts have no words and no labels (empty strings), null first and last word and score 0;
    rows with equal or null ids are scanned each for itself, repeated ones alike; columns besides doc_id and text
    are not read, whatever their names. A very long text has as many blocks as it needs. An empty table gives an
    empty result.
    score is the highest containment of a template that met its threshold, n_blocks how many blocks met one.
    """
    spark = docs.sparkSession
    if any(len(t.words()) > stride for t in templates):
        raise ValueError(f"a template has more than {stride} words")
    vocabulary = sorted({w for t in templates for w in t.words()})
    seen = token_frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for number, t in enumerate(templates):
        tokens = sorted(set(t.words()), key=rank.__getitem__)
        need = len(tokens) if t.phrase else ceil(threshold * len(tokens))
        for i, token in enumerate(tokens[: len(tokens) - need + 1]):
            rows.append((number, t.label, t.base, t.phrase, t.words(), tokens, need, i, rank[token], token))
    index = spark.createDataFrame(rows, "template int, label string, base boolean, phrase boolean, said array<string>, tokens array<string>, need int, at int, rank int, token string")
    prefix = sorted({r[-1] for r in rows})

    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), words_column(F.col("text")).alias("_w"))
    near = F.array_distinct(F.transform("_w", lambda w, i: F.when(w.isin(prefix), F.floor(i / F.lit(stride)).cast("int")).otherwise(F.lit(-1))))
    starts = F.array_distinct(F.flatten(F.transform(F.filter(near, lambda b: b >= 0), lambda b: F.array(b - 1, b))))
    blocks = F.transform(F.filter(starts, lambda b: b >= 0), lambda b: F.struct(b.alias("b"), F.slice("_w", b * F.lit(stride) + F.lit(1), F.lit(2 * stride)).alias("w")))
    # Each row has one block of no words besides, by which the rows that are equal in id and text are counted.
    blocks = F.concat(F.array(F.struct(F.lit(-1).alias("b"), F.array().cast("array<string>").alias("w"))), blocks)
    blocks = words.select("doc_id", "_th", F.size("_w").cast("long").alias("n_words"), F.explode(blocks).alias("_block"))
    of_block = F.array_distinct(F.filter("_block.w", lambda w: w.isin(vocabulary)))
    blocks = blocks.select("doc_id", "_th", "n_words", F.col("_block.b").alias("_b"), F.col("_block.w").alias("_w"), of_block.alias("_tokens"))
    blocks = blocks.select("*", F.explode_outer(F.filter("_tokens", lambda w: w.isin(prefix))).alias("token"))
    # A template table of some dozens of rows: its size is that of `templates`, not of the data.
    pairs = blocks.join(F.broadcast(index), "token", "left")
    first = ~F.exists(F.slice("tokens", 1, F.col("at")), lambda w: F.array_contains("_tokens", w))
    ranks = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.lit(rank[w]))])
    later = F.size(F.filter("_tokens", lambda w: F.element_at(ranks, w) >= F.col("rank")))
    candidate = (F.size("_tokens") >= F.col("need")) & first & (later >= F.col("need"))
    shared = F.when(candidate, F.size(F.array_intersect("tokens", "_tokens"))).otherwise(0)
    at = F.when(
        F.col("phrase") & candidate,
        F.filter(F.sequence(F.lit(0), F.lit(stride - 1)), lambda i: F.slice("_w", i + F.lit(1), F.size("said")) == F.col("said")),
    ).otherwise(F.array().cast("array<int>"))
    pairs = pairs.select("*", shared.alias("_shared"), at.alias("_at"))
    met = F.when(F.col("phrase"), F.size("_at") > 0).otherwise(F.col("_shared") >= F.col("need"))
    met = F.coalesce(met, F.lit(False))
    base = met & F.col("base")
    place = F.col("_b").cast("long") * stride
    copies = F.count(F.when(F.col("_b") == -1, 1))
    return (
        pairs.groupBy("_th", "doc_id", "n_words")
        .agg(
            (F.coalesce(F.sum(F.when(base, F.size("_at"))), F.lit(0)) / copies).cast("long").alias("n_base"), F.min(F.when(base, place + F.array_min("_at"))).alias("first_word"),
            F.max(F.when(base, place + F.array_max("_at"))).alias("last_word"), F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(met, F.col("label")))), ",").alias("labels"),
            F.coalesce(F.max(F.when(met, F.col("_shared") / F.size("tokens"))), F.lit(0.0)).alias("score"), F.size(F.collect_set(F.when(met, F.col("_b")))).cast("long").alias("n_blocks"),
            copies.cast("int").alias("_copies"),
        )
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
        .drop("_th", "_copies", "_copy")
    )


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))
