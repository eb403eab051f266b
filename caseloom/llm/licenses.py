"""License scan: an exact set-similarity join of text blocks with license templates, in Spark SQL only.

A block is any stretch of as many words as the template has. It matches a template if it holds at least ``threshold``
of the template's distinct words. The join is exact and makes no pairs: the template's words are ordered by how often
they occur in the corpus, rarest first. A block that meets the threshold must hold one of the first
``n - ceil(threshold * n) + 1`` of them (prefix filter), so only places of those words are looked at. Texts shorter than the
required overlap are passed over (length filter), and a place counts for a template only with blocks that contain it
(positional filter). Each such block is then counted exactly. Places of fixed phrases are found in the same pass.

The templates are a few lines, so their words are broadcast: at most ``MOST_WORDS`` of them, which is checked.

Defined results: a null or empty text has no words and no labels. Repeated rows give repeated rows. An empty table
gives no rows. Only ``doc_id`` and ``text`` are read. A phrase may cross lines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.words import letter_words

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening or naming lines of common licenses, as words.
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "lgpl": "under the terms of the gnu lesser general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-line": "released under the mit license",
    "mozilla": "this source code form is subject to the terms of the mozilla public license",
    "public-domain": "this work is dedicated to the public domain",
}
MOST_WORDS = 10_000


def _frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each template word occurs in the corpus (at most MOST_WORDS rows reach the driver)."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(w,) for w in words], "word string")
    seen = docs.select(F.explode(letter_words(F.col("text"))).alias("word"))
    counts = seen.join(F.broadcast(wanted), "word").groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}


def _block_share(words: Column, at: Column, template: Column, size: Column) -> Column:
    """Largest number of distinct template words in a block that contains the place ``at``."""
    first = F.greatest(F.lit(0), at - size + 1)
    last = F.least(at, F.greatest(F.lit(0), F.size(words) - size))
    starts = F.sequence(first, F.greatest(first, last))
    return F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect(F.slice(words, s + 1, size), template))))


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8
) -> DataFrame:
    """``docs(doc_id, text)`` -> counts, places, labels and score of each row."""
    spark = docs.sparkSession
    sets = {k: t.split() for k, t in templates.items()}
    vocabulary = sorted({w for t in sets.values() for w in t})
    if len(vocabulary) + len(phrases) > MOST_WORDS:
        raise ValueError("too many template words to broadcast")
    often = _frequencies(docs, vocabulary)
    probes = [(p.split()[0], "phrase", label, p.split(), 0, len(p.split())) for p, label in phrases.items()]
    for label, t in sets.items():
        ordered = sorted(set(t), key=lambda w: (often.get(w, 0), w))
        need = math.ceil(round(threshold * len(ordered), 9))
        probes += [(w, "block", label, ordered, need, len(t)) for w in ordered[: len(ordered) - need + 1]]
    probe = F.broadcast(spark.createDataFrame(probes, "word string, kind string, label string, tokens array<string>, need int, span int"))
    first_words = sorted({p[0] for p in probes})
    reach = max(p[5] for p in probes)

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id"), F.xxhash64(text).alias("key"), letter_words(F.col("text")).alias("words"))

    def place(word, at):
        left = F.least(at, F.lit(reach - 1))
        near = F.slice("words", at - left + 1, left + reach)
        return F.when(word.isin(first_words), F.struct(at.alias("at"), word.alias("word"), left.alias("left"), near.alias("near")))

    rows = rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.array_compact(F.transform("words", place)).alias("hits"))
    rows = rows.select("doc_id", "key", "n_words", F.posexplode_outer("hits").alias("pos", "hit"))
    rows = rows.select("doc_id", "key", "n_words", (F.coalesce("pos", F.lit(0)) == 0).alias("own"), "hit.*").withColumn("at", F.col("at").cast("long"))
    # a place may probe several phrases and templates; only its first row stands for the document
    probe = probe.groupBy("word").agg(F.collect_list(F.struct("kind", "label", "tokens", "need", "span")).alias("probes"))
    rows = rows.join(F.broadcast(probe), "word", "left")
    rows = rows.select("doc_id", "key", "n_words", "own", "at", "left", "near", F.posexplode_outer("probes").alias("p", "probe"))
    rows = rows.withColumn("own", F.col("own") & (F.coalesce("p", F.lit(0)) == 0)).select("*", "probe.*").drop("probe", "p")
    phrase = (F.col("kind") == "phrase") & (F.slice("near", F.col("left") + 1, F.size("tokens")) == F.col("tokens"))
    share = F.when(
        (F.col("kind") == "block") & (F.col("n_words") >= F.col("need")),
        _block_share(F.col("near"), F.col("left"), F.col("tokens"), F.col("span")),
    )
    rows = rows.select(
        "doc_id", "key", "n_words", "own", F.coalesce(phrase, F.lit(False)).alias("phrase"), "at", "label",
        F.when(share >= F.col("need"), share / F.size("tokens")).alias("share"),
    )
    found = F.col("phrase") | F.col("share").isNotNull()
    out = rows.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.col("own").cast("long")).alias("copies"),
        F.sum(F.col("phrase").cast("long")).alias("places"),
        F.min(F.when(F.col("phrase"), F.col("at"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("at"))).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(found, F.col("label"))))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("phrase"), F.lit(1.0)).otherwise(F.col("share"))), F.lit(0.0)).alias("score"),
    )
    return out.select(
        "doc_id", "n_words", (F.col("places") / F.col("copies")).cast("long").alias("n_base"), "first_word", "last_word",
        "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
