"""The training-corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
``run`` writes the result of each as Parquet in the shared folder and reads it again for the next.

* quality: documents that the classifier rejects (score below 0.3) go. Its field is fitted on the labels of ``sf_dir``.
* near_duplicates: of each SimHash component one row stays, that of the smallest id (rows without an id last).
* substrings: words of passages (13 words or more) that a document with a smaller id also has are cut out; a document
  of which nothing is left goes.
* decontamination: documents that contain a window of a benchmark item go.
* packing: what is left becomes sequences.

Defined results: documents without text pass the first stage, are near duplicates of each other, and are packed as
an end id. Rows that share an id, or have none, are documents of their own to the second stage. An empty
table gives no rows. Columns beyond those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import crf, decontaminate, packing, simhash, substrings
from caseloom.llm.common import fresh, ready, store, table
from caseloom.llm.queries import vocabulary_path

KEEP_FROM = 0.3
#: SQL cannot express the first stage; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    field = crf.train_quality(docs, table(spark, sf_dir, "labels"), F.lit(True))
    score = fresh(docs, "score")
    scored = crf.score_quality(docs, field, docs.columns, score)
    return scored.filter(F.col(score) >= KEEP_FROM).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return simhash.one_of_each(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    words, removed = fresh(docs, "n_words"), fresh(docs, "n_removed")
    cut = substrings.remove_repeats(docs, texts=True, counts=(words, removed))
    cut = cut.filter((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, length).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return decontaminate.without_contamination(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substring_dedup),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
