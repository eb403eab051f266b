"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.llm import crf, oracles, packing, simhash, warc
from caseloom.llm.common import store, table
from caseloom.llm.conversations import damage, repair_conversations
from caseloom.llm.decontaminate import find_contamination
from caseloom.llm.languages import identify, learn_profiles
from caseloom.llm.licenses import PHRASES, TEMPLATES, scan_licenses
from caseloom.llm.negatives import hard_negatives
from caseloom.llm.registry import query
from caseloom.llm.sharding import shard_documents
from caseloom.llm.substrings import remove_repeats
from caseloom.llm.suffix_lm import score_texts
from caseloom.llm.vectors import near_vectors


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_vectors", oracles.OP1)
def op1_vectors(spark, d):
    return near_vectors(table(spark, d, "embeddings"))


@query("op2_warc", oracles.OP2)
def op2_warc(spark, d):
    pages = table(spark, d, "pages")
    manifest = warc.write_warc(pages, warc.archive_folder(spark))
    rows = warc.read_warc(manifest, payloads=False)
    problem = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("damaged record: "), "problem")))
    return rows.select(
        warc.page_id(F.col("record_id")).alias("page_id"),
        F.coalesce(problem.cast("long"), "payload_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        warc.page_id(F.col("refers_to")).alias("refers_to"),
    )


@query("op3_sharding")
def op3_sharding(spark, d):
    return shard_documents(table(spark, d, "documents"))


@query("op4_packing")
def op4_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), vocabulary_path())


@query("op5_suffix_lm")
def op5_suffix_lm(spark, d):
    return score_texts(table(spark, d, "documents"))


@query("op6_decontamination", oracles.OP6)
def op6_decontamination(spark, d):
    return find_contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op7_substrings", oracles.OP7)
def op7_substrings(spark, d):
    return remove_repeats(table(spark, d, "documents"))


@query("op8_licenses", oracles.license_sql(PHRASES, TEMPLATES))
def op8_licenses(spark, d):
    return scan_licenses(table(spark, d, "documents"))


@query("op9_simhash")
def op9_simhash(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


@query("op10_quality")
def op10_quality(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    field = crf.train_quality(docs, labels, ~crf.held_out(F.col("doc_id"), 5, 0))
    scored = crf.score_quality(docs, field, ["doc_id"])
    return scored.select(
        "doc_id",
        crf.held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op11_negatives", oracles.OP11)
def op11_negatives(spark, d):
    label = F.col("label").cast("long")
    return hard_negatives(table(spark, d, "embeddings"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


@query("op12_languages")
def op12_languages(spark, d):
    docs, held = table(spark, d, "documents"), crf.held_out(F.col("doc_id"), 4, 2)
    named = identify(docs, store(learn_profiles(docs, ~held)), ["doc_id"])
    return named.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op13_conversations", oracles.OP13)
def op13_conversations(spark, d):
    return repair_conversations(damage(table(spark, d, "conversations")))
