"""Benchmark decontamination: a prefix-filtered set join, in Spark SQL only.

A window is ``span`` consecutive words of a benchmark item (a shorter item is one window). Its tokens are shingles of
``SHINGLE`` words. A document can only contain a window if it contains all its shingles, so one necessary shingle is
enough to find it: the rarest one in the corpus (the prefix of a set that must be contained whole has one token).

1. Document shingles that occur in some item are found by an equality join on their hash; all others end there.
2. Those hits give each item shingle's corpus frequency. Windows with a shingle that never occurs are dropped.
3. Hits on a window's rarest shingle propose a place; the shingle's offset in the window gives its start, which must lie inside the
   document (positional and length bounds).
4. The words at that place are compared with the window's.

Item shingles are broadcast up to ``MOST_BROADCAST`` of them, which is counted; beyond, Spark joins by shuffle. Places are
grouped per document and are bounded by its length.

Defined results: a null or empty text has no words; such items are left out. Repeated rows give repeated rows. Items
with equal words count separately. Empty tables give no rows, or rows without hits. Only ``doc_id``, ``item_id`` and
``text`` are read. A null item id is written as an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import fresh, store
from caseloom.llm.words import letter_words

SHINGLE = 3
MOST_BROADCAST = 500_000


def _shingles(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles, in order."""
    tail = [F.slice(words, i + 1, F.greatest(F.size(words) - (k - 1), F.lit(0))) for i in range(k)]
    if k == 1:
        return F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.arrays_zip(*[t.alias(f"w{i}") for i, t in enumerate(tail)]), lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(k)]))


def item_windows(items: DataFrame, span: int) -> DataFrame:
    """``(item_id, words)`` of every window."""
    words = letter_words(F.col("text"))
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - span, F.lit(0)))
    rows = rows.select("item_id", "w", F.explode(starts).alias("s"))
    return rows.select("item_id", F.slice("w", F.col("s") + 1, span).alias("words"))


def contained_windows(docs: DataFrame, items: DataFrame, span: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, places, windows)``.

    rows: ``(doc_id, key, n_words)`` for each row of ``docs``; places: distinct ``(doc_id, key, start, size, words)``;
    windows: distinct ``(item_id, words)``.
    """
    spark = docs.sparkSession
    windows = store(item_windows(items, span).distinct())
    distinct = windows.select("words").distinct()
    k = F.least(F.lit(SHINGLE), F.size("words"))
    shingled = F.when(k == SHINGLE, _shingles(F.col("words"), SHINGLE))
    for size in range(1, SHINGLE):
        shingled = shingled.when(k == size, _shingles(F.col("words"), size))
    tokens = distinct.select("words", k.alias("k"), F.posexplode(shingled).alias("offset", "h"))
    tokens = store(tokens.groupBy("words", "k", "h").agg(F.min("offset").alias("offset")))
    wanted = store(tokens.select("h").distinct())
    sizes = sorted(r["k"] for r in tokens.select("k").distinct().collect())  # 1 to SHINGLE

    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("key"), letter_words(F.col("text")).alias("w"))
    hashes = F.concat(*[F.transform(_shingles(F.col("w"), s), lambda h, i: F.struct(i.alias("at"), h.alias("h"))) for s in sizes]) if sizes else F.array()
    # the first element stands for the row itself, so rows without a hit stay
    own = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("long").alias("h")))
    seen = base.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(own, hashes) if sizes else own).alias("e"))
    seen = seen.select("doc_id", "key", "n_words", "e.at", "e.h")
    found = wanted.withColumnRenamed("h", "item_h")
    if wanted.count() <= MOST_BROADCAST:
        found = F.broadcast(found)
    seen = seen.join(found, F.col("h") == F.col("item_h"), "left").filter("at < 0 or item_h is not null").drop("item_h")
    seen = store(seen)
    rows = seen.filter("at < 0").select("doc_id", "key", "n_words")
    hits = seen.filter("at >= 0")

    often = hits.groupBy("h").agg(F.count("*").alias("often"))
    ranked = tokens.join(often, "h", "left")
    prefix = ranked.groupBy("words").agg(
        F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "h", "offset")).alias("rarest")
    )
    prefix = store(prefix.filter("rarest.often > 0").select("words", "rarest.h", "rarest.offset"))
    start = (F.col("at") - F.col("offset")).alias("start")
    places = hits.join(prefix, "h").select("doc_id", "key", "n_words", start, "words")
    places = places.filter((F.col("start") >= 0) & (F.col("start") + F.size("words") <= F.col("n_words")))
    places = places.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "words")).alias("places"))
    places = store(places)
    again = docs.select("doc_id", F.xxhash64(text).alias("key"), "text").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.key") == F.col("p.key"))
    checked = places.alias("p").join(again, same).select("p.doc_id", "p.key", "places", "text")
    checked = checked.withColumn("w", letter_words(F.col("text"))).drop("text")
    right = F.filter("places", lambda p: F.slice(F.col("w"), p["start"] + 1, F.size(p["words"])) == p["words"])
    checked = checked.select("doc_id", "key", F.explode(right).alias("p"))
    checked = checked.select("doc_id", "key", "p.start", F.size("p.words").alias("size"), "p.words").distinct()
    return rows, checked, windows


def _covered(places: Column) -> Column:
    """Number of words inside any of the sorted places (start, size)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, p):
        end = F.greatest(acc["end"], p["start"] + p["size"])
        more = F.greatest(end - F.greatest(acc["end"], p["start"]), F.lit(0)).cast("long")
        return F.struct(end.alias("end"), (acc["n"] + more).alias("n"))

    return F.aggregate(places, zero, step)["n"]


def find_contamination(docs: DataFrame, items: DataFrame, span: int = 10) -> DataFrame:
    """``docs(doc_id, text)``, ``items(item_id, text)`` -> hit words and items of each row of ``docs``."""
    rows, places, windows = contained_windows(docs, items, span)
    places = store(places)
    words = places.groupBy("doc_id", "key").agg(_covered(F.array_sort(F.collect_set(F.struct("start", "size")))).alias("n_hit"))
    of_items = places.select("doc_id", "key", "words").distinct().join(windows, "words")
    of_items = of_items.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = words.alias("a").join(of_items.alias("b"), (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))) & (F.col("a.key") == F.col("b.key")))
    hit = store(hit.select("a.doc_id", "a.key", "n_hit", "items"))
    joined = rows.alias("r").join(hit.alias("h"), (F.col("r.doc_id").eqNullSafe(F.col("h.doc_id"))) & (F.col("r.key") == F.col("h.key")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "r.doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_contamination(docs: DataFrame, items: DataFrame, span: int = 10) -> DataFrame:
    """The rows of ``docs`` that contain no window of an item."""
    _, places, _ = contained_windows(docs, items, span)
    doc, key = fresh(docs, "hit_doc"), fresh(docs, "hit_key")
    hit = store(places.select(F.col("doc_id").alias(doc), F.col("key").alias(key)).distinct())
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(doc)) & (own == F.col(key)), "left_anti")
