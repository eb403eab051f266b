"""Near-duplicate vectors by sorted projection passes.

Each pass hashes every vector to the signs of random projections and sorts the vectors of a label by that bit string.
Each vector is compared with its next ``window`` neighbours; of the pairs at or above the cosine threshold a forest
that links the same vectors is kept, and the forests of all passes are united to components. Near vectors share long prefixes, so some pass puts a pair, or a chain of
linked vectors between its ends, within a window.

A window bounds the comparisons of one pass, not the links of a vector: within each component found, every pair is
then compared exactly, so dense groups lose no link. Components are cut into tiles, each pair of tiles is one
group of rows, and only a count per vector leaves it.

What can be missed: a pair that no pass brings together, nor any chain of links. With angle ``a`` a bit differs with
probability a/pi (0.12 at cosine 0.93), so a pass misses a lone pair among n vectors, evenly spread, with a probability of about
1 - 0.88 ** log2(n / window). The largest number of vectors of one label and length gives the number of passes that brings the
product of these down to ``MISS`` (16 passes at 1,000 vectors, 42 at 100,000, 103 at 10 million), so the chance does not
grow with the table. Where many vectors that do not link are close to each other, a pair's chance is worse than that. Passes
run in rounds of ``PASSES``, so that what a round moves does not grow with their number.

The sort is a range partitioning by (pass, label, length, hash, random); the last part spreads equal vectors over tasks. A
window does not cross from one task to the next; the next pass draws other borders.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those with a null
label, link with nothing. Vectors of different lengths do not link. Repeated rows, and rows that share an id, are vectors of their own.
A null ``vec_id`` gives null for its component. An empty table gives no rows. Only ``vec_id``, ``embedding`` and
``label`` are read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.components import components
from caseloom.llm.common import parts, store
from caseloom.llm.simhash import forest

#: Passes of one round, and least number.
PASSES = 16
#: Most that the chance to miss a lone pair at the threshold may be.
MISS = 1e-4
WINDOW = 16
BITS = 64
#: Vectors of one tile.
TILE = 256


def usable(vectors: DataFrame) -> DataFrame:
    """``(row, label, size, v)`` of the vectors that can link, from ``(row, vec_id, embedding, label)``; v as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.filter("vec_id is not null").select("row", "label", v.alias("v")).filter("label is not null and v is not null")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(sound & F.exists("v", lambda x: x != 0)).withColumn("size", F.size("v"))


def _matrix(column) -> np.ndarray:
    """Rows of equal length, scaled to length one."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashes(passes: int, seed: int):
    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, passes * BITS))
                signs = (_matrix(part.column(3)) @ planes[size] > 0).reshape(len(part), passes, BITS)
                packed = np.packbits(signs, axis=2)
                hashes = pa.array([[h.tobytes() for h in row] for row in packed], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, hashes], names=["row", "label", "size", "v", "hashes"])

    return run


def _windows(window: int, threshold: float):
    """Sorted rows (pass, label, size, row, v) -> linked pairs of neighbours."""

    def run(batches):
        keys, ids, vecs = np.empty((0, 3), np.int64), np.empty(0, np.int64), None
        for batch in batches:
            k = np.column_stack([batch.column(i).to_numpy() for i in range(3)]).astype(np.int64)
            i, column = batch.column(3).to_numpy(), batch.column(4)
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(k)]):
                if a == b:
                    continue
                x, own, key = _matrix(column.slice(a, b - a)), i[a:b], k[a]
                old = len(keys) and (keys[-1] == key).all()
                if old:
                    x, own = np.concatenate([vecs, x]), np.concatenate([ids, own])
                skip = len(ids) if old else 0
                first, second = [], []
                for step in range(1, min(window, len(x) - 1) + 1):
                    at = np.arange(max(skip, step), len(x))
                    near = at[(x[at] * x[at - step]).sum(axis=1) >= threshold]
                    first.append(own[near - step])
                    second.append(own[near])
                keys, ids, vecs = np.tile(key, (1, 1)), own[-window:], x[-window:]
                if first:
                    p, q = forest(np.concatenate(first), np.concatenate(second))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    return run


def _count_links(threshold: float):
    def run(pdf):
        out = []
        for _, g in pdf.groupby(["component", "size", "label"], sort=False):
            x = np.stack(g["v"].to_numpy())
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            left, right = g["side"].to_numpy() != 1, g["side"].to_numpy() != 0
            same = left & right
            ids = g["row"].to_numpy()
            for a in range(0, int(left.sum()), TILE):
                rows = np.flatnonzero(left)[a : a + TILE]
                near = x[rows] @ x[right].T >= threshold
                if same.all():  # a tile with itself: a vector is no neighbour of its own
                    near[np.arange(len(rows)), rows] = False
                    out.append((ids[rows], near.sum(axis=1)))
                else:
                    out.append((ids[rows], near.sum(axis=1)))
                    out.append((ids[right], near.sum(axis=0)))
        if not out:
            return pd.DataFrame({"row": np.empty(0, np.int64), "n": np.empty(0, np.int64)})
        return pd.DataFrame({"row": np.concatenate([o[0] for o in out]), "n": np.concatenate([o[1] for o in out])})

    return run


def passes_for(n: int, threshold: float, window: int = WINDOW) -> int:
    """Passes after which a lone pair at the threshold, among ``n`` vectors, is missed with a chance of ``MISS`` at most."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    found = same ** max(0.0, math.log2(max(n, 1) / window))
    return PASSES if found >= 1 else max(PASSES, math.ceil(math.log(MISS) / math.log1p(-found)))


def linked_pairs(rows: DataFrame, threshold: float, passes: int | None = None, window: int = WINDOW, seed: int = 7) -> DataFrame:
    """Usable rows -> distinct pairs ``(a, b)`` that link what the passes found; as many passes as the largest label needs."""
    if passes is None:
        most = rows.groupBy("label", "size").count().agg(F.max("count")).first()[0]
        passes = passes_for(most or 0, threshold, window)
    rounds = [store(_round(rows, threshold, min(PASSES, passes - a), window, seed + a)) for a in range(0, passes, PASSES)]
    pairs = rounds[0]
    for more in rounds[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _round(rows: DataFrame, threshold: float, passes: int, window: int, seed: int) -> DataFrame:
    spark = rows.sparkSession
    hashed = rows.select("row", "label", "size", "v").mapInArrow(
        _hashes(passes, seed), "row long, label long, size int, v array<double>, hashes array<binary>"
    )
    hashed = store(hashed)
    every = hashed.select("row", "label", "size", "v", F.posexplode("hashes").alias("pass", "hash"))
    every = every.withColumn("spread", F.xxhash64("row", "pass"))
    order = ["pass", "label", "size", "hash", "spread"]
    every = every.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    pairs = every.select("pass", "label", "size", "row", "v").mapInArrow(_windows(window, threshold), "a long, b long")
    return pairs.filter("a <> b").distinct()


def near_vectors(vectors: DataFrame, threshold: float = 0.93, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> ``(vec_id, n_links, component_id, kept)``, one row per row."""
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long"))
    vectors = store(vectors.withColumn("row", F.monotonically_increasing_id()))  # ids may repeat
    rows = usable(vectors)
    pairs = store(linked_pairs(rows, threshold, passes, window))
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    roots = store(components(nodes, pairs).select(F.col("id").alias("row"), F.col("root").alias("component")))
    members = store(rows.join(roots, "row"))
    tiles = members.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    small = max(4 * parts(vectors.sparkSession), members.count() // (8 * TILE))
    members = members.join(store(tiles), "component")
    # component of one tile: many of them in a group; larger ones: each pair of tiles is a group
    own = F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda j: F.struct(
            F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(j == own, 2).when(own < j, 0).otherwise(1).alias("side")
        ),
    )
    members = members.withColumn("t", F.explode(others)).select("component", "label", "size", "row", "v", "tiles", "t.*")
    deal = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("component"), F.lit(small))).otherwise(F.xxhash64("component", "i", "j"))
    counts = members.withColumn("deal", deal).groupBy("deal", F.when(F.col("tiles") > 1, F.col("i")).alias("ti"), F.when(F.col("tiles") > 1, F.col("j")).alias("tj"))
    counts = counts.applyInPandas(_count_links(threshold), "row long, n long").groupBy("row").agg(F.sum("n").alias("n_links"))
    info = vectors.select("row", "vec_id").join(roots, "row")
    least = info.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    info = info.select("row", "component").join(least, "component").join(counts, "row", "left")
    out = vectors.select("row", "vec_id").join(store(info), "row", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )
