"""Hard negatives of anchor vectors by anchor spanning-tree bounds.

Components become integers, ``floor(256 * x)``, and scores are integer inner products, so that every comparison is exact.
Anchors are sorted by the signs of random projections and cut into trees of ``TREE`` anchors. A tree is the minimum
spanning tree of its anchors and the origin, which scores 0 with everything. With edge length ``d`` from a parent to its child
and a candidate of norm ``|c|``, the child's score lies within ``d * |c|`` of the parent's (Cauchy-Schwarz). Going down a tree,
only candidates whose bounds overlap what the child still looks for are rescored; the others hand their bounds on.

Two walks: the first finds each anchor's best rows of the same label (its positives; the window is everything at least as good
as the ``POSITIVES``-th best so far), the second the best rows of other labels whose score lies in a window below a
positive's score. Both windows rise while a cell is read.

The work is a grid of cells, a part of the rows against a part of the trees, with ``CELL_ROWS`` and ``CELL_ANCHORS`` at most, so the
memory of a task is bounded and what moves is rows x (trees' parts) + anchors x (rows' parts). Rows are dealt by a hash of their
number: a frequent label or copies of one vector do not gather anywhere. A cell hands on a few rows per anchor, which are ranked
per anchor at the end.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. Vectors of different
lengths do not meet; empty ones score 0 with each other. Repeated rows are rows of their own, and each repeated anchor gives
its rows again. A null ``vec_id`` is no anchor, may be found, and comes last among ties (it is taken as the largest long).
Integers are held to +-2**24, so that scores fit a long. An empty table gives no rows. Only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import parts, store

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: A negative's score in hundredths of the positive's, least and most.
WINDOW = (80, 100)
TREE = 512
CELL_ROWS = 1 << 18
CELL_ANCHORS = 1 << 16
#: Rows of a cell that are walked together.
STEP = 8192
_MOST = 1 << 24
_NO_ID = (1 << 63) - 1

ROWS = "row long, vec_id long, label long, size int, v binary"
TREES = "tree long, size int, rows binary, ids binary, labels binary, v binary, parents binary, lengths binary"
POSITIVE = "tree long, anchor long, anchor_id long, found long, score long"
NEGATIVE = "anchor long, positive_score long, found long, score long"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part; v as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    return rows.filter("label is not null and v is not null").filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _quantised(batches):
    """Rows get a number and integers as bytes, two or four each."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        column = batch.column(2)
        sizes = pa.compute.list_value_length(column).to_numpy()
        with np.errstate(over="ignore"):
            flat = np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False) * float(SCALE)), -_MOST, _MOST).astype("<i4")
        kind = "<i2" if not len(flat) or np.abs(flat).max() < 1 << 15 else "<i4"
        data, width = flat.astype(kind).tobytes(), np.dtype(kind).itemsize
        ends = np.cumsum(sizes) * width
        vectors = [data[b - n * width : b] for b, n in zip(ends.tolist(), sizes.tolist())]
        rows = pa.array(number + np.arange(len(batch)))
        number += len(batch)
        yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(vectors, pa.binary())], schema=_schema(ROWS))


def _matrix(vectors: list[bytes], size: int) -> np.ndarray:
    """Integer rows of one length."""
    out = np.empty((len(vectors), size), np.int32)
    widths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        if size:
            out[at] = np.frombuffer(b"".join([vectors[k] for k in at]), f"<i{width // size}").reshape(len(at), size)
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, rounded up."""
    x = x.astype(float)
    return np.sqrt(np.einsum("ij,ij->i", x, x)) * (1 + 1e-12)


def _sort_keys(bits: int, seed: int):
    """Puts the signs of random projections behind each row."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes, vectors = batch.column(3).to_numpy(), batch.column(4).to_pylist()
            keys: list = [b""] * len(vectors)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, bits))
                signs = np.packbits(_matrix([vectors[k] for k in at], size) @ planes[size] > 0, axis=1)
                for k, s in zip(at, signs):
                    keys[k] = s.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "key"])

    return run


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parents, edge lengths rounded up) of the minimum spanning tree of the rows and the origin.

    ``order`` lists the rows so that parents come first; a parent is a place in it, -1 for the origin.
    """
    x = x.astype(float)
    n = len(x)
    squares = np.einsum("ij,ij->i", x, x)
    best, parent = squares.copy(), np.full(n, -1)
    order, parents, lengths = np.empty(n, np.int64), np.empty(n, np.int32), np.empty(n)
    for k in range(n):
        at = int(np.argmin(best))
        order[k], parents[k], lengths[k] = at, parent[at], np.sqrt(max((best[at], 0)))
        away = ((x - x[at]) ** 2).sum(axis=1)
        nearer = (away < best) & np.isfinite(best)
        best[nearer], parent[nearer] = away[nearer], k
        best[at] = np.inf
    return order, parents, lengths * (1 + 1e-9)


def _trees(batches):
    """Sorted anchors -> one row per tree."""
    number, kept = TaskContext.get().partitionId() << 33, []

    def row(chunk):
        nonlocal number
        size = chunk[0][3]
        x = _matrix([r[4] for r in chunk], size)
        order, parents, lengths = spanning_tree(x)
        columns = [np.array([r[k] for r in chunk], "<i8")[order].tobytes() for k in range(3)]
        number += 1
        return (number - 1, size, *columns, x[order].astype("<i4").tobytes(), parents.astype("<i4").tobytes(), lengths.astype("<f8").tobytes())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _schema(TREES))], schema=_schema(TREES))

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns[:5])):
            if kept and (len(kept) == TREE or kept[0][3] != r[3]):
                yield batch([row(kept)])
                kept = []
            kept.append(r)
    if kept:
        yield batch([row(kept)])


class _Tree:
    def __init__(self, number, size, rows, ids, labels, v, parents, lengths):
        self.number, self.size = number, size
        self.rows, self.ids, self.labels = (np.frombuffer(x, "<i8") for x in (rows, ids, labels))
        self.x = np.frombuffer(v, "<i4").reshape(len(self.rows), size)
        self.parents, self.lengths = np.frombuffer(parents, "<i4"), np.frombuffer(lengths, "<f8")
        order = np.argsort(self.parents, kind="stable")
        heads, first = np.unique(self.parents[order], return_index=True)
        self.families = list(zip(heads.tolist(), np.split(order, first[1:]))) if len(order) else []

    def walk(self, x: np.ndarray, norms: np.ndarray, kind, overlap, take) -> int:
        """Goes down the tree with the candidates ``x``.

        ``overlap(child, low, high)``: which candidates a child must know exactly. ``take(child, places, scores)`` gets them.
        Returns how many scores were computed.
        """
        own, zero = self.x.astype(kind), np.zeros(len(norms))
        known = {-1: (zero, zero)}
        heads, work = {h for h, _ in self.families}, 0
        for head, family in self.families:
            low, high = known.pop(head)
            for a in range(0, len(family), 64):
                children = family[a : a + 64]
                slack = self.lengths[children, None] * norms
                lows, highs = low - slack, high + slack
                needed = np.stack([overlap(c, lo, hi) for c, lo, hi in zip(children, lows, highs)])
                some = np.flatnonzero(needed.any(axis=0))
                scores = own[children] @ x[some].T
                work += scores.size
                for k, c in enumerate(children):
                    mine = needed[k, some]
                    take(c, some[mine], scores[k, mine].astype(np.int64))
                    if c in heads:
                        lows[k, some] = highs[k, some] = scores[k]
                        known[int(c)] = (lows[k].copy(), highs[k].copy())
        return work


class _Best:
    """The best few (score, id) of one anchor's window, higher scores first, then smaller ids."""

    def __init__(self, low: float, high: float, most: int):
        self.low, self.high, self.most = low, high, most
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = (scores >= self.low) & (scores <= self.high)
        if not inside.any():
            return
        scores, ids = np.concatenate([self.scores, scores[inside]]), np.concatenate([self.ids, ids[inside]])
        if len(scores) > 8 * self.most:  # a full sort is needed only of what can stay
            least = np.partition(scores, len(scores) - self.most)[len(scores) - self.most]
            scores, ids = scores[scores >= least], ids[scores >= least]
        first = np.lexsort((ids, -scores))[: self.most]
        self.scores, self.ids = scores[first], ids[first]
        if len(first) == self.most:
            self.low = max(self.low, int(self.scores[-1]))


def _kind(most: float):
    """A number type in which scores up to ``most``, and every partial sum, are exact."""
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def _window(positive_score: int) -> _Best:
    low, high = -((-WINDOW[0] * positive_score) // 100), WINDOW[1] * positive_score // 100
    return _Best(low, high, NEGATIVES)


def _cell(positive: bool):
    out = _schema(POSITIVE if positive else NEGATIVE)

    def run(key, rows, trees):
        if not rows.num_rows or not trees.num_rows:
            return out.empty_table()
        found = []
        forest = [_Tree(*r) for r in zip(*(trees.column(c).to_pylist() for c in _schema(TREES).names))]
        is_window = pa.compute.is_null(rows.column("v"))
        wanted: dict[int, set] = {}
        for anchor, score in zip(*(rows.filter(is_window).column(c).to_pylist() for c in ("row", "vec_id"))):
            wanted.setdefault(anchor, set()).add(score)
        rows = rows.filter(pa.compute.invert(is_window))
        number, ids, labels, sizes = (rows.column(c).to_numpy() for c in ("row", "vec_id", "label", "size"))
        vectors = rows.column("v").to_pylist()
        for size in np.unique(sizes):
            mine = [t for t in forest if t.size == size]
            at = np.flatnonzero(sizes == size)
            best: dict[int, dict] = {}  # of each anchor, what it looks for, by the positive's score
            for row in (row for t in mine for row in t.rows.tolist()):
                best[row] = {None: _Best(-np.inf, np.inf, POSITIVES)} if positive else {s: _window(s) for s in wanted.get(row, ())}
            for a in range(0, len(at), STEP):
                part = at[a : a + STEP]
                x = _matrix([vectors[k] for k in part], size)
                norms, own, names, rowno = _norms(x), labels[part], ids[part], number[part]
                for t in mine:
                    kind = _kind(float(norms.max(initial=0)) * float(_norms(t.x).max(initial=0)))

                    def overlap(c, low, high, t=t, best=best):
                        hit = np.zeros(len(low), bool)
                        for b in best[int(t.rows[c])].values():
                            hit |= (high >= b.low) & (low <= b.high)
                        return hit & ((own == t.labels[c]) == positive)

                    def take(c, places, scores, t=t, best=best):
                        if positive:
                            other = rowno[places] != t.rows[c]
                            places, scores = places[other], scores[other]
                        for b in best[int(t.rows[c])].values():
                            b.add(scores, names[places])

                    t.walk(x.astype(kind), norms, kind, overlap, take)
            for t in mine:
                for row, name in zip(t.rows.tolist(), t.ids.tolist()):
                    for wish, b in best[row].items():
                        head = (t.number, row, name) if positive else (row, wish)
                        found += [(*head, i, score) for i, score in zip(b.ids.tolist(), b.scores.tolist())]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out) if found else out.empty_table()

    return run


def plant_trees(anchors: DataFrame, n: int, seed: int = 11, bits: int = 32) -> DataFrame:
    """Anchor rows (``n`` of them) -> one row per tree; near anchors come into one tree, mostly."""
    keyed = anchors.mapInArrow(_sort_keys(bits, seed), ROWS + ", key binary")
    order = ["size", "key", "row"]
    keyed = keyed.repartitionByRange(max(1, min(parts(anchors.sparkSession), -(-n // TREE))), *order).sortWithinPartitions(*order)
    return store(keyed.mapInArrow(_trees, TREES))


def _meet(rows: DataFrame, trees: DataFrame, n_rows: int, n_trees: int, positive: bool) -> DataFrame:
    """Each part of the rows (given as ``part``, or to all parts if that is null) with each part of the trees (``side``, likewise)."""

    def dealt(df, column, n):
        every = F.sequence(F.lit(0), F.lit(n - 1))
        return df.withColumn(column, F.explode(F.when(F.col(column).isNull(), every).otherwise(F.array(column))))

    rows = dealt(dealt(rows, "part", n_rows), "side", n_trees)
    trees = dealt(trees, "part", n_rows)
    return rows.groupBy("part", "side").cogroup(trees.groupBy("part", "side")).applyInArrow(_cell(positive), POSITIVE if positive else NEGATIVE)


def hard_negatives(vectors: DataFrame, label: Column | None = None, every: int = 100) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> each anchor's positives with their ranked negatives.

    Anchors are the rows whose ``vec_id`` is divisible by ``every``; ``label`` may replace the column of that name. Returns
    ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.
    """
    spark = vectors.sparkSession
    rows = store(usable(vectors, F.col("label") if label is None else label).mapInArrow(_quantised, ROWS))
    is_anchor = (F.col("vec_id") % every == 0) & (F.col("vec_id") != _NO_ID)
    n, n_anchors = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    trees = plant_trees(rows.filter(is_anchor), n_anchors)
    n_trees = max(1, -(-n_anchors // CELL_ANCHORS))
    n_rows = max(1, -(-n // CELL_ROWS), min(2 * parts(spark) // n_trees, n // (STEP // 2)))
    nothing = F.lit(None).cast("int")
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    dealt = rows.withColumn("part", deal("row", n_rows)).withColumn("side", nothing)
    forest = trees.withColumn("part", nothing).withColumn("side", deal("tree", n_trees))

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "found")
    positives = _meet(dealt, forest, n_rows, n_trees, True).withColumn("k", F.row_number().over(best)).filter(F.col("k") <= POSITIVES)
    positives = store(positives.select("tree", "anchor", "anchor_id", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = positives.select("anchor", "tree", "positive_score").distinct().select(
        F.col("anchor").alias("row"), F.col("positive_score").alias("vec_id"), F.lit(0).cast("long").alias("label"), F.lit(0).alias("size"),
        F.lit(None).cast("binary").alias("v"), nothing.alias("part"), deal("tree", n_trees).alias("side"),
    )
    best = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "found")
    found = _meet(dealt.unionByName(windows), forest, n_rows, n_trees, False).withColumn("rank", F.row_number().over(best))
    found = found.filter(F.col("rank") <= NEGATIVES).withColumnRenamed("score", "negative_score")
    name = lambda c: F.nullif(F.col(c), F.lit(_NO_ID))
    return positives.join(found, ["anchor", "positive_score"]).select(
        "anchor_id", name("positive_id").alias("positive_id"), "rank", name("found").alias("negative_id"), "positive_score", "negative_score"
    )
