"""One-to-one matching of numbers on a line, whole logs at a time.

Between neighbouring values of the union, let y be how many more values of the longer side than of the shorter side lie below. If the
longer side has ``free`` values too many, a matching leaves t of them unused below, with t rising from 0 to ``free``, and costs |y - t|
over every gap: the best matching is the L1 isotonic regression of y. (Its steps never exceed y's own, so they can always be
taken by values of the longer side.) Such a regression splits by thresholds: for each level, t passes it at the one place with the least
weight of gaps on the wrong side, which is a smallest prefix sum of the gaps, signed by whether y has reached the level.

Smallest prefix sums of consecutive pieces add up like (sum, smallest prefix) pairs, so a group of gaps is known by these two numbers
as functions of the level; they are constant between the group's own values of y, and trivial outside. Groups are joined in a
tree, ``FAN`` at a time and per block of levels, so no task sees a whole run. Equal values cancel in the counts before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import ordered as O
from caseloom.session import store

#: Values of a group, of its smallest parts, and groups that are joined at once.
GROUP, PART, FAN = 16_384, 256, 64
#: Levels of a block, least, and blocks of a run, at most.
LEVELS, BLOCKS = 1024, 4096

NODE = "k long, block long, lo long, hi long, w long, ends array<long>, lens array<long>, sums array<long>, lows array<long>"


class Node:
    """A stretch of gaps: least and largest y, their weight, and (sum, smallest prefix) up to each of ``ends``."""

    def __init__(self, lo, hi, w, ends, sums, lows):
        self.lo, self.hi, self.w, self.ends, self.sums, self.lows = lo, hi, w, ends, sums, lows

    def at(self, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ends):
            k = np.minimum(np.searchsorted(self.ends, levels), len(self.ends) - 1)
            sums, lows = self.sums[k], self.lows[k]
        else:
            sums = lows = np.zeros(len(levels), np.int64)
        low, high = levels <= self.lo, levels > self.hi
        return np.where(low, self.w, np.where(high, -self.w, sums)), np.where(low, 0, np.where(high, -self.w, lows))


def leaf(y: np.ndarray, w: np.ndarray) -> Node:
    own = np.unique(y)
    run = np.cumsum(np.where(y >= own[1:, None], w, -w), axis=1)
    return Node(int(own[0]), int(own[-1]), int(w.sum()), own[1:], run[:, -1], np.minimum(run.min(axis=1, initial=0), 0))


def joined(nodes: list[Node], low: int | None = None, high: int | None = None) -> Node:
    """Consecutive stretches as one, for the levels in (low, high]."""
    lo, hi = min(n.lo for n in nodes), max(n.hi for n in nodes)
    a, b = lo if low is None else max(lo, low), hi if high is None else min(hi, high)
    ends = np.unique(np.concatenate([np.array([n.lo, n.hi]) for n in nodes] + [n.ends for n in nodes] + [np.array([b])]))
    ends = ends[(ends > a) & (ends <= b)].astype(np.int64)
    before, least = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    for n in nodes:
        sums, lows = n.at(ends)
        least = np.minimum(least, before + lows)
        before = before + sums
    return Node(lo, hi, sum(n.w for n in nodes), ends, before, least)


def _rows(node: Node, k: int, free: int, width: int) -> list[tuple]:
    """A summary, and the node's ends by blocks of levels from 1 to ``free``."""
    out = [(k, -1, node.lo, node.hi, node.w, None, None, None, None)]
    a, b = max(node.lo, 0), min(node.hi, free)
    if a >= b:
        return out
    borders = np.arange(a // width + 1, (b - 1) // width + 1) * width
    ends = np.unique(np.concatenate([node.ends[(node.ends > a) & (node.ends < b)], borders, [b]])).astype(np.int64)
    lens, (sums, lows), block = np.diff(ends, prepend=a), node.at(ends), (ends - 1) // width
    cuts = np.flatnonzero(np.diff(block)) + 1
    for e, n, s, m in zip(*(np.split(x, cuts) for x in (ends, lens, sums, lows))):
        out.append((k, int((e[0] - 1) // width), None, None, None, e.tolist(), n.tolist(), s.tolist(), m.tolist()))
    return out


def _frame(run, free: int, width: int, rows: list[tuple]) -> pd.DataFrame:
    names = [f.split()[0] for f in NODE.split(", ")]
    out = pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in names[:5]})
    out.insert(0, "run", [run] * len(out))
    return out.assign(free=free, width=width)


def _group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("v")
    y, w = pdf["y"].to_numpy(np.int64), pdf["w"].to_numpy(np.int64)
    node = joined([leaf(y[a : a + PART], w[a : a + PART]) for a in range(0, len(y), PART)])
    free, width = int(pdf["free"].iloc[0]), int(pdf["width"].iloc[0])
    return _frame(pdf["run"].iloc[0], free, width, _rows(node, int(pdf["k"].iloc[0]), free, width))


def _join(pdf: pd.DataFrame) -> pd.DataFrame:
    """The groups of one parent, for one block of levels."""
    pdf = pdf.sort_values("k")
    none, nodes = np.empty(0, np.int64), []
    for r in pdf.itertuples():
        known = r.ends is not None
        arrays = [np.asarray(x, np.int64) if known else none for x in (r.ends, r.sums, r.lows)]
        nodes.append(Node(int(r.lo), int(r.hi), int(r.w), *arrays))
    free, width, block = int(pdf["free"].iloc[0]), int(pdf["width"].iloc[0]), int(pdf["block"].iloc[0])
    node = joined(nodes, block * width, min((block + 1) * width, free))
    rows = _rows(Node(max(node.lo, block * width), min(node.hi, (block + 1) * width), node.w, node.ends, node.sums, node.lows), int(pdf["parent"].iloc[0]), free, width)
    return _frame(pdf["run"].iloc[0], free, width, rows[1:])


def gaps(one: DataFrame, many: DataFrame) -> DataFrame:
    """``one(v)``, ``many(run, v)`` -> ``(run, pairs, free, width, v, y, w)``: the gaps behind each value of a run's union with ``one``."""
    a = one.filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    b = many.filter("v is not null").groupBy("run", "v").agg(F.count("*").alias("n"))
    size = a.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("of_one"))
    runs = O.sized(b.groupBy("run").agg(F.sum("n").alias("of_run")).crossJoin(size))  # one row per run
    sign = F.when(F.col("of_one") >= F.col("of_run"), 1).otherwise(-1)
    both = runs.select("run").crossJoin(a).unionByName(b.withColumn("n", -F.col("n")))  # every run is matched with the whole of ``one``
    net = both.groupBy("run", "v").agg(F.sum("n").alias("n")).filter("n <> 0")
    net = O.null_join(net, runs, ["run"], "inner").withColumn("n", F.col("n") * sign)
    free = F.abs(F.col("of_one") - F.col("of_run"))
    net = net.withColumns({"pairs": F.least("of_one", "of_run"), "free": free, "width": F.greatest(F.lit(LEVELS), F.ceil(free / BLOCKS))})
    net = O.segment(net, ["run"], "v")
    net = O.neighbours(O.scan(net, ["run"], ["v"], {"y": ("sum", F.col("n"), "upto")}), ["run"], ["v"], next={"after": "v"})
    return net.select("run", "pairs", "free", "width", "v", "y", F.coalesce(F.col("after") - F.col("v"), F.lit(0)).alias("w"), *[c for c in net.columns if c == O.SEG])


def match_on_line(one: DataFrame, many: DataFrame) -> DataFrame:
    """``(run, pairs, cost)``: least total difference of a one-to-one matching of each run's numbers with ``one``'s.

    Runs of which either side has no number give no row. Values are whole numbers.
    """
    runs = many.groupBy("run").agg(F.count("v").alias("of_run"))
    size = one.agg(F.count("v").alias("of_one"))
    pairs = runs.crossJoin(size).select("run", F.least("of_run", "of_one").alias("pairs")).filter("pairs > 0")
    points = store(O.row_index(gaps(one, many), ["run"], ["v"], "rn").drop(O.SEG))
    big = lambda c: c.cast("decimal(38,0)")
    below, above = F.greatest(-F.col("y"), F.lit(0)), F.greatest(F.col("y") - F.col("free"), F.lit(0))
    fixed = points.groupBy("run").agg(F.sum(big(F.col("w")) * big(below + above)).alias("c"))
    kind = dict(points.dtypes)["run"]
    schema = f"run {kind}, {NODE}, free long, width long"
    # without values to spare, all is fixed
    grouped = points.filter("free > 0").withColumn("k", F.expr(f"(rn - 1) div {GROUP}"))
    nodes = store(grouped.groupBy("run", "k").applyInPandas(_group, schema))
    while (nodes.agg(F.max("k")).first()[0] or 0) > 0:
        heads = nodes.filter("block = -1").select("run", "k", "lo", "hi", "w", "free", "width", F.expr(f"k div {FAN}").alias("parent"))
        over = O.sized(heads.groupBy("run", "parent").agg(*[f(c).alias("p_" + c) for f, c in ((F.min, "lo"), (F.max, "hi"), (F.sum, "w"))], F.first("free").alias("free"), F.first("width").alias("width")))
        grid = O.null_join(heads, over.drop("free", "width"), ["run", "parent"], "inner").filter("greatest(p_lo, 0) < least(p_hi, free)")
        grid = grid.withColumn("block", F.explode(F.expr("sequence(greatest(p_lo, 0) div width, (least(p_hi, free) - 1) div width)")))
        grid = O.null_join(grid, nodes.filter("block >= 0").select("run", "k", "block", "ends", "sums", "lows"), ["run", "k", "block"])
        rows = grid.groupBy("run", "parent", "block").applyInPandas(_join, schema)
        none = F.lit(None).cast("array<long>")
        tops = over.select(
            "run", F.col("parent").alias("k"), F.lit(-1).cast("long").alias("block"), F.col("p_lo").alias("lo"), F.col("p_hi").alias("hi"), F.col("p_w").alias("w"),
            *[none.alias(c) for c in ("ends", "lens", "sums", "lows")], "free", "width",
        )
        nodes = store(tops.unionByName(rows))
    weights = nodes.filter("block = -1").select("run", F.col("w").alias("all_w"))
    level = nodes.filter("block >= 0").select("run", F.explode(F.arrays_zip("lens", "sums", "lows")).alias("e"))
    level = O.null_join(level, weights, ["run"], "inner")
    wrong = F.expr("(all_w - e.sums) div 2 + e.lows")  # the weight of gaps on the wrong side
    moved = level.groupBy("run").agg(F.sum(big(F.col("e.lens")) * big(wrong)).alias("c"))
    cost = fixed.unionByName(moved).groupBy("run").agg(F.sum("c").alias("cost"))
    return O.null_join(pairs, cost, ["run"]).select("run", "pairs", F.coalesce("cost", big(F.lit(0))).alias("cost"))
