"""Clustering of vectors: a spherical mixture on partial sums, and mean shift on a grid.

``spherical_mixture`` is expectation-maximisation with one variance per component. A step is one pass: tasks add up responsibilities, weighted
vectors and squares, and k x (dimensions + 3) sums reach the driver. Likelihood never falls, so steps end by its gain alone.

``mean_shift`` has a flat kernel. Seeds are the occupied cells of a grid of one bandwidth. A seed moves to the mean of the points within the bandwidth until
it rests, which happens after finitely many steps. Of resting places within the bandwidth of each other the one with most points stays,
and a point belongs to the nearest place that stays.

Neighbours are found in cells of one radius over the (at most three) widest dimensions: who is near is in a neighbouring cell, so the cells leave nothing
out, and distances are measured in all dimensions. Equal vectors are one with a weight. A cell with many vectors is cut into tiles, so that a group
holds at most about two tiles.

Defined results: null vectors are left out, repeated vectors share a cluster, an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import ordered as O
from caseloom.functions import vec as V
from caseloom.session import store

#: Vectors of one side in a group.
TILE = 1024
#: Added to every variance, so that equal points do not make it zero.
LEAST_VARIANCE = 1e-6


def _points(df: DataFrame) -> DataFrame:
    return store(df.filter("vec is not null").select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec")))


# ---- mixture


class Mixture:
    """Weights, means (k x d) and variances of a spherical mixture; ``gains`` holds the mean log likelihood of each step."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, variances: np.ndarray, gains: list[float]):
        self.weights, self.means, self.variances, self.gains = weights, means, variances, gains

    def log_chances(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density: a row per vector, a column per component."""
        far = (x * x).sum(axis=1)[:, None] - 2 * x @ self.means.T + (self.means**2).sum(axis=1)
        spread = x.shape[1] * np.log(2 * np.pi * self.variances)
        return np.log(self.weights) - (spread + np.maximum(far, 0) / self.variances) / 2


def _partial(model: Mixture | None):
    """Sums by component ``k`` and place ``i``: dimensions from 0, -1 weight, -2 squares, -3 log likelihood."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.vstack(pdf["vec"])
            if model is None:
                r, gain = np.eye(pdf["k"].max() + 1)[pdf["k"]], 0.0
            else:
                p = model.log_chances(x)
                top = p.max(axis=1, keepdims=True)
                total = top + np.log(np.exp(p - top).sum(axis=1, keepdims=True))
                r, gain = np.exp(p - total), total.sum()
            sums = np.hstack([r.T @ x, r.sum(axis=0)[:, None], (r.T @ (x * x).sum(axis=1))[:, None], np.full((r.shape[1], 1), gain)])
            k, i = (g.ravel() for g in np.indices(sums.shape))
            yield pd.DataFrame({"k": k, "i": np.r_[: x.shape[1], -1, -2, -3][i], "x": sums.ravel()})

    return run


def fit_mixture(points: DataFrame, k: int, seed: int = 1, tol: float = 1e-3) -> Mixture | None:
    """A mixture fitted to ``(id, vec)``, starting at k-means; null without points."""
    size = points.select(F.size("vec").alias("d")).first()
    if size is None:
        return None
    d = size["d"]
    middle = {r["i"]: r["m"] for r in points.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()}
    centre = np.array([middle[i] for i in range(d)])
    moved = store(points.select(F.zip_with("vec", F.array(*[F.lit(float(m)) for m in centre]), lambda x, m: x - m).alias("vec")))
    data = moved.withColumn("features", array_to_vector("vec"))
    if k > 1:
        data = KMeans(k=k, seed=seed).fit(data).transform(data)
    start = data.select("vec", (F.col("prediction") if k > 1 else F.lit(0)).alias("k"))
    model, gains = None, []
    while True:
        source = start if model is None else moved
        rows = source.mapInPandas(_partial(model), "k int, i int, x double").groupBy("k", "i").agg(F.sum("x").alias("x")).collect()
        sums = np.zeros((max(r["k"] for r in rows) + 1, d + 3))
        for r in rows:
            sums[r["k"], r["i"]] = r["x"]
        n = sums[:, -1] + 10 * np.finfo(float).eps
        if model is not None:
            gains.append(sums[0, -3] / sums[:, -1].sum())
            if len(gains) > 1 and gains[-1] - gains[-2] < tol:
                return Mixture(model.weights, model.means + centre, model.variances, gains)
        means = sums[:, :d] / n[:, None]
        variances = np.maximum(sums[:, -2] / n - (means**2).sum(axis=1), 0) / d + LEAST_VARIANCE
        model = Mixture(n / n.sum(), means, variances, gains)


def spherical_mixture(df: DataFrame, k: int = 3, seed: int = 1, tol: float = 1e-3) -> DataFrame:
    """``(id, vec)`` -> ``(id, vec, cluster)``: the likeliest component of each vector."""
    points = _points(df)
    model = fit_mixture(points, k, seed, tol)
    if model is None:
        return points.withColumn("cluster", F.lit(0))

    def likeliest(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cluster=model.log_chances(np.vstack(pdf["vec"])).argmax(axis=1))

    return points.mapInPandas(likeliest, f"id {dict(points.dtypes)['id']}, vec array<double>, cluster int")


# ---- neighbours


def _axes(points: DataFrame) -> list[int]:
    """The three widest dimensions."""
    wide = points.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg((F.max("x") - F.min("x")).alias("w")).collect()
    return sorted(r["i"] for r in sorted(wide, key=lambda r: (-r["w"], r["i"]))[:3])


def _meet(left: DataFrame, right: DataFrame, radius: float, axes: list[int]) -> DataFrame:
    """Rows ``(vec, w)`` of both sides (``side`` 0 and 1) by ``cell, ti, tj``: all pairs within the radius share a group, once."""
    cell = F.array(*[F.floor(F.element_at("vec", a + 1) / F.lit(radius * (1 + 1e-9))) for a in axes])
    steps = F.array(*[F.array(*[F.lit(s).cast("long") for s in o]) for o in itertools.product((-1, 0, 1), repeat=len(axes))])
    a = left.select("vec", "w", F.explode(F.transform(steps, lambda o: F.zip_with(cell, o, lambda x, y: x + y))).alias("cell"))
    b = right.select("vec", "w", cell.alias("cell"))
    many = lambda df, out: df.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias(out))
    tiles = store(many(a, "ta").join(many(b, "tb"), "cell"))
    tile = lambda n: F.pmod(F.xxhash64("vec"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.join(tiles, "cell").withColumn("ti", tile("ta")).withColumns({"tj": every("tb"), "side": F.lit(0)})
    b = b.join(tiles, "cell").withColumn("tj", tile("tb")).withColumns({"ti": every("ta"), "side": F.lit(1)})
    return a.unionByName(b).drop("ta", "tb")


def _pairs(left: DataFrame, right: DataFrame, radius: float, axes: list[int], of, schema: str) -> DataFrame:
    """``of(x, wx, y, wy, distances)`` of each group of neighbours."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        x, y = np.vstack(a["vec"]), np.vstack(b["vec"])
        far = np.empty((len(x), len(y)))
        for k in range(0, len(x), 32):  # a few rows at a time keeps the differences in the cache
            far[k : k + 32] = np.sqrt(((x[k : k + 32, None, :] - y[None, :, :]) ** 2).sum(axis=2))
        return of(x, a["w"].to_numpy(), y, b["w"].to_numpy(), far)

    # empty tiles have no partner
    both = _meet(left, right, radius, axes).groupBy("cell", "ti", "tj")
    return both.applyInPandas(lambda pdf: run(pdf) if pdf["side"].nunique() == 2 else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")]), schema)


# ---- mean shift


def _shifted(seeds: DataFrame, points: DataFrame, bandwidth: float, axes: list[int]) -> DataFrame:
    """``(vec, new, n)``: the mean and number of the points within the bandwidth of each seed that has any."""

    def of(x, _, y, w, far):
        near = (far <= bandwidth) * w
        n = near.sum(axis=1)
        some = n > 0
        return pd.DataFrame({"vec": pd.Series(list(x[some]), dtype=object), "s": pd.Series(list((near @ y)[some]), dtype=object), "n": n[some].astype(np.int64)})

    got = store(_pairs(seeds.withColumn("w", F.lit(0).cast("long")), points, bandwidth, axes, of, "vec array<double>, s array<double>, n long"))
    sums = V.sum_vectors(got, ["vec"], "s", "s").join(got.groupBy("vec").agg(F.sum("n").alias("n")), "vec")
    return sums.select("vec", F.transform("s", lambda x: x / F.col("n")).alias("new"), "n")


def _leading(places: DataFrame, bandwidth: float, axes: list[int]) -> DataFrame:
    """Of ranked places ``(vec, w)``, those that have no better one that stays within the bandwidth."""

    def of(x, wx, y, wy, far):
        i, j = np.nonzero((far <= bandwidth) & (wx[:, None] < wy[None, :]))
        return pd.DataFrame({"a": wx[i], "b": wy[j]})

    edges = store(_pairs(places, places, bandwidth, axes, of, "a long, b long"))
    open_, stay = places.select("w"), None
    while open_.limit(1).count():
        live = edges.join(open_.withColumnRenamed("w", "a"), "a").join(open_.withColumnRenamed("w", "b"), "b")
        first = store(open_.join(live.select(F.col("b").alias("w")).distinct(), "w", "left_anti"))
        stay = first if stay is None else stay.unionByName(first)
        gone = edges.join(first.withColumnRenamed("w", "a"), "a").select(F.col("b").alias("w")).unionByName(first)
        open_ = store(open_.join(gone.distinct(), "w", "left_anti"))
    return places.join(stay, "w") if stay is not None else places


def mean_shift(df: DataFrame, bandwidth: float, tol: float = 1e-3) -> DataFrame:
    """``(id, vec)`` -> ``(id, vec, cluster)``; clusters are numbered from 0, that with most points around its place first."""
    all_points = _points(df)
    points = store(all_points.groupBy("vec").agg(F.count("*").alias("w")))
    if not points.limit(1).count():
        return all_points.withColumn("cluster", F.lit(0).cast("long"))
    axes = _axes(points)
    grid = F.transform("vec", lambda x: F.round(x / bandwidth) * bandwidth)
    seeds = store(points.groupBy(grid.alias("seed")).agg(F.min("vec").alias("own")))
    got = store(_shifted(seeds.select(F.col("seed").alias("vec")), points, bandwidth, axes))
    # in many dimensions a cell's middle may meet no point: its least point is the seed then
    lonely = seeds.join(got, seeds["seed"] == got["vec"], "left_anti").select(F.col("own").alias("vec"))
    if lonely.limit(1).count():
        got = got.unionByName(_shifted(store(lonely), points, bandwidth, axes))
    rest = None
    while True:
        got = store(got.withColumn("rests", V.distance(F.col("vec"), F.col("new")) <= tol * bandwidth))
        still = got.filter("rests").select(F.col("new").alias("vec"), "n")
        rest = still if rest is None else rest.unionByName(still)
        moving = store(got.filter("not rests").select(F.col("new").alias("vec")).distinct())
        if not moving.limit(1).count():
            break
        got = _shifted(moving, points, bandwidth, axes)
    # places that differ by rounding are one
    spot = F.transform("vec", lambda x: F.round(x / (bandwidth / 100)))
    places = rest.groupBy(spot.alias("spot")).agg(F.max(F.struct("n", "vec")).alias("m")).select("m.vec", (-F.col("m.n")).alias("most"))
    places = store(O.global_index(store(places), ["most", "vec"], "w").select("vec", "w"))
    places = store(_leading(places, bandwidth, axes))
    places = store(O.global_index(places.withColumnRenamed("w", "old"), ["old"], "w").select("vec", "w"))

    def nearest(x, _, y, w, far):
        at = np.lexsort((np.broadcast_to(w, far.shape), far), axis=1)[:, 0]
        return pd.DataFrame({"vec": pd.Series(list(x), dtype=object), "far": far[np.arange(len(x)), at], "w": w[at]})

    open_, found, radius = points.select("vec", F.lit(0).cast("long").alias("w")), None, bandwidth
    while open_.limit(1).count():
        near = _pairs(open_, places, radius, axes, nearest, "vec array<double>, far double, w long").filter(F.col("far") <= radius)
        near = store(near.groupBy("vec").agg(F.min(F.struct("far", "w")).alias("m")).select("vec", (F.col("m.w") - 1).alias("cluster")))
        found = near if found is None else found.unionByName(near)
        open_ = store(open_.join(near, "vec", "left_anti"))
        radius *= 2
    return all_points.join(found, "vec").select("id", "vec", "cluster")
