"""Activity embeddings: pairs, sentences, factor and token models, weighting, clustering and its scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import ordered as O
from caseloom.functions import vec as V
from caseloom.functions.rand import hash_order, uniform
from caseloom.model import ORDER
from caseloom.operators.clustering import mean_shift, spherical_mixture
from caseloom.operators.profile import shares_per_task, task_names
from caseloom.session import cut, store

#: Distances that a task holds at once.
CELLS = 1 << 22
#: Vectors of a tile, least and most, and tiles that are made before tiles grow.
TILE, MOST, SPREAD = 256, 16_384, 16


def embedding_width(log: DataFrame) -> DataFrame:
    """One row: the fourth root of (tasks times users), rounded up."""
    n = log.agg(F.countDistinct("task").alias("tasks"), F.countDistinct("user").alias("users"))
    return n.withColumn("width", F.ceil(F.round(F.pow(F.col("tasks") * F.col("users"), F.lit(0.25)), 9)).cast("int"))


# ---- pairs


def unobserved_pairs(log: DataFrame, cols: list[str]) -> DataFrame:
    """Category combinations that never occur, numbered 0..m-1. ``cols`` begins with the task."""
    names = F.array(*[F.lit(t) for t in task_names(log)])
    axis = log.select(*cols[1:]).distinct().withColumn("task", F.explode(names))
    free = axis.join(log.select(*cols).distinct(), cols, "left_anti")
    return O.global_index(free, cols, "i").withColumn("i", F.col("i") - 1)


def training_pairs(log: DataFrame, ratio: int = 2, cols: list[str] | None = None, seed: int = 1, positives: int | None = None) -> DataFrame:
    """``(cols, y)``: half of the observed rows (or ``positives``) as 1, and ``ratio`` times as many
    unobserved combinations, drawn with replacement, as 0."""
    cols = cols or ["task", "user"]
    rows = log.select(*cols, "pos").withColumn("h", hash_order(seed, "pos"))
    k = positives if positives is not None else math.ceil(rows.count() / 2)
    pos = O.global_index(rows, ["h", "pos"], "i").filter(F.col("i") <= k)
    free = cut(unobserved_pairs(log, cols))
    m = free.count()
    out = pos.select(*cols, F.lit(1).alias("y"))
    if m:
        draws = log.sparkSession.range(k * ratio).select(F.floor(uniform(seed, "id", F.lit("negative")) * m).alias("i"))
        out = out.unionByName(draws.join(free, "i").select(*cols, F.lit(0).alias("y")))
    return out


def extend_embedding(vectors: DataFrame, tasks: DataFrame, seed: int = 1) -> DataFrame:
    """Append a random vector for every task without one (``vectors(idx, name, vec)``, ``tasks(task)``)."""
    size = vectors.agg(F.max("idx").alias("top"), F.max(F.size("vec")).alias("width"))
    new = tasks.select(F.col("task").alias("name")).distinct().join(vectors.select("name"), "name", "left_anti")
    new = O.global_index(new, ["name"], "k").crossJoin(F.broadcast(size))  # one row
    rnd = F.transform(F.sequence(F.lit(1), F.col("width")), lambda d: uniform(seed, "name", d))
    return vectors.unionByName(new.select((F.col("top") + F.col("k")).alias("idx"), "name", rnd.alias("vec")))


def new_task_pairs(new_tasks: DataFrame, roles_table: DataFrame, role_users: DataFrame, log_size: int, seed: int = 1) -> DataFrame:
    """Pairs (new task, user of its role), drawn with replacement up to 15 % of the log size."""
    pairs = new_tasks.join(roles_table, "task").join(role_users, "role").select("task", "user").distinct()
    pairs = cut(O.global_index(pairs, ["task", "user"], "i"))
    m, n = pairs.count(), math.ceil(log_size * 0.15)
    draws = new_tasks.sparkSession.range(n).select((F.floor(uniform(seed, "id", F.lit("pair")) * m) + 1).alias("i"))
    return draws.join(pairs, "i").select("task", "user", F.lit(1).alias("y"))


# ---- models


def factor_embedding(counts: DataFrame, width: int, col: str = "user", seed: int = 1) -> DataFrame:
    """``(name, vec)`` of the tasks by implicit matrix factorisation of (task, ``col``, n) counts."""
    t = O.global_index(counts.select("task").distinct(), ["task"], "tid")
    u = O.global_index(counts.select(F.col(col).cast("string").alias("other")).distinct(), ["other"], "oid")
    df = counts.select("task", F.col(col).cast("string").alias("other"), F.col("n").cast("float")).join(t, "task").join(u, "other")
    als = ALS(rank=width, maxIter=5, implicitPrefs=True, userCol="oid", itemCol="tid", ratingCol="n", seed=seed)
    f = als.fit(df.select("oid", "tid", "n")).itemFactors
    return f.join(t, f["id"] == t["tid"]).select(F.col("task").alias("name"), F.transform("features", lambda x: x.cast("double")).alias("vec"))


def factor_embedding_times(log: DataFrame, width: int, seed: int = 1) -> DataFrame:
    """Product of the task factors against users and against duration bins (``log`` has ``bin``)."""
    a = factor_embedding(shares_per_task(log, "user"), width, "user", seed)
    b = factor_embedding(shares_per_task(log, "bin"), width, "bin", seed).withColumnRenamed("vec", "v2")
    return a.join(b, "name").select("name", V.product(F.col("vec"), F.col("v2")).alias("vec"))


def sentences(log: DataFrame, kind: str, cols: list[str]) -> DataFrame:
    """``single``: one [values] list per activity; ``full``: one flattened list per case; ``channel``:
    one list per case and column."""
    vals = F.array(*[F.col(c).cast("string") for c in cols])
    if kind == "single":
        return log.select("caseid", "pos", vals.alias("words"))
    df = O.gather(log.withColumn("_v", vals), ["caseid"], ORDER, {"v": "_v"})
    if kind == "full":
        return df.select("caseid", F.flatten("v").alias("words"))
    chan = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.transform("v", _item(k)).alias("words")) for k, c in enumerate(cols)]))
    return df.select("caseid", chan.alias("e")).select("caseid", "e.*")


def _item(k: int):
    return lambda v: v[k]


#: Sentences that one task trains on, at most; the tasks' vectors are put together after each pass.
SENTENCES = 200_000


def token_embedding(words: DataFrame, width: int, window: int = 5, seed: int = 1) -> DataFrame:
    """``(name, vec)`` of every token by skip-gram training over the sentences."""
    tasks = max(1, -(-words.count() // SENTENCES))
    model = Word2Vec(vectorSize=width, minCount=0, windowSize=window, seed=seed, inputCol="words", outputCol="v", maxIter=1, numPartitions=tasks).fit(words)
    return model.getVectors().select(F.col("word").alias("name"), vector_to_array("vector").alias("vec"))


def weighted_embedding(log: DataFrame, tasks: DataFrame, channels: dict[str, DataFrame]) -> DataFrame:
    """vec(task) times, for each channel, the share-weighted sum of its value vectors.

    ``tasks(name, vec)``; ``channels`` maps a column (user, bin) to its ``(name, vec)``. An all-zero sum
    counts as ones.
    """
    out = tasks.select(F.col("name").alias("task"), "vec")
    for col, vectors in channels.items():
        p = shares_per_task(log, col).select("task", F.col(col).cast("string").alias("name"), "share")
        s = V.sum_vectors(p.join(vectors, "name"), ["task"], "vec", "s", F.col("share"))
        ones = F.when(F.forall("s", lambda x: x == 0), F.transform("s", lambda x: F.lit(1.0))).otherwise(F.col("s"))
        out = out.join(s, "task").select("task", V.product(F.col("vec"), ones).alias("vec"))
    return out.withColumnRenamed("task", "name")


# ---- clustering


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform("vec", lambda x: x.cast("double"))))


def clusters(df: DataFrame, method: str, k: int = 3, bandwidth: float | None = None, seed: int = 1) -> DataFrame:
    """``(id, vec, cluster)`` from ``(id, vec)`` by ``kmeans``, ``gmm`` (spherical) or ``mean_shift``."""
    if method == "mean_shift":
        return mean_shift(df, bandwidth)
    if method == "gmm":
        return spherical_mixture(df, k, seed)
    v = _vectors(df)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v).transform(v).select("id", "vec", "cluster")


def _tile_pairs(df: DataFrame) -> DataFrame:
    """Each row with the pairs of tiles ``(ti, tj)``, ti <= tj, that its tile (``at``) is in: any two tiles meet once."""
    n = df.count()
    tiles = max(1, math.ceil(n / min(MOST, max(TILE, math.ceil(n / SPREAD)))))
    own = F.pmod(F.xxhash64("id", F.lit(tiles)), F.lit(tiles)).cast("int")
    every = df.withColumns({"at": own, "_u": F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))})
    return every.withColumns({"ti": F.least("at", "_u"), "tj": F.greatest("at", "_u")}).drop("_u")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances from inner products; where these lose digits (near vectors, or not finite), from the differences."""
    na, nb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)
    out = na + nb
    floor = 1e-5 * out
    out -= 2 * (a @ b.T)
    i, j = np.nonzero(~(out > floor) | ~np.isfinite(out))
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        out[x, y] = ((a[x] - b[y]) ** 2).sum(axis=1)
    return np.sqrt(out, out=out)


def right_vectors(rows: DataFrame, k: int) -> np.ndarray:
    """The first k right singular vectors of ``rows(vec)`` as columns; the largest entry of each is positive.

    Tasks add up products of dimensions; their (dimensions x dimensions) sums reach the driver.
    """

    def products(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf["vec"])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = (g.ravel() for g in np.indices(total.shape))
            yield pd.DataFrame({"i": i, "j": j, "x": total.ravel()})

    sums = rows.select("vec").mapInPandas(products, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    d = max((r["i"] for r in sums), default=-1) + 1
    gram = np.zeros((d, d))
    for r in sums:
        gram[r["i"], r["j"]] = r["x"]
    basis = np.linalg.eigh(gram)[1][:, ::-1][:, :k]
    return basis * np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])]) if d else basis


def decompose(df: DataFrame, method: str, k: int = 3) -> DataFrame:
    """``(id, vec)`` in k dimensions by ``pca`` (centred) or ``svd`` (truncated, not centred)."""
    v = _vectors(df)
    if method == "pca":
        v = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred").fit(v).transform(v)
        out = PCA(k=k, inputCol="centred", outputCol="pc").fit(v).transform(v)
        return out.select("id", vector_to_array("pc").alias("vec"))
    rows = df.filter("vec is not null").select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    basis = right_vectors(rows, k)
    dims = [V.dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in basis[:, c]])) for c in range(basis.shape[1])]
    return rows.select("id", F.array(*dims).alias("vec"))


def silhouette(df: DataFrame) -> DataFrame:
    """One row: the mean silhouette (Euclid) of ``(id, vec, cluster)``; points alone in a cluster give 0."""
    return silhouettes(df, {0: F.col("cluster")}).agg(F.max("silhouette").alias("silhouette"))


def silhouettes(df: DataFrame, clusterings: dict[str, Column]) -> DataFrame:
    """``(method, silhouette)`` of several clusterings of ``(id, vec)``, from one pass over the distances.

    Tiles sum the distances per point and cluster, so no pair leaves its task.
    """
    cols = [f"c{k}" for k in range(len(clusterings))]
    pts = store(df.select("id", "vec", *[c.cast("string").alias(n) for n, c in zip(cols, clusterings.values())]))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pair, one = pdf[["ti", "tj"]].iloc[0], pdf["ti"].iloc[0] == pdf["tj"].iloc[0]
        sides = [pdf[pdf["at"] == t].reset_index(drop=True) for t in ([pair["ti"]] if one else pair)]
        if any(side.empty for side in sides):
            return pd.DataFrame({"id": [], "k": [], "own": [], "other": [], "s": [], "n": []}).astype({"own": str, "other": str})
        x, y = (np.vstack(side["vec"]).astype(float) for side in (sides[0], sides[-1]))
        found = [[pd.factorize(side[c]) for c in cols] for side in sides]  # codes of the clusters, -1 for null
        hots = [[np.eye(len(names) + 1)[:, : len(names)][code] for code, names in f] for f in found]
        wide = [np.hstack(h) for h in hots]
        sums = [np.zeros((len(x), wide[-1].shape[1])), np.zeros((len(y), wide[0].shape[1]))]
        some = max(1, CELLS // len(y))
        for k in range(0, len(x), some):
            d = _distances(x[k : k + some], y)
            sums[0][k : k + some] = d @ wide[-1]
            if not one:
                sums[1] += d.T @ wide[0][k : k + some]
        out = []
        for at, side in enumerate(sides):
            begin, (codes, hot) = 0, (found[at - 1], hots[at - 1])
            for k, c in enumerate(cols):
                names, size = list(codes[k][1]), hot[k].sum(axis=0)
                s = sums[at][:, begin : begin + len(names)]
                begin += len(names)
                if one:  # so that every row has one, whatever the clusters
                    names, size, s = [*names, None], np.r_[size, 0], np.hstack([s, np.zeros((len(s), 1))])
                i, j = (g.ravel() for g in np.indices(s.shape))
                other = np.array(names, dtype=object)
                out.append(pd.DataFrame({"id": side["id"].to_numpy()[i], "k": k, "own": side[c].to_numpy()[i], "other": other[j], "s": s.ravel(), "n": size.astype(int)[j]}))
        return pd.concat(out)

    schema = f"id {dict(pts.dtypes)['id']}, k int, own string, other string, s double, n long"
    part = _tile_pairs(pts).groupBy("ti", "tj").applyInPandas(tile, schema)
    per = part.groupBy("k", "id", "own", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("other")
    ab = per.groupBy("k", "id").agg(
        F.max(F.when(same & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b")
    )
    val = F.when(F.col("a").isNull() | (F.greatest("a", "b") == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    method = F.element_at(F.array(*[F.lit(m) for m in clusterings]), F.col("k") + 1)
    return ab.groupBy("k").agg(F.avg(val).alias("silhouette")).select(method.alias("method"), "silhouette")


def calinski_harabasz(df: DataFrame) -> DataFrame:
    """One row: between-cluster over within-cluster dispersion, from per-dimension sums only."""
    x = df.select("cluster", F.posexplode("vec").alias("k", "x")).withColumn("x", F.col("x").cast("double"))
    per = x.groupBy("cluster", "k").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    tot = per.groupBy("k").agg((F.sum("s") / F.sum("n")).alias("m"))
    d = per.join(tot, "k")
    mean = F.col("s") / F.col("n")
    parts = d.groupBy("cluster").agg(
        F.max("n").alias("n"), F.sum(F.col("n") * (mean - F.col("m")) ** 2).alias("b"), F.sum(F.col("q") - F.col("n") * mean * mean).alias("w")
    )
    s = parts.agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return s.select((F.col("b") * (F.col("n") - F.col("k")) / (F.col("w") * (F.col("k") - 1))).alias("calinski_harabasz"))


def best_clustering(scores: DataFrame, ascending: bool = False) -> DataFrame:
    """The best row by silhouette, then Calinski-Harabasz (highest first unless ``ascending``)."""
    o = [F.col(c).asc() if ascending else F.col(c).desc() for c in ("silhouette", "calinski_harabasz")]
    return scores.orderBy(*o).limit(1)


def scores(df: DataFrame, clusterings: dict[int, Column]) -> DataFrame:
    """``(method, silhouette, calinski_harabasz)`` of clusterings of ``(id, vec)``; a few rows, stored."""
    disperse = None
    for m, c in clusterings.items():
        one = calinski_harabasz(df.withColumn("cluster", c)).withColumn("method", F.lit(m))
        disperse = one if disperse is None else disperse.unionByName(one)
    return cut(disperse.join(silhouettes(df, clusterings), "method", "left").select("method", "silhouette", "calinski_harabasz"))
