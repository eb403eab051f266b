"""Activity and resource profiles, distributions, roles, calendars."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import ordered as O
from caseloom.functions import times as T
from caseloom.functions.components import components
from caseloom.functions.quantiles import quantiles
from caseloom.model import END, START, SYSTEM_USER
from caseloom.session import store

# Distribution names of the parameter tables.
NORMAL, LOGNORMAL, GAMMA = "NORMAL", "LOGNORMAL", "GAMMA"
EXPONENTIAL, UNIFORM, TRIANGULAR, FIXED = "EXPONENTIAL", "UNIFORM", "TRIANGULAR", "FIXED"
# The calendar presets (first and last working weekday, hours).
CALENDARS = {"working": (0, 4, 9, 17), "always": (0, 6, 0, 24)}

BLOCK = 1024


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 7, brought back by the recurrence."""
    z = x + 7
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    shift = F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6))
    return series - shift


def densities(x: Column) -> dict[str, Column]:
    """Fitted density at x per distribution, from columns n, lo, hi, avg, var, lavg, lvar.

    Normal, exponential and uniform are the maximum-likelihood fits; triangular, lognormal and gamma are
    fitted by moments.
    """
    c = F.col
    rng = c("hi") - c("lo")
    peak = F.least(F.greatest(3 * c("avg") - c("lo") - c("hi"), c("lo")), c("hi"))
    k, theta = c("avg") * c("avg") / c("var"), c("var") / c("avg")
    positive = (x > 0) & (c("lo") > 0) & (c("lvar") > 0)
    return {
        NORMAL: F.exp(-((x - c("avg")) ** 2) / (2 * c("var"))) / F.sqrt(2 * math.pi * c("var")),
        EXPONENTIAL: F.exp(-(x - c("lo")) / (c("avg") - c("lo"))) / (c("avg") - c("lo")),
        UNIFORM: 1 / rng,
        TRIANGULAR: F.when(x < peak, 2 * (x - c("lo")) / (rng * (peak - c("lo")))).otherwise(
            F.when(peak < c("hi"), 2 * (c("hi") - x) / (rng * (c("hi") - peak))).otherwise(2 / rng)
        ),
        LOGNORMAL: F.when(
            positive, F.exp(-((F.log(x) - c("lavg")) ** 2) / (2 * c("lvar"))) / (x * F.sqrt(2 * math.pi * c("lvar")))
        ),
        GAMMA: F.when((x > 0) & (c("lo") >= 0), F.exp((k - 1) * F.log(x) - x / theta - k * F.log(theta) - _log_gamma(k))),
    }


#: Bins of a histogram that are taken one by one; further ones by stretches of doubling length, with so many places each.
SINGLE_BINS, PLACES = 8192, 2048


def _bin_places(stats: DataFrame) -> DataFrame:
    """``stats(bins, ...)`` with a row per place ``b`` at which a density stands for ``weight`` bins."""
    near = stats.withColumn("b", F.explode(F.sequence(F.lit(0), F.least(F.col("bins"), F.lit(SINGLE_BINS)).cast("int") - 1)))
    near = near.withColumns({"b": F.col("b").cast("double"), "weight": F.lit(1.0)})
    far = stats.filter(F.col("bins") > SINGLE_BINS)
    doubling = F.sequence(F.lit(0), F.floor(F.log2(F.col("bins") / SINGLE_BINS)).cast("int"))
    far = far.withColumn("k", F.explode(doubling)).withColumn("start", SINGLE_BINS * F.pow(F.lit(2.0), F.col("k"))).filter(F.col("start") < F.col("bins"))
    far = far.withColumn("weight", (F.least(2 * F.col("start"), F.col("bins")) - F.col("start")) / PLACES)
    far = far.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
    far = far.withColumn("b", F.col("start") + (F.col("j") + 0.5) * F.col("weight") - 0.5)
    return near.unionByName(far.select(*near.columns))


def distribution_errors(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Squared error between the density histogram (automatic bin width) and each fitted density.

    One row per group and distribution, for groups of 100 values or more that are not constant. The bins that hold no value enter by the
    sum of the squared density alone, so a far outlier costs nothing.
    """
    v = F.col(value).cast("double")
    ln = F.when(v > 0, F.log(v))
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.min(v).alias("lo"),
        F.max(v).alias("hi"),
        F.avg(v).alias("avg"),
        F.var_pop(v).alias("var"),
        F.avg(ln).alias("lavg"),
        F.var_pop(ln).alias("lvar"),
    )
    stats = stats.filter((F.col("n") >= 100) & (F.col("hi") > F.col("lo")))
    q = quantiles(df, keys, value, {"q25": 0.25, "q75": 0.75})
    rng = F.col("hi") - F.col("lo")
    sturges = rng / (F.log2("n") + 1)
    fd = 2 * (F.col("q75") - F.col("q25")) / F.cbrt("n")
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    # a far outlier makes more bins than any number of rows: bins are doubles, and only occupied ones become rows
    stats = O.sized(stats.join(q, keys).withColumn("bins", F.when(rng / width < 1e15, F.ceil(rng / width).cast("double")).otherwise(rng / width)))
    stats = stats.withColumn("bins", F.greatest("bins", F.lit(1.0))).withColumn("step", rng / F.col("bins"))
    binned = df.join(stats.select(*keys, "lo", "step", "bins"), keys)
    place = (v - F.col("lo")) / F.col("step")
    at = F.least(F.when(place < 1e15, F.floor(place).cast("double")).otherwise(place), F.col("bins") - 1)
    counts = binned.groupBy(*keys, at.alias("b")).agg(F.count("*").alias("c")).join(stats, keys)
    x = F.col("lo") + (F.col("b") + 0.5) * F.col("step")
    height = F.col("c") / (F.col("n") * F.col("step"))
    # (h - p)^2 over all bins is h (h - 2p) over the occupied ones and p^2 over all
    seen = counts.groupBy(*keys).agg(*[F.sum(height * (height - 2 * p)).alias(n) for n, p in densities(x).items()])
    model = _bin_places(stats)
    model = model.groupBy(*keys).agg(*[F.sum(F.col("weight") * p * p).alias(n) for n, p in densities(x).items()])
    wide = seen.unionByName(model).groupBy(*keys).agg(*[F.when(F.count(n) == 2, F.greatest(F.sum(n), F.lit(0.0))).alias(n) for n in densities(x)])
    names = list(densities(F.lit(1.0)))
    return wide.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(n).alias("dname"), F.lit(i).alias("rank"), F.col(n).alias("sse")) for i, n in enumerate(names)])).alias("e"),
    ).select(*keys, "e.*")


def fit_distributions(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Chosen distribution and its parameters (one decimal) per group."""
    err = distribution_errors(df, keys, value).filter("sse > 0")
    best = err.groupBy(*keys).agg(F.min(F.struct("sse", "rank", "dname"))["dname"].alias("best"))
    v = F.col(value).cast("double")
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("avg"), F.stddev_pop(v).alias("sd")
    )
    modes = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    modes = modes.groupBy(*keys).agg((-F.max(F.struct("c", (-F.col(value)).alias("m")))["m"]).cast("double").alias("mode"))
    out = stats.join(best, keys, "left").join(modes, keys, "left")
    name = (
        F.when(F.col("n") == 0, FIXED)
        .when(F.col("lo") == F.col("hi"), FIXED)
        .when(F.col("n") < 100, EXPONENTIAL)
        .otherwise(F.coalesce("best", F.lit(NORMAL)))
    )
    out = out.withColumn("dname", name)
    d, r1 = F.col("dname"), lambda c: F.round(c, 1)
    zero = F.lit(0.0)
    return out.select(
        *keys,
        "dname",
        F.when(d == FIXED, F.coalesce(F.floor("lo").cast("double"), zero))
        .when(d.isin(NORMAL, LOGNORMAL, GAMMA), r1("avg"))
        .when(d == UNIFORM, F.lit(3600.0))
        .when(d == TRIANGULAR, r1("mode"))
        .otherwise(zero)
        .alias("mean"),
        F.when(d == FIXED, zero)
        .when(d == NORMAL, r1("sd"))
        .when(d.isin(LOGNORMAL, GAMMA), r1(F.col("sd") * F.col("sd")))
        .when(d == EXPONENTIAL, r1("avg"))
        .otherwise(r1("lo"))
        .alias("arg1"),
        F.when(d.isin(UNIFORM, TRIANGULAR), r1("hi")).otherwise(zero).alias("arg2"),
    )


def default_distribution(df: DataFrame, tasks: DataFrame, value: str) -> DataFrame:
    """Exponential with the task's mean (two decimals); 0 for tasks without rows."""
    m = df.groupBy("task").agg(F.avg(value).alias("m"))
    return tasks.join(m, "task", "left").select(
        "task", F.lit(EXPONENTIAL).alias("dname"), F.round(F.coalesce("m", F.lit(0.0)), 2).alias("arg1")
    )


def activity_description(log: DataFrame) -> DataFrame:
    """Day moments, users, mean of the distinct positions, duration mean and deviation, distribution."""
    from caseloom.operators.shape import positions

    df = positions(log).withColumns({"moment": T.day_moment("start_ts"), "dur": T.span_us("start_ts", "end_ts") / 1e6})
    # distinct values first: the arrays then hold the vocabulary, however many rows a task has
    moments = df.select("task", "moment").distinct().groupBy("task").agg(F.sort_array(F.collect_list("moment")).alias("moments"))
    users = df.select("task", "user").distinct().groupBy("task").agg(F.sort_array(F.collect_list("user")).alias("users"))
    pos = df.select("task", "pos_trace").distinct().groupBy("task").agg(F.avg("pos_trace").alias("mean_pos"))
    dur = df.groupBy("task").agg(F.avg("dur").alias("mean_dur"), F.stddev_pop("dur").alias("std_dur"))
    dist = fit_distributions(df, ["task"], "dur").select("task", "dname")
    return moments.join(users, "task").join(pos, "task").join(dur, "task").join(dist, "task")


def task_user_counts(log: DataFrame) -> DataFrame:
    """Rows per task and resource (the resource candidates of each task)."""
    return log.groupBy("task", "user").agg(F.count("*").alias("n"))


def dominant_role(log: DataFrame, roles: DataFrame) -> DataFrame:
    """The most frequent role per task; ties go to the smaller name."""
    counts = log.join(roles, "user").groupBy("task", "role").agg(F.count("*").alias("n"))
    best = counts.groupBy("task").agg(F.min(F.struct((-F.col("n")).alias("neg"), "role")).alias("b"))
    return best.select("task", F.col("b.role").alias("role"), (-F.col("b.neg")).alias("n"))


def resource_pools(roles: DataFrame) -> DataFrame:
    """Pool size per role, and the default SYSTEM pool."""
    pools = roles.groupBy("role").agg(F.count("*").alias("size"))
    system = roles.sparkSession.range(1).select(F.lit("SYSTEM").alias("role"), F.lit(20).cast("long").alias("size"))
    return pools.unionByName(system)


def real_rows(log: DataFrame) -> DataFrame:
    """Without Start/End rows and without automatic or missing resources."""
    return log.filter(~F.col("task").isin(START, END) & F.col("user").isNotNull() & (F.col("user") != SYSTEM_USER))


def task_names(log: DataFrame, most: int = 100_000) -> list[str]:
    """The activity vocabulary, checked to be small enough to be a literal."""
    rows = log.select("task").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} activity names")
    return sorted(r["task"] for r in rows)


def user_task_profile(log: DataFrame) -> DataFrame:
    """Frequency of every task for every user, zero-filled."""
    counts = task_user_counts(real_rows(log))
    grid = counts.select("user").distinct().crossJoin(counts.select("task").distinct())  # that is the output
    grid = grid.join(counts, ["user", "task"], "left")
    return grid.select("user", "task", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def user_vectors(log: DataFrame) -> DataFrame:
    """``(user, vec)``: counts per task in name order, zero-filled."""
    return O.gather(user_task_profile(log), ["user"], ["task"], {"vec": "n"}).withColumn("vec", F.col("vec").cast("array<double>"))


def similar_profiles(counts: DataFrame, threshold: float) -> DataFrame:
    """``counts(id, feature, n)`` -> ``(a, b, r)``: pairs whose Pearson correlation over all features is above a positive threshold.

    Absent features count as 0, so with T features, mean m and weights w = n / |n - m| the correlation is w_a . w_b - T m_a m_b (means in
    the same unit). Features go from rare to frequent. If a pair has no common one before the rest of a's weights has a norm of
    ``threshold`` and of ``sqrt(T) m_a`` at most, then w_a . w_b <= rest * sqrt(1 + T m_b^2) <= threshold + T m_a m_b: it cannot pass. So only
    pairs that share a feature in both such beginnings are measured, and frequent features make no lists. Profiles are meant
    to be distinct (see ``similar_users``). Constant profiles have no correlation.
    """
    if threshold <= 0:
        raise ValueError("pairs without a common feature pass a threshold that is not positive")
    counts = store(counts)
    features = counts.groupBy("feature").agg(F.count("*").alias("df"))
    t = features.agg(F.count("*").cast("double").alias("t"))
    n = F.col("n").cast("double")
    stats = counts.groupBy("id").agg(F.sum(n).alias("s1"), F.sum(n * n).alias("s2"), F.count("*").alias("k")).crossJoin(t)  # one row
    # squared distance from the mean; a profile with the same number everywhere has none
    stats = stats.filter("not (k = t and s2 * t = s1 * s1)").withColumn("scale", F.sqrt(F.col("s2") - F.col("s1") * F.col("s1") / F.col("t")))
    stats = store(stats.select("id", "scale", "t", (F.col("s1") / (F.col("t") * F.col("scale"))).alias("m")))
    rows = counts.join(stats, "id").join(features, "feature").select("id", "feature", "df", (n / F.col("scale")).alias("w"), "t", "m")
    rows = O.scan(O.segment(rows, ["id"], "df"), ["id"], ["df", "feature"], {"before": ("sum", F.col("w") * F.col("w"), "before")})
    norm2 = 1 + F.col("t") * F.col("m") * F.col("m")
    limit = F.least(F.lit(threshold), F.sqrt("t") * F.col("m"))
    rows = store(rows.select("id", "feature", "w", (F.sqrt(F.greatest(norm2 - F.col("before"), F.lit(0.0))) > limit * (1 - 1e-9)).alias("head")))
    heads = rows.filter("head").select("feature", F.col("id").alias("a"))
    pairs = heads.join(heads.withColumnRenamed("a", "b"), "feature").filter("a < b").select("a", "b").distinct()
    left = rows.select(F.col("id").alias("a"), "feature", F.col("w").alias("wa"))
    right = rows.select(F.col("id").alias("b"), "feature", F.col("w").alias("wb"))
    dot = pairs.join(left, "a").join(right, ["b", "feature"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    mean = stats.select("id", "m", "t")
    dot = dot.join(mean.select(F.col("id").alias("a"), F.col("m").alias("ma"), "t"), "a").join(mean.select(F.col("id").alias("b"), F.col("m").alias("mb")), "b")
    out = dot.select("a", "b", (F.col("dot") - F.col("t") * F.col("ma") * F.col("mb")).alias("r"))
    return out.filter(F.col("r") > threshold)


def _block_pairs(vectors: DataFrame) -> DataFrame:
    """Vectors in hash blocks, each block sent to every pair of blocks it takes part in.

    This spreads the (by definition quadratic) pair work evenly over tasks of bounded size.
    """
    blocks = max(1, math.ceil(vectors.count() / (BLOCK // 2)))
    b = F.pmod(F.xxhash64("user"), F.lit(blocks)).cast("int")
    df = vectors.withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return df.select("user", "vec", "b", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"))


def _correlate(pdf: pd.DataFrame):
    """Left and right user names, and their correlation matrix (NaN where a profile is constant)."""
    bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
    x = np.vstack(pdf["vec"].to_numpy()).astype(float)
    x = x - x.mean(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        x = x / norm
    left, right = (pdf["b"] == bi).to_numpy(), (pdf["b"] == bj).to_numpy()
    return pdf["user"].to_numpy()[left], pdf["user"].to_numpy()[right], x[left] @ x[right].T, bi == bj


def profile_correlation(log: DataFrame) -> DataFrame:
    """Pearson correlation of the task profiles, each unordered pair of users once."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, r, same = _correlate(pdf)
        i, j = np.triu_indices(len(a), 1) if same else [g.ravel() for g in np.indices(r.shape)]
        lo, hi = np.where(a[i] < b[j], a[i], b[j]), np.where(a[i] < b[j], b[j], a[i])
        return pd.DataFrame({"user_a": lo, "user_b": hi, "r": r[i, j]})

    df = _block_pairs(user_vectors(log)).groupBy("bi", "bj").applyInPandas(pairs, "user_a string, user_b string, r double")
    return df.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def similar_users(log: DataFrame, threshold: float) -> DataFrame:
    """Edges ``(a, b)`` that connect the same users as all pairs with r above the (positive) threshold.

    Users with proportional profiles are one profile for the pairs, and are linked to its smallest user.
    """
    counts = task_user_counts(real_rows(log)).withColumn("n", F.col("n").cast("double"))
    every = counts.agg(F.countDistinct("task").alias("t"))
    total = counts.groupBy("user").agg(F.sum("n").alias("all"))
    shares = counts.join(total, "user").select("user", F.struct("task", (F.col("n") / F.col("all")).alias("share")).alias("e"))
    profiles = shares.groupBy("user").agg(F.array_sort(F.collect_list("e")).alias("p")).crossJoin(every)  # one row
    flat = (F.size("p") == F.col("t")) & (F.size(F.array_distinct(F.col("p")["share"])) == 1)
    profiles = store(profiles.filter(~flat).select("user", "p"))
    same = store(profiles.groupBy("p").agg(F.min("user").alias("b")))
    links = profiles.join(same, "p").select(F.col("user").alias("a"), "b").filter("a <> b")
    heads = same.select(F.col("b").alias("id"), F.explode("p").alias("e"))
    heads = heads.join(counts, (F.col("id") == counts["user"]) & (F.col("e.task") == counts["task"])).select("id", F.col("e.task").alias("feature"), "n")
    return links.unionByName(similar_profiles(heads, threshold).select("a", "b"))


def discover_roles(log: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``(user, role)``: connected users with profile correlation above the threshold; roles by size."""
    users = real_rows(log).select(F.col("user").alias("id")).distinct()
    comp = components(users, similar_users(log, threshold))
    sizes = comp.groupBy("root").agg(F.count("*").alias("size")).withColumn("neg", -F.col("size"))
    ranked = O.global_index(sizes, ["neg", "root"], "k")
    return store(comp.join(ranked, "root").select(F.col("id").alias("user"), F.concat(F.lit("Role "), F.col("k").cast("string")).alias("role")))


def work_sets(labelled: DataFrame) -> DataFrame:
    """Per case and resource the ordered occurrence labels (input: ``occurrence_labels``)."""
    df = labelled.withColumnRenamed("user", "resource")
    return O.gather(df, ["caseid", "resource"], ["pos"], {"workset": "label"})


def case_partitions(sets: DataFrame) -> DataFrame:
    """Per case its work-sets, sorted."""
    return sets.groupBy("caseid").agg(F.array_sort(F.collect_list("workset")).alias("sets"))


def resource_given_workset(sets: DataFrame) -> DataFrame:
    """P(resource given work-set), ten decimals."""
    n = sets.groupBy("workset", "resource").agg(F.count("*").alias("n"))
    total = n.groupBy("workset").agg(F.sum("n").alias("all"))
    return n.join(total, "workset").select("workset", "resource", "n", F.round(F.col("n") / F.col("all"), 10).alias("prob"))


def calendar_table(spark, preset: str) -> DataFrame:
    """One row per working weekday with its hours."""
    first, last, lo, hi = CALENDARS[preset]
    return spark.range(first, last + 1).select(
        F.lit(preset).alias("calendar"), F.col("id").cast("int").alias("weekday"), F.lit(lo).alias("from_hour"), F.lit(hi).alias("to_hour")
    )


def in_calendar(df: DataFrame, ts: str, preset: str) -> DataFrame:
    """Rows whose timestamp lies in the calendar."""
    cal = calendar_table(df.sparkSession, preset).select("weekday", "from_hour", "to_hour")
    cond = (T.monday0(ts) == cal["weekday"]) & (F.hour(ts) >= cal["from_hour"]) & (F.hour(ts) < cal["to_hour"])
    return df.join(F.broadcast(cal), cond, "left_semi")  # seven rows at most


def with_roles(log: DataFrame, roles: DataFrame) -> DataFrame:
    return log.join(roles, "user", "left")


def shares_per_task(df: DataFrame, col: str) -> DataFrame:
    """Share of each value of ``col`` among the task's rows."""
    n = df.groupBy("task", col).agg(F.count("*").alias("n"))
    total = n.groupBy("task").agg(F.sum("n").alias("all"))
    return n.join(total, "task").select("task", col, "n", (F.col("n") / F.col("all")).alias("share"))


def task_parameters(log: DataFrame, nodes: DataFrame, roles: DataFrame) -> DataFrame:
    """Model tasks with distribution, element id and pool; Start and End rows are FIXED 0 on SYSTEM."""
    df = log.withColumn("dur", T.span_us("start_ts", "end_ts") / 1e6)
    tasks = nodes.filter(F.col("type") == "task").select(F.col("name").alias("task"), "element_id")
    dist = fit_distributions(df, ["task"], "dur")
    role = dominant_role(log, roles).select("task", "role")
    body = tasks.join(dist, "task", "left").join(role, "task", "left").select(
        "task",
        "element_id",
        F.coalesce("dname", F.lit(FIXED)).alias("dname"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "arg1", "arg2")],
        F.coalesce("role", F.lit("SYSTEM")).alias("pool"),
    )
    edges = nodes.filter(F.col("type").isin("start", "end")).select(
        F.col("name").alias("task"),
        "element_id",
        F.lit(FIXED).alias("dname"),
        *[F.lit(0.0).alias(c) for c in ("mean", "arg1", "arg2")],
        F.lit("SYSTEM").alias("pool"),
    )
    return body.unionByName(edges)
