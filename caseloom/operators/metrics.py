"""Similarity of two logs: whole-log span, arrival histograms, sequence distances, case matching."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import ordered as O
from caseloom.functions import times as T
from caseloom.functions.distance import damerau_levenshtein_table, timed_distance_table
from caseloom.model import ORDER
from caseloom.operators.flow import PARALLEL, footprint
from caseloom.operators.matching import match_on_line
from caseloom.operators.profile import task_names
from caseloom.operators.shape import case_spans, scale_by_task
from caseloom.session import store

#: Rows of a tile, most, and of a tile of the narrow side, least; pairs of tiles that are made for them to spread evenly, and tasks at most.
MOST, TILE, SPREAD, TASKS = 2048, 32, 256, 4096
#: Costs that the driver holds of all left cases, and of each at least.
HELD, LEAST = 1 << 22, 32
#: What a cost needs to know of a case.
NEEDS = {"mae": ["cycle"], "tsd": ["codes", "p", "w"], "edits": ["codes"], "dl": ["codes"], "dl_mae": ["codes", "cycle"]}

# Grouping of the histogram metrics.
CRITERIA = {"hour_emd": ["window"], "day_emd": ["weekday"], "day_hour_emd": ["weekday", "window"], "cal_emd": ["date"]}


# ---- whole log


def log_mae(log_spans: DataFrame, sim_spans: DataFrame) -> DataFrame:
    """``(run_num, sim_val)``: difference of the whole-log spans in seconds, per run of the simulation."""
    span = T.us(F.max("end_time")) - T.us(F.min("start_time"))
    a = log_spans.agg(span.alias("a"))
    b = sim_spans.groupBy("run_num").agg(span.alias("b"))
    return b.crossJoin(F.broadcast(a)).select("run_num", (F.abs(F.col("b") - F.col("a")) / 1e6).alias("sim_val"))  # a is one row


# ---- histogram distance


def span_times(spans: DataFrame) -> DataFrame:
    """Start and end time of every case as rows."""
    return spans.withColumn("ts", F.explode(F.array("start_time", "end_time"))).drop("start_time", "end_time")


def _densities(times: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the sorted ten-bin density between the key's own first and last time."""
    df = times.withColumn("t", T.us("ts"))
    rng = df.groupBy(*keys).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    df = df.join(rng, keys)
    b = F.when(F.col("hi") > F.col("lo"), F.expr("least((t - lo) * 10 div (hi - lo), 9)")).otherwise(5)
    c = df.groupBy(*keys, "lo", "hi", "n", b.cast("int").alias("b")).agg(F.count("*").alias("c"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / 1e7).otherwise(0.1)
    got = F.sort_array(F.collect_list("c"))  # ten values at most
    full = F.concat(F.array_repeat(F.lit(0).cast("long"), 10 - F.size("c")), F.col("c"))
    return c.groupBy(*keys, "lo", "hi", "n").agg(got.alias("c")).select(
        *keys, F.transform(full, lambda x: x / (F.col("n") * width)).alias("density")
    )


def _groups(times: DataFrame) -> DataFrame:
    return times.withColumns({"window": F.hour("ts") + 1, "weekday": T.monday0("ts"), "date": F.to_date("ts")})


def emd_groups(log_times: DataFrame, sim_times: DataFrame, criteria: str = "day_hour_emd", empty: float = 0.0) -> DataFrame:
    """Distance of the sorted densities per run and group; ``empty`` where one side has no rows."""
    g = CRITERIA[criteria]
    a = _densities(_groups(log_times), g).withColumnRenamed("density", "da")
    b = _densities(_groups(sim_times), ["run_num"] + g).withColumnRenamed("density", "db")
    runs = sim_times.select("run_num").distinct()
    a = runs.crossJoin(a)  # a has at most one row per hour of the week, or per date
    df = a.join(b, ["run_num"] + g, "full")
    diff = F.aggregate(F.zip_with("da", "db", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / 10
    return df.select("run_num", *g, F.coalesce(diff, F.lit(empty)).alias("score"))


def emd(log_times: DataFrame, sim_times: DataFrame, criteria: str = "day_hour_emd", empty: float = 0.0) -> DataFrame:
    return emd_groups(log_times, sim_times, criteria, empty).groupBy("run_num").agg(F.avg("score").alias("sim_val"))


# ---- cycle times


def cycle_times(spans: DataFrame) -> DataFrame:
    keep = [c for c in spans.columns if c not in ("start_time", "end_time")]
    return spans.select(*keep, T.span_us("start_time", "end_time").alias("cycle"))


def mae_to_all(log_spans: DataFrame, sim_spans: DataFrame) -> DataFrame:
    """Per log case the mean and the smallest difference of cycle times to all simulated cases (µs).

    Sums over the sorted cycle times replace the pairs: all values below contribute (x - v), all above
    (v - x).
    """
    a = cycle_times(log_spans).select("caseid", "cycle", F.lit(1).alias("kind"))
    b = cycle_times(sim_spans).select(F.lit(None).cast("string").alias("caseid"), "cycle", F.lit(0).alias("kind"))
    total = b.agg(F.count("*").alias("n"), F.sum("cycle").alias("s"))
    df = O.segment(a.unionByName(b), [], "cycle")
    sim = F.col("kind") == 0
    v = F.when(sim, F.col("cycle"))
    df = O.scan(
        df,
        [],
        ["cycle", "kind"],
        {
            "n_le": ("sum", sim.cast("long"), "upto"),
            "s_le": ("sum", F.coalesce(v, F.lit(0)).cast("decimal(38,0)"), "upto"),
            "below": ("last", v, "upto"),
            "above": ("last", v, "after"),
        },
    )
    df = df.filter("kind = 1").crossJoin(F.broadcast(total))  # one row
    x = F.col("cycle").cast("decimal(38,0)")
    dist = x * F.col("n_le") - F.col("s_le") + (F.col("s") - F.col("s_le")) - x * (F.col("n") - F.col("n_le"))
    near = F.least(F.col("cycle") - F.col("below"), F.col("above") - F.col("cycle"))
    return df.select("caseid", (dist.cast("double") / F.col("n")).alias("mean_mae"), near.alias("min_mae"))


def mae_matching(log_spans: DataFrame, sim_spans: DataFrame) -> DataFrame:
    """``(run_num, sim_val)``: mean cycle-time difference (s) of the best one-to-one matching, exactly (see ``matching``)."""
    one = cycle_times(log_spans).select(F.col("cycle").alias("v"))
    many = cycle_times(sim_spans).select(F.col("run_num").alias("run"), F.col("cycle").alias("v"))
    found = match_on_line(one, many)
    return found.select(F.col("run").alias("run_num"), (F.col("cost").cast("double") / F.col("pairs") / 1e6).alias("sim_val"))


# ---- sequence distances


def _codes(seq: str, names: list[str]) -> Column:
    table = F.array(*[F.lit(t) for t in names])
    return F.transform(seq, lambda t: F.array_position(table, t).cast("int"))


def sequence_profiles(log: DataFrame, names: list[str]) -> DataFrame:
    """Per case: task codes, scaled times, cycle time."""
    df = O.gather(log, ["caseid"], ORDER, {"seq": "task", "p": "proc_us_norm", "w": "wait_us_norm"})
    cyc = cycle_times(case_spans(log))
    return df.withColumn("codes", _codes("seq", names)).join(cyc, "caseid").select("caseid", "codes", "p", "w", "cycle")


def paired_profiles(log: DataFrame, sim: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Profiles of both logs; the times are scaled by each task's maximum over the two together."""
    both = log.withColumn("side", F.lit("log")).unionByName(sim.withColumn("side", F.lit("sim")), allowMissingColumns=True)
    names = task_names(both)
    timed = scale_by_task(durations_by_side(both), ["proc_us", "wait_us"])
    a, b = (sequence_profiles(timed.filter(F.col("side") == s).drop("side"), names) for s in ("log", "sim"))
    return a, b, names


def durations_by_side(both: DataFrame) -> DataFrame:
    df = O.neighbours(both, ["side", "caseid"], ORDER, prev={"prev_end": "end_ts"})
    wait = F.greatest(F.coalesce(T.span_us("prev_end", "start_ts"), F.lit(0)), F.lit(0))
    return df.withColumns({"proc_us": T.span_us("start_ts", "end_ts"), "wait_us": wait}).drop("prev_end")


def _tiles(a: DataFrame, b: DataFrame, metric: str, rows: tuple[int, int] | None = None, wide: int = 0):
    """Both sides in tiles, every left tile with every right tile, grouped by ``(ti, tj)``; what ``metric`` needs of them.

    The side ``wide`` (0 or 1) is in tiles of MOST rows, the other in smaller ones where there would be few pairs of tiles. A pair of tiles
    is one group. The pair work is quadratic by the metric's definition; it is spread evenly and no pair leaves its group unless the caller asks for it.
    """
    n = rows or (a.count(), b.count())
    tiles = [max(1, math.ceil(x / MOST)) for x in n]
    tiles[1 - wide] = max(tiles[1 - wide], min(math.ceil(n[1 - wide] / TILE), math.ceil(SPREAD / tiles[wide])))
    ta, tb = tiles
    key = lambda n: F.pmod(F.xxhash64("caseid", F.lit(n)), F.lit(n)).cast("int")
    keep = [c for c in ("caseid", "at", *NEEDS[metric]) if c in a.columns]
    left = a.select(*keep).withColumns({"ti": key(ta), "tj": F.explode(F.sequence(F.lit(0), F.lit(tb - 1))), "side": F.lit(0)})
    right = b.select(*keep).withColumns({"tj": key(tb), "ti": F.explode(F.sequence(F.lit(0), F.lit(ta - 1))), "side": F.lit(1)})
    return left.unionByName(right).repartition(min(ta * tb, TASKS), "ti", "tj").groupBy("ti", "tj")


def _split(pdf: pd.DataFrame):
    return pdf[pdf["side"] == 0].reset_index(drop=True), pdf[pdf["side"] == 1].reset_index(drop=True)


def _cost(metric: str, left, right, parallel=None, max_mae: float = 0.0):
    """Cost of each (left, right) pair of a tile, as a matrix."""
    if metric == "mae":
        return np.abs(left["cycle"].to_numpy()[:, None] - right["cycle"].to_numpy()[None, :]) / 1e6
    la, lb = (np.array([len(c) for c in x["codes"]]) for x in (left, right))
    longest = np.maximum(la[:, None], lb)
    if metric == "tsd":
        # the right side is the simulation, whose share of processing counts
        log, sim = (list(zip(x["codes"], x["p"], x["w"])) for x in (left, right))
        return timed_distance_table(sim, log, parallel).T / longest
    edits = damerau_levenshtein_table(left["codes"], right["codes"])
    if metric == "edits":
        return edits.astype(float)
    dl = edits / longest
    if metric == "dl":
        return dl
    mae = np.abs(left["cycle"].to_numpy()[:, None] - right["cycle"].to_numpy()[None, :])
    return 0.5 * dl + (0.5 * mae / max_mae if max_mae else 0.0)


def _settings(metric: str, a: DataFrame, b: DataFrame, names: list[str], relations: DataFrame | None):
    """What every task needs to know: parallel pairs, largest cycle difference."""
    parallel, max_mae = None, 0.0
    if metric == "tsd":
        parallel = np.zeros((len(names) + 1, len(names) + 1), bool)
        at = {t: k + 1 for k, t in enumerate(names)}
        for r in relations.filter(F.col("rel") == PARALLEL).collect():  # at most the squared vocabulary
            parallel[at[r["a"]], at[r["b"]]] = True
    if metric == "dl_mae":
        x, y = (s.agg(F.min("cycle").alias("lo"), F.max("cycle").alias("hi")).first() for s in (a, b))
        max_mae = float(max(abs(x["hi"] - y["lo"]), abs(y["hi"] - x["lo"])))
    return parallel, max_mae


def distance_to_all(a: DataFrame, b: DataFrame, names: list[str], metric: str, relations: DataFrame | None = None) -> DataFrame:
    """Per left case the mean and smallest cost to all right cases, and the nearest case."""
    a, b = store(a), store(b)
    parallel, max_mae = _settings(metric, a, b, names, relations)

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _split(pdf)
        if not len(left) or not len(right):
            return pd.DataFrame({"caseid": [], "s": [], "n": [], "best": [], "near": []}).astype({"caseid": str, "near": str})
        right = right.sort_values("caseid").reset_index(drop=True)
        c = _cost(metric, left, right, parallel, max_mae)
        k = c.argmin(axis=1)
        return pd.DataFrame({"caseid": left["caseid"], "s": c.sum(axis=1), "n": c.shape[1], "best": c.min(axis=1), "near": right["caseid"].to_numpy()[k]})

    out = _tiles(a, b, metric).applyInPandas(tile, "caseid string, s double, n long, best double, near string")
    return out.groupBy("caseid").agg(
        (F.sum("s") / F.sum("n")).alias("mean_cost"), F.min("best").alias("min_cost"), F.min(F.struct("best", "near"))["near"].alias("nearest")
    )


def variant_profiles(a: DataFrame) -> DataFrame:
    """One profile per distinct sequence (``caseid`` is the smallest member), for metrics without times."""
    return a.groupBy("codes").agg(F.min("caseid").alias("caseid"), F.count("*").alias("cases")).select("caseid", "codes", "cases")


# ---- one-to-one matching


def numbered_cases(a: DataFrame) -> tuple[DataFrame, list[str]]:
    """The profiles with their place ``at`` among the sorted cases, stored, and these (ids only reach the driver)."""
    a = store(a)
    ids = sorted(r["caseid"] for r in a.select("caseid").distinct().collect())
    at = a.sparkSession.createDataFrame(pd.DataFrame({"caseid": ids, "at": range(len(ids))}, dtype=object), "caseid string, at int")
    return store(a.join(at, "caseid")), ids


def cost_tiles(a: DataFrame, b: DataFrame, names: list[str], metric: str, relations: DataFrame | None = None, swapped: bool = False):
    """The cost matrix of two numbered sides, of which only what is asked for is kept.

    Returns ``tiles(prices, most, cases=None)``: per left case (of ``cases``) the ``most`` right ones with the least cost plus price, as rows
    ``(i, js, costs, bound, last)``; ``js`` ascends, and all others come after ``(bound, last)`` in the order of (cost plus price, number).
    ``swapped`` says that the right side is the log (the timed distance is not symmetric).
    """
    parallel, max_mae = _settings(metric, *((b, a) if swapped else (a, b)), names, relations)
    rows, spark = (a.count(), b.count()), a.sparkSession
    schema = "i int, js binary, costs binary, bound double, last int"

    def best(i, js, costs, prices, most, total):
        """The row of a left case from costs that hold its cheapest ones."""
        value = costs + prices[js]
        order = np.lexsort((js, value))[:most]
        end = order[-1]
        bound, last = (float(value[end]), int(js[end])) if total > most else (np.inf, total)
        order = order[np.argsort(js[order])]
        return i, js[order].astype(np.int32).tobytes(), costs[order].tobytes(), bound, last

    def tiles(prices: np.ndarray, most: int, cases: np.ndarray | None = None) -> list:
        shared = spark.sparkContext.broadcast(prices)

        def tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            left, right = _split(pdf)
            if not len(left) or not len(right):
                return pd.DataFrame({"ti": [], "i": [], "js": [], "costs": [], "bound": [], "last": []})
            c = _cost(metric, right, left, parallel, max_mae).T if swapped else _cost(metric, left, right, parallel, max_mae)
            js = right["at"].to_numpy()
            out = [best(i, js, x, shared.value, most, len(js)) for i, x in zip(left["at"], np.ascontiguousarray(c))]
            return pd.DataFrame(out, columns=["i", "js", "costs", "bound", "last"]).assign(ti=int(key[0]))[["ti", "i", "js", "costs", "bound", "last"]]

        def together(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for i, part in pdf.groupby("i"):
                js, costs = (np.concatenate([np.frombuffer(x, kind) for x in part[c]]) for c, kind in (("js", np.int32), ("costs", float)))
                out.append(best(i, js, costs, shared.value, most, len(prices)))
            return pd.DataFrame(out, columns=["i", "js", "costs", "bound", "last"])

        some, n = a, rows
        if cases is not None:
            some = a.join(spark.createDataFrame([(int(x),) for x in cases], "at int"), "at", "left_semi")
            n = (len(cases), rows[1])
        parts = _tiles(some, b, metric, n, wide=int(metric != "tsd" or swapped)).applyInPandas(tile, "ti int, " + schema)
        found = parts.groupBy("ti").applyInPandas(together, schema).collect()  # HELD costs at most, or LEAST per case
        shared.destroy()
        return found

    return tiles


def auction(tiles, left: int, right: int, epsilon: float) -> list[tuple[int, int, float]]:
    """``(i, j, cost)``: one-to-one matching whose total cost is within (pairs * epsilon) of the least.

    Every round all unmatched left cases bid for the right case with the best cost plus price; the highest bid per right case wins. The left side
    must not be larger. The driver holds a price and an owner per right case, and of each left case the cheapest right ones (HELD costs in all). As prices only rise,
    these are enough until the second best offer is dearer than the last one held; then they are asked for again, for all left cases that need it.
    """
    if left > right:
        raise ValueError("the left side must not be larger")
    most = min(right, max(LEAST, HELD // max(left, 1)))
    prices, owner, paid = np.zeros(right), np.full(right, -1), np.zeros(right)
    js, costs = np.empty((left, most), np.int32), np.empty((left, most))
    bound, last = np.empty(left), np.empty(left, np.int64)

    def ask(cases=None):
        for r in tiles(prices, most, cases):
            i = r["i"]
            js[i], costs[i], bound[i], last[i] = np.frombuffer(r["js"], np.int32), np.frombuffer(r["costs"]), r["bound"], r["last"]
        bound[np.isnan(bound)] = np.inf

    def offers(cases):
        """(place, value) of the best offer, value of the second best, and whether they are known."""
        value = costs[cases] + prices[js[cases]]
        value[np.isnan(value)] = np.inf
        rows, at = np.arange(len(cases)), value.argmin(axis=1)
        first = value[rows, at]
        if most > 1:
            value[rows, at] = np.inf
        second, end = value.min(axis=1), bound[cases]
        known = (second <= end) & ((first < end) | (first == end) & (js[cases, at] <= last[cases]))
        return at, first, second, known

    if left:
        ask()
    free = np.arange(left)
    while len(free):  # prices rise by epsilon or more with every bid, so it ends
        at, first, second, known = offers(free)
        if not known.all():
            lacking = [c[~offers(c)[3]] for c in np.array_split(np.arange(left), max(1, left * most >> 20))]
            ask(np.concatenate(lacking))
            at, first, second, _ = offers(free)
        j = js[free, at]
        bid = prices[j] + second - first + epsilon
        order = np.lexsort((free, bid, j))
        won = order[np.append(j[order][1:] != j[order][:-1], True)]
        got, out = j[won], owner[j[won]]
        owner[got], prices[got], paid[got] = free[won], bid[won], costs[free[won], at[won]]
        free = np.sort(np.concatenate([np.delete(free, won), out[out >= 0]]))
    return [(int(owner[j]), int(j), float(paid[j])) for j in np.flatnonzero(owner >= 0)]


# ---- drivers


def sql_metrics(log: DataFrame, sims: DataFrame) -> DataFrame:
    """``(run_num, metric, sim_val)`` of the metrics that need no sequence distance, all runs in one job.

    ``sims`` is a log with a ``run_num`` column.
    """
    a = case_spans(log)
    b = run_spans(sims)
    ta, tb = span_times(a), span_times(b)
    out = log_mae(a, b).withColumn("metric", F.lit("log_mae"))
    out = out.unionByName(mae_matching(a, b).withColumn("metric", F.lit("mae")))
    for c in CRITERIA:
        out = out.unionByName(emd(ta, tb, c).withColumn("metric", F.lit(c)))
    return out.select("run_num", "metric", "sim_val")


def run_spans(sims: DataFrame, true_end: bool = False) -> DataFrame:
    return sims.groupBy("run_num", "caseid").agg(
        F.min("start_ts").alias("start_time"), (F.max("end_ts") if true_end else F.max("start_ts")).alias("end_time")
    )


def matched_score(log: DataFrame, sim: DataFrame, metric: str, epsilon: float = 0.01) -> DataFrame:
    """Mean score of the matched pairs: 1 - cost, or the cost itself for ``mae``."""
    a, b, names = paired_profiles(log, sim)
    rel = footprint(log) if metric == "tsd" else None
    (a, one), (b, other) = numbered_cases(a), numbered_cases(b)
    swapped = len(one) > len(other)
    if swapped:
        a, b, one, other = b, a, other, one
    m = auction(cost_tiles(a, b, names, metric, rel, swapped), len(one), len(other), epsilon)
    pairs = log.sparkSession.createDataFrame([(one[i], other[j], c) for i, j, c in m], "i string, j string, cost double")
    score = F.col("cost") if metric == "mae" else 1 - F.col("cost")
    return pairs.agg(F.avg(score).alias("sim_val")).select(F.lit(metric).alias("metric"), "sim_val")


def result_table(results: DataFrame) -> DataFrame:
    """One row per run, one column per metric."""
    return results.groupBy("run_num").pivot("metric").agg(F.first("sim_val"))
