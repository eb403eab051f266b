"""Shaping of event logs: pairing, augmentation, positions, durations, profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import ordered as O
from caseloom.functions import times as T
from caseloom.model import END, LOG_COLS, NO_USER, ORDER, START
from caseloom.session import store

CASE = ["caseid"]


def _is(transition: str) -> Column:
    return F.col("transition") == transition


def pair_lifecycle(life: DataFrame) -> DataFrame:
    """Each start with the next later complete of its task in the case; completes are not used up.

    A case with a start that has no later complete is dropped, unless that start is the last record.
    """
    df = O.totals(life, CASE, {"last_pos": F.max("pos")}, local=True)
    df = O.scan(df, ["caseid", "task"], ["pos"], {"end_ts": ("last", F.when(_is("complete"), F.col("ts")), "after")})
    lost = _is("start") & F.col("end_ts").isNull() & (F.col("pos") < F.col("last_pos"))
    df = O.totals(df, CASE, {"broken": F.max(lost.cast("int"))}, local=True)
    df = df.filter((F.col("broken") == 0) & _is("start") & F.col("end_ts").isNotNull())
    return df.withColumnRenamed("ts", "start_ts").select(*LOG_COLS)


def _kth(life: DataFrame, keys: list[str]) -> DataFrame:
    counted = O.row_index(life, keys + ["transition"], ["pos"], "k")
    start, done = _is("start"), _is("complete")
    return counted.groupBy(*keys, "k").agg(
        F.max(F.when(start, F.col("ts"))).alias("start_ts"),
        F.max(F.when(done, F.col("ts"))).alias("end_ts"),
        F.max(F.when(start, F.col("user"))).alias("user"),
        F.max(F.when(start, F.col("pos"))).alias("pos"),
    )


def pair_strict(life: DataFrame) -> DataFrame:
    """k-th start with k-th complete per case and task; a case with unequal counts is dropped."""
    df = _kth(life, ["caseid", "task"])
    bad = (F.col("start_ts").isNull() | F.col("end_ts").isNull()).cast("int")
    df = O.totals(df, CASE, {"bad": F.max(bad)}, local="seg" not in life.columns)
    return df.filter(F.col("bad") == 0).select(*LOG_COLS)


def pair_fifo(life: DataFrame) -> DataFrame:
    """Each complete with the earliest open start of its task and resource.

    A complete that finds nothing open stays unpaired: the running maximum of (completes - starts)
    counts those, and the rest pair up in order.
    """
    keys = ["caseid", "task", "user"]
    df = O.scan(
        life,
        keys,
        ["pos"],
        {
            "starts": ("sum", _is("start").cast("int"), "upto"),
            "dones": ("sum", _is("complete").cast("int"), "upto"),
        },
    )
    df = O.scan(df, keys, ["pos"], {"excess": ("max", F.col("dones") - F.col("starts"), "upto")})
    df = df.withColumn("orphans", F.greatest(F.col("excess"), F.lit(0)))
    df = O.neighbours(df, keys, ["pos"], prev={"before": "orphans"})
    orphan = _is("complete") & (F.col("orphans") > F.coalesce(F.col("before"), F.lit(0)))
    df = df.filter(~orphan).withColumn("k", F.when(_is("start"), F.col("starts")).otherwise(F.col("dones") - F.col("orphans")))
    out = df.groupBy(*keys, "k").agg(
        F.max(F.when(_is("start"), F.col("ts"))).alias("start_ts"),
        F.max(F.when(_is("complete"), F.col("ts"))).alias("end_ts"),
        F.max(F.when(_is("start"), F.col("pos"))).alias("pos"),
        F.max(F.when(_is("complete"), F.col("pos"))).alias("end_pos"),
    )
    out = out.filter(F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull())
    return out.select(*LOG_COLS, "end_pos", (T.span_us("start_ts", "end_ts") / 1e6).alias("proc"))


def completes_only(life: DataFrame) -> DataFrame:
    """One-timestamp log: completes, start = end."""
    return life.filter(_is("complete")).select("caseid", "task", "user", F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts"), "pos")


def to_lifecycle(log: DataFrame) -> DataFrame:
    """One start and one complete row per activity."""
    return log.select(
        "caseid",
        "task",
        "user",
        F.explode(
            F.array(
                F.struct(F.lit("start").alias("transition"), F.col("start_ts").alias("ts")),
                F.struct(F.lit("complete").alias("transition"), F.col("end_ts").alias("ts")),
            )
        ).alias("e"),
        "pos",
    ).select("caseid", "task", "user", "e.ts", "e.transition", "pos")


def add_start_end(log: DataFrame) -> DataFrame:
    """Per case a Start row 1 µs before the first start and an End row 1 µs after the last end."""
    span = log.groupBy("caseid").agg(
        F.min("start_ts").alias("a"), F.max("end_ts").alias("b"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    a, b = F.expr("a - interval 1 microsecond"), F.expr("b + interval 1 microsecond")
    edge = span.select(
        "caseid",
        F.explode(
            F.array(
                F.struct(F.lit(START).alias("task"), a.alias("t"), (F.col("lo") - 1).alias("pos")),
                F.struct(F.lit(END).alias("task"), b.alias("t"), (F.col("hi") + 1).alias("pos")),
            )
        ).alias("e"),
    )
    edge = edge.select(
        "caseid", F.col("e.task").alias("task"), F.col("e.task").alias("user"), F.col("e.t").alias("start_ts"), F.col("e.t").alias("end_ts"), F.col("e.pos").alias("pos")
    )
    out = log.drop("seg").unionByName(edge, allowMissingColumns=True)
    return O.segment(out, CASE, "start_ts") if "seg" in log.columns else out


def positions(log: DataFrame, order: list[str] | None = None) -> DataFrame:
    """1-based position in the trace and trace length; ``order=["pos"]`` takes the record order."""
    df = O.row_index(log, CASE, order or ORDER, "pos_trace")
    return O.totals(df, CASE, {"trace_len": F.count("*")}, local=True)


def traces(log: DataFrame, one_ts: bool = False) -> DataFrame:
    """Cases as ordered arrays."""
    order = ["end_ts", "pos"] if one_ts else ORDER
    return O.gather(log, CASE, order, {"tasks": "task", "users": "user"})


def durations(log: DataFrame) -> DataFrame:
    """Processing time and waiting time (since the previous activity's end, never negative) in µs."""
    df = O.neighbours(log, CASE, ORDER, prev={"prev_end": "end_ts"})
    wait = F.greatest(F.coalesce(T.span_us("prev_end", "start_ts"), F.lit(0)), F.lit(0))
    return df.withColumns({"proc_us": T.span_us("start_ts", "end_ts"), "wait_us": wait}).drop("prev_end")


def replay_metrics(log: DataFrame, enable: str = "enable_ts") -> DataFrame:
    """Waiting, processing and multitasking µs of each activity against its enabling time."""
    gap = T.span_us(enable, "start_ts")
    full = T.span_us("start_ts", "end_ts")
    after = T.span_us(enable, "end_ts")
    late = (gap < 0) & (after > 0)
    return log.withColumns(
        {
            "wait_us": F.greatest(gap, F.lit(0)),
            "proc_us": F.when(late, after).otherwise(full),
            "multi_us": F.when(gap >= 0, F.lit(0).cast("long")).when(late, -gap).otherwise(full),
            "duration_us": after,
        }
    )


def scale_by_task(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Value over the task's maximum; 0 if that is not positive. New columns end in ``_norm``."""
    df = O.totals(df, keys or ["task"], {f"_m_{c}": F.max(c) for c in cols})
    norm = {c + "_norm": F.when(F.col(f"_m_{c}") > 0, F.col(c) / F.col(f"_m_{c}")).otherwise(F.lit(0.0)) for c in cols}
    return df.withColumns(norm).drop(*[f"_m_{c}" for c in cols])


def calendar_features(log: DataFrame) -> DataFrame:
    return log.withColumns(
        {
            "st_daytime": T.sec_of_day("start_ts"),
            "st_weekday": T.monday0("start_ts"),
            "end_daytime": T.sec_of_day("end_ts"),
            "end_weekday": T.monday0("end_ts"),
        }
    )


def day_moments(log: DataFrame) -> DataFrame:
    return log.withColumn("day_moment", T.day_moment("start_ts"))


def fit_max_abs(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the largest absolute value per column (``max_<col>``)."""
    return df.agg(*[F.max(F.abs(F.col(c))).alias("max_" + c) for c in cols])


def apply_max_abs(df: DataFrame, fitted: DataFrame, cols: list[str]) -> DataFrame:
    """Scale by the fitted maxima; null becomes 0."""
    df = df.crossJoin(F.broadcast(fitted))  # the fitted side is one row
    scaled = {
        c + "_scaled": F.coalesce(F.when(F.col("max_" + c) > 0, F.col(c) / F.col("max_" + c)).otherwise(F.col(c).cast("double")), F.lit(0.0))
        for c in cols
    }
    return df.withColumns(scaled).drop(*["max_" + c for c in cols])


def invert_max_abs(df: DataFrame, fitted: DataFrame, cols: list[str]) -> DataFrame:
    """Undo the scaling; negative predictions become 0."""
    df = df.crossJoin(F.broadcast(fitted))
    back = {
        c + "_back": F.greatest(F.col(c + "_scaled") * F.when(F.col("max_" + c) > 0, F.col("max_" + c)).otherwise(1), F.lit(0.0))
        for c in cols
    }
    return df.withColumns(back).drop(*["max_" + c for c in cols])


def category_index(log: DataFrame, feature: str) -> DataFrame:
    """Ids 1..n by first record; Start is 0 and End n+1; a null user counts as 'sys'."""
    value = F.coalesce(F.col(feature), F.lit(NO_USER)).alias("name")
    seen = log.filter(F.col(feature).isNull() | ~F.col(feature).isin(START, END)).select(value, "pos")
    firsts = seen.groupBy("name").agg(F.min("pos").alias("first_pos"))
    ids = O.global_index(firsts, ["first_pos", "name"], "id").select("name", F.col("id").cast("long").alias("id"))
    n = firsts.agg((F.count("*") + 1).alias("id"))
    ends = n.select(F.explode(F.array(F.struct(F.lit(START).alias("name"), F.lit(0).cast("long").alias("id")), F.struct(F.lit(END).alias("name"), F.col("id"))))).select("col.*")
    return ids.unionByName(ends)


def task_codes(log: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Dense 1-based code per distinct task (or feature tuple) in name order."""
    features = features or ["task"]
    names = log.select(*features).distinct()
    return O.global_index(names, features, "code")


def next_values(log: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Value of the case's next activity, e.g. ``{"next_task": "task"}``."""
    return O.neighbours(log, CASE, ORDER, next=cols)


def duration_edges(log: DataFrame) -> DataFrame:
    """``(k, edge)``: the quantile edges of the durations (seconds) for ``n = int(range / mean)`` bins.

    Durations are counted by value; each value then answers for the edges whose ranks it covers, so the
    number of bins may be large.
    """
    df = log.select((T.span_us("start_ts", "end_ts") / 1e6).alias("dur")).filter("dur is not null")
    counts = store(df.groupBy("dur").agg(F.count("*").alias("n")))
    s = counts.agg(F.min("dur").alias("a"), F.max("dur").alias("b"), F.sum("n").alias("n"), (F.sum(F.col("dur") * F.col("n")) / F.sum("n")).alias("m")).first()
    bins = max(int((s["b"] - s["a"]) / s["m"]) if s["m"] else 0, 1)
    ranked = O.scan(O.segment(counts, [], "dur"), [], ["dur"], {"hi": ("sum", F.col("n"), "upto")})
    ranked = O.neighbours(ranked, [], ["dur"], next={"above": "dur"})
    # edge k lies at rank k / bins * (n - 1): between this value and the next if its ceiling is past this value's last rank
    last = F.lit(s["n"] - 1)
    at = lambda k: k / F.lit(float(bins)) * last
    first = F.greatest(F.ceil((F.col("hi") - F.col("n")) * F.lit(float(bins)) / F.greatest(last, F.lit(1))) - 1, F.lit(0))
    upto = F.least(F.floor(F.col("hi") * F.lit(float(bins)) / F.greatest(last, F.lit(1))) + 1, F.lit(bins))
    e = ranked.filter(first <= upto).withColumn("k", F.explode(F.sequence(first.cast("long"), upto.cast("long"))))
    e = e.withColumn("at", at(F.col("k"))).filter((F.floor("at") >= F.col("hi") - F.col("n")) & (F.floor("at") < F.col("hi")))
    up = F.when(F.ceil("at") >= F.col("hi"), F.col("above")).otherwise(F.col("dur"))
    return e.select("k", (F.col("dur") + (up - F.col("dur")) * (F.col("at") - F.floor("at"))).alias("edge"))


def duration_bins(log: DataFrame) -> DataFrame:
    """Bin number of the activity's duration; bins are right-closed, the lowest value is in bin 0.

    Edges and durations run past each other in one ordered pass.
    """
    edges = store(duration_edges(log).select("edge").distinct())
    df = log.drop(O.SEG).withColumn("dur", T.span_us("start_ts", "end_ts") / 1e6)
    marks = edges.select(F.col("edge").alias("dur"), F.lit(1).alias("after"))
    both = df.withColumn("after", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    both = O.scan(O.segment(both, [], "dur"), [], ["dur", "after"], {"below": ("sum", F.col("after").cast("long"), "before")})
    out = both.filter("after = 0").withColumn("bin", F.greatest(F.col("below") - 1, F.lit(0)).cast("int"))
    return out.select(*df.columns, "bin")


def occurrence_labels(log: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Task name with the 0-based number of its occurrence in the case."""
    df = O.row_index(log, ["caseid", "task"], order or ORDER, "occ")
    return df.withColumn("label", F.concat("task", (F.col("occ") - 1).cast("string"))).drop("occ")


def case_profiles(log: DataFrame, true_end: bool = False) -> DataFrame:
    """Per case the arrays of tasks, times and scaled times, with start and end.

    ``end_time`` is the last activity's start unless ``true_end``.
    """
    df = scale_by_task(durations(log), ["proc_us", "wait_us"])
    fields = {"profile": "task", "proc_act_norm": "proc_us_norm", "wait_act_norm": "wait_us_norm", "proc": "proc_us", "wait": "wait_us"}
    out = O.gather(df, CASE, ORDER, fields)
    span = case_spans(log, true_end)
    return out.join(span, CASE)


def case_spans(log: DataFrame, true_end: bool = False) -> DataFrame:
    """Start and end time per case (the end is the last activity's start unless ``true_end``)."""
    return log.groupBy("caseid").agg(
        F.min("start_ts").alias("start_time"), (F.max("end_ts") if true_end else F.max("start_ts")).alias("end_time")
    )


def split_short_cases(log: DataFrame, short: bool) -> DataFrame:
    """Cases that consist of Start/End rows only (``short``), or all the others."""
    real = log.filter(~F.col("task").isin(START, END)).select("caseid").distinct()
    return log.join(real, CASE, "left_anti" if short else "left_semi")


def tag_sources(log: DataFrame, sim: DataFrame) -> DataFrame:
    """Union of a log and a simulated log with a ``source`` column; users become resources."""
    a = log.withColumn("source", F.lit("log"))
    b = sim.withColumn("source", F.lit("simulation")).withColumn("caseid", F.concat(F.lit("Case"), "caseid"))
    return a.unionByName(b, allowMissingColumns=True).withColumnRenamed("user", "resource")


def case_count(log: DataFrame) -> DataFrame:
    """Number of cases and the earliest start."""
    per_case = log.groupBy("caseid").agg(F.min("start_ts").alias("s"))
    return per_case.agg(F.count("*").alias("cases"), F.min("s").alias("first_start"))
