"""Conformance of cases with a process graph, replay times, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import ordered as O
from caseloom.model import END, LIFE_COLS, ORDER, START, SYSTEM_USER
from caseloom.operators.nearest import nearest
from caseloom.operators.shape import add_start_end
from caseloom.session import cut

CASE = ["caseid"]


def allowed_pairs(next_tasks: DataFrame) -> DataFrame:
    """Pairs a trace may contain: next tasks, and repeats of a task only by a loop of three flows."""
    loop = (F.col("a") != F.col("b")) | (F.size("path") == 4)
    return next_tasks.filter(loop).select("a", "b", "path")


def consecutive(log: DataFrame) -> DataFrame:
    """Consecutive task pairs of each case, with Start and End."""
    df = O.neighbours(add_start_end(log), CASE, ORDER, next={"b": "task"})
    return df.filter(F.col("b").isNotNull()).select("caseid", F.col("task").alias("a"), "b")


def conformance(log: DataFrame, next_tasks: DataFrame) -> DataFrame:
    """``(caseid, conformant)``: every consecutive pair, Start and End included, is allowed."""
    ok = allowed_pairs(next_tasks).select("a", "b", F.lit(1).alias("ok"))
    df = consecutive(log).join(ok, ["a", "b"], "left")
    return df.groupBy("caseid").agg((F.min(F.coalesce("ok", F.lit(0))) == 1).alias("conformant"))


def enabling_times(log: DataFrame, next_tasks: DataFrame) -> DataFrame:
    """``enable_ts``: end of the case's most recent earlier activity that can precede this task in the
    graph, else the activity's own end.

    Each activity leaves a marker for every task it can lead to; the activity then reads the last marker
    for its own task. One ordered pass, no pairing of activities with each other.
    """
    rel = next_tasks.filter(~F.col("a").isin(START)).filter(~F.col("b").isin(END)).select(F.col("a").alias("task"), F.col("b").alias("target"))
    seg = [O.SEG] if O.SEG in log.columns else []
    marks = log.join(rel, "task").select("caseid", *seg, "target", *ORDER, F.lit(1).alias("kind"), F.col("end_ts").alias("mark"))
    probes = log.select("caseid", *seg, F.col("task").alias("target"), *ORDER, F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("mark"), "user", "end_ts")
    df = probes.unionByName(marks, allowMissingColumns=True)
    df = O.scan(df, ["caseid", "target"], ORDER + ["kind"], {"enable_ts": ("last", F.col("mark"), "before")})
    df = df.filter(F.col("kind") == 0)
    return df.select("caseid", *seg, F.col("target").alias("task"), "user", "start_ts", "end_ts", "pos", F.coalesce("enable_ts", "end_ts").alias("enable_ts"))


def edge_executions(log: DataFrame, next_tasks: DataFrame, edges: DataFrame, which: str = "conformant") -> DataFrame:
    """``(src, dst, executions)``: how often each flow was passed (conformant cases, or ``all``)."""
    pairs = consecutive(log)
    if which == "conformant":
        good = conformance(log, next_tasks).filter("conformant").select("caseid")
        pairs = pairs.join(good, CASE, "left_semi")
    counts = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    p = allowed_pairs(next_tasks).join(counts, ["a", "b"])
    hops = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
    used = p.select("n", F.explode(hops).alias("h")).groupBy("h.src", "h.dst").agg(F.sum("n").alias("executions"))
    return edges.select("src", "dst").join(used, ["src", "dst"], "left").withColumn("executions", F.coalesce("executions", F.lit(0)))


def conformance_stats(log: DataFrame, conf: DataFrame) -> DataFrame:
    """Traces, events and the conformant percentage."""
    events = log.agg(F.count("*").alias("events"))
    s = conf.agg(F.count("*").alias("traces"), F.round(100 * F.avg(F.col("conformant").cast("double")), 4).alias("pct_conformant"))
    return s.crossJoin(events)  # two single rows


def keep_conformant(log: DataFrame, conf: DataFrame) -> DataFrame:
    return log.join(conf.filter("conformant"), CASE, "left_semi")


def replace_nonconformant(log: DataFrame, conf: DataFrame) -> DataFrame:
    """Replace each non-conformant case by its nearest conformant one: the smallest number of edits, the
    case that starts first on ties (then the smallest case id). Its id is the old id with ``R``.

    Distances are made between distinct sequences, not between cases, and only where pieces of them agree (see ``nearest``).
    """
    prof = O.gather(log, CASE, ORDER, {"seq": "task"})
    starts = log.groupBy("caseid").agg(F.min("start_ts").alias("start"))
    prof = cut(prof.select("caseid", "seq").join(conf, CASE).join(starts, CASE))
    bad = prof.filter(~F.col("conformant"))
    # a variant is known by its first case
    va = bad.groupBy("seq").agg(F.min("caseid").alias("a"))
    vb = prof.filter("conformant").groupBy("seq").agg(F.min(F.struct("start", "caseid")).alias("f"))
    vb = cut(vb.select(F.col("f.caseid").alias("b"), F.col("f.start").alias("start"), F.col("seq").alias("y")))
    near = nearest(va.select("a", F.col("seq").alias("x")), vb.select("b", "y"), swaps=True).join(vb.select("b", "start"), "b")
    near = near.groupBy("a").agg(F.min(F.struct("start", "b"))["b"].alias("nearest"))
    swap = bad.join(va, "seq").join(near, "a").select(F.col("caseid").alias("old"), F.col("nearest").alias("caseid"))
    cols = ["task", "user", "start_ts", "end_ts", "pos"]
    new = log.join(swap, CASE).select(F.concat("old", F.lit("R")).alias("caseid"), *cols)
    return keep_conformant(log, conf).select("caseid", *cols).unionByName(new)


def apply_alignment(life: DataFrame, cases: DataFrame, moves: DataFrame) -> DataFrame:
    """Repair cases by their alignment.

    ``cases(caseid, trace_type, fitness)``, ``moves(trace_type, m, move, task)``. LMGOOD takes the next
    log row, L skips it, MREAL adds an automatic start and complete at the previous row's time plus 1 µs.
    Fitness 1 keeps the case, fitness 0 drops it.
    """
    whole = life.join(cases.filter("fitness = 1").select("caseid"), CASE, "left_semi").select(*LIFE_COLS)
    partial = cases.filter("fitness > 0 and fitness < 1").select("caseid", "trace_type")
    plan = partial.join(moves.filter(~F.col("task").isin(START, END)), "trace_type")
    plan = O.segment(plan, CASE, "m")
    used = F.col("move").isin("LMGOOD", "L").cast("int")
    real = (F.col("move") == "MREAL").cast("int")
    plan = O.scan(plan, CASE, ["m"], {"j": ("sum", used, "upto"), "reals": ("sum", real, "upto")})
    rows = O.row_index(life, CASE, ["pos"], "j")
    first = life.groupBy("caseid").agg(F.min(F.struct("pos", "ts"))["ts"].alias("first_ts"))
    seg = [O.SEG] if O.SEG in plan.columns else []
    got = plan.select("caseid", *seg, "m", "j", "move", F.col("task").alias("model_task"), "reals")
    # only a LMGOOD move takes its log row
    row = rows.select("caseid", "j", "task", "user", "ts", "transition", F.lit("LMGOOD").alias("move"))
    got = got.join(row, ["caseid", "j", "move"], "left").join(first, CASE)
    got = O.scan(got, CASE, ["m"], {"base": ("last", F.when(F.col("move") == "LMGOOD", F.struct("ts", "reals")), "upto")})
    since = F.when(F.col("base").isNull(), F.col("reals") - 1).otherwise(F.col("reals") - F.col("base.reals"))
    at = F.unix_micros(F.coalesce("base.ts", "first_ts").cast("timestamp")) + since
    auto = F.timestamp_micros(at).cast("timestamp_ntz")
    good = got.filter("move = 'LMGOOD'").select("caseid", "m", F.lit(0).alias("half"), "task", "user", "ts", "transition")
    made = got.filter("move = 'MREAL'").select(
        "caseid",
        "m",
        F.explode(F.array(F.struct(F.lit(0).alias("half"), F.lit("complete").alias("transition")), F.struct(F.lit(1).alias("half"), F.lit("start").alias("transition")))).alias("e"),
        F.col("model_task").alias("task"),
        F.lit(SYSTEM_USER).alias("user"),
        auto.alias("ts"),
    ).select("caseid", "m", "e.half", "task", "user", "ts", "e.transition")
    out = good.unionByName(made).select("caseid", "task", "user", "ts", "transition", (F.col("m") * 2 + F.col("half")).cast("long").alias("pos"))
    return whole.unionByName(out)
