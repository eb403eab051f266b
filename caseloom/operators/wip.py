"""Work in progress and resource occupancy over time.

The input carries Start and End rows. Changes are summed per timestamp first; the running totals are
then made over the timestamps of the whole log in time segments (``functions.ordered``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import ordered as O
from caseloom.model import END, ORDER, START
from caseloom.operators.shape import to_lifecycle
from caseloom.session import store


def expanded(log: DataFrame) -> DataFrame:
    """Transitions in time order (start before complete at ties), numbered over the whole log."""
    df = to_lifecycle(log).withColumn("late", (F.col("transition") == "complete").cast("int"))
    return O.global_index(df, ["ts", "late", "pos", "caseid", "task"], "n").drop("late")


def _changes(log: DataFrame) -> DataFrame:
    one = F.when(F.col("transition") == "start", 1).otherwise(-1)
    life = log.select("caseid", "task", "user", "pos", *[c for c in ("role",) if c in log.columns], F.explode(
        F.array(
            F.struct(F.lit("start").alias("transition"), F.col("start_ts").alias("ts")),
            F.struct(F.lit("complete").alias("transition"), F.col("end_ts").alias("ts")),
        )
    ).alias("e")).select("*", "e.transition", "e.ts").drop("e")
    return life.withColumn("change", one)


def _is_edge():
    return F.col("task").isin(START, END)


def process_wip(log: DataFrame) -> DataFrame:
    """``(ts, wip)``: open cases after all events of each timestamp."""
    step = F.when((F.col("task") == START) & (F.col("change") == 1), 1).when((F.col("task") == END) & (F.col("change") == -1), -1).otherwise(0)
    per = _changes(log).groupBy("ts").agg(F.sum(step).alias("d"))
    out = O.scan(O.segment(per, [], "ts"), [], ["ts"], {"wip": ("sum", F.col("d"), "upto")})
    return out.select("ts", "wip")


def task_wip(log: DataFrame) -> DataFrame:
    """``(task, ts, t_wip)`` at each change: active instances of the task (rows without role ignored)."""
    df = _changes(log).filter(~_is_edge())
    if "role" in log.columns:
        df = df.filter(F.col("role").isNotNull())
    per = df.groupBy("task", "ts").agg(F.sum("change").alias("d"))
    out = O.scan(O.segment(per, ["task"], "ts"), ["task"], ["ts"], {"t_wip": ("sum", F.col("d"), "upto")})
    return out.select("task", "ts", "t_wip")


def role_sizes(roles: DataFrame) -> DataFrame:
    return roles.groupBy("role").agg(F.countDistinct("user").alias("size"))


def role_occupancy(log: DataFrame, roles: DataFrame) -> DataFrame:
    """``(role, ts, occupancy)`` at each change: active instances over the role's users."""
    df = _changes(log).filter(~_is_edge() & F.col("role").isNotNull())
    per = df.groupBy("role", "ts").agg(F.sum("change").alias("d"))
    out = O.scan(O.segment(per, ["role"], "ts"), ["role"], ["ts"], {"active": ("sum", F.col("d"), "upto")})
    return out.join(role_sizes(roles), "role").select("role", "ts", (F.col("active") / F.col("size")).alias("occupancy"))


def role_columns(roles: list[str]) -> dict[str, str]:
    """A column name per role, from the letters and digits of its name; names that look alike are numbered."""
    out: dict[str, str] = {}
    for role in roles:
        base = name = re.sub(r"\W+", "_", role.strip().lower())
        k = 1
        while name in out.values():
            k += 1
            name = f"{base}_{k}"
        out[role] = name
    return out


def all_occupancies(log: DataFrame, roles: DataFrame, most: int = 1000) -> DataFrame:
    """``(ts, <role>_oc ...)`` at every timestamp: one running total per role, in one pass over time.

    The roles become columns, so their number is checked.
    """
    sizes = role_sizes(roles).orderBy("role").limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} roles to turn into columns")
    names = role_columns([r["role"] for r in sizes])
    hit = {n: F.sum(F.when((F.col("role") == r) & ~_is_edge(), F.col("change")).otherwise(0)) for r, n in names.items()}
    per = _changes(log).groupBy("ts").agg(*[c.alias(n + "_d") for n, c in hit.items()])
    out = O.scan(O.segment(per, [], "ts"), [], ["ts"], {n + "_a": ("sum", F.col(n + "_d"), "upto") for n in hit})
    return out.select("ts", *[(F.col(names[r["role"]] + "_a") / r["size"]).alias(names[r["role"]] + "_oc") for r in sizes])


def attach_features(log: DataFrame, roles: DataFrame, mode: str = "all", dual: bool = True) -> DataFrame:
    """Each activity with WIP, task WIP and occupancy at its start (and end).

    ``mode="all"`` gives every role's occupancy, ``"own"`` the activity's own role and the next
    activity's role (0 if there is none).
    """
    df = log
    if mode == "own":
        df = O.neighbours(df, ["caseid"], ORDER, next={"next_role": "role"})
    df = store(df)  # the changes of three kinds and the joins read it
    wip, twip = process_wip(df), task_wip(df)
    if mode == "all":
        states = _states(wip.join(all_occupancies(df, roles), "ts", "left"), {"t_wip": ("task", twip)})
    else:
        occ = store(role_occupancy(df, roles))
        states = _states(wip, {"t_wip": ("task", twip), "oc": ("role", occ.withColumnRenamed("occupancy", "oc"))})
    states = store(states)
    kinds = {"t_wip": "task"} if mode == "all" else {"t_wip": "task", "oc": "role"}
    for tag, ts in (("st", "start_ts"), ("end", "end_ts"))[: 2 if dual else 1]:
        at = states.withColumnsRenamed({c: c[: -len("_oc")] + f"_{tag}_oc" for c in states.columns if c.endswith("_oc")})
        at = at.withColumnsRenamed({"ts": ts, "wip": f"{tag}_wip"} | {k: f"_{k}" for k in kinds})
        df = df.join(at, ts, "left")
        df = df.withColumns({f"{tag}_{k}": F.when(F.col(c).isNotNull(), F.try_element_at(f"_{k}", c)) for k, c in kinds.items()})
        df = df.drop(*[f"_{k}" for k in kinds])
    if mode == "own":
        df = _last_occupancy(store(df), occ).withColumn("next_oc", F.coalesce("next_oc", F.lit(0.0)))
    return df


def _states(wip: DataFrame, values: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """``wip`` with, per timestamp, the values of the keys that change at it as maps: name -> (key column, table).

    A timestamp has a key once, so a map is at most the vocabulary; all values then join by time in one shuffle.
    """
    for name, (key, df) in values.items():
        pair = F.struct(F.col(key).alias("key"), F.col(name).alias("value"))
        maps = df.filter(F.col(key).isNotNull()).groupBy("ts").agg(F.map_from_entries(F.collect_list(pair)).alias(name))
        wip = wip.join(maps, "ts", "left")
    return wip


def _last_occupancy(df: DataFrame, occ: DataFrame) -> DataFrame:
    """Occupancy of the next role as of the activity's start: markers and probes in one ordered pass."""
    marks = occ.select(F.col("role").alias("r"), F.col("ts").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("caseid"), F.col("occupancy").alias("v"))
    probes = df.filter(F.col("next_role").isNotNull()).select(
        F.col("next_role").alias("r"), F.col("start_ts").alias("at"), F.lit(1).alias("kind"), "pos", "caseid", F.lit(None).cast("double").alias("v")
    )
    both = O.segment(marks.unionByName(probes), ["r"], "at")
    both = O.scan(both, ["r"], ["at", "kind"], {"next_oc": ("last", F.col("v"), "upto")}).filter("kind = 1")
    return df.join(both.select("caseid", "pos", "next_oc"), ["caseid", "pos"], "left")


def mean_states(log: DataFrame) -> DataFrame:
    """``(task, mean)``: mean WIP over the distinct timestamps (task null) and mean task WIP over all of
    them. A task's value counts for every timestamp until its next change."""
    wip = process_wip(log)
    index = O.global_index(wip, ["ts"], "i")
    n = wip.agg(F.count("*").alias("all"))
    overall = wip.agg(F.lit(None).cast("string").alias("task"), (F.sum("wip") / F.count("*")).alias("mean"))
    t = task_wip(log).join(index.select("ts", "i"), "ts")
    t = O.neighbours(O.segment(t, ["task"], "i"), ["task"], ["i"], next={"until": "i"}).crossJoin(F.broadcast(n))  # one row
    held = F.coalesce("until", F.col("all") + 1) - F.col("i")
    per = t.groupBy("task").agg((F.sum(F.col("t_wip") * held) / F.max("all")).alias("mean"))
    return overall.unionByName(per)
