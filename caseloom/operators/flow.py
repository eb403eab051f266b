"""Control flow: directly-follows relation, footprint, transition models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import ordered as O
from caseloom.functions.quantiles import quantiles
from caseloom.model import END, ORDER
from caseloom.operators.profile import task_names

# Names of the boundary activities and of the footprint relations.
ADD_START, ADD_END = "addstart", "addend"
FOLLOWS, PRECEDES, NOT_CONNECTED, PARALLEL = "FOLLOWS", "PRECEDES", "NOT_CONNECTED", "PARALLEL"


def directly_follows(log: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``(a, b, n)``: how often b directly follows a."""
    df = O.neighbours(log, ["caseid"], order or ORDER, next={"b": "task"})
    return df.filter(F.col("b").isNotNull()).groupBy(F.col("task").alias("a"), "b").agg(F.count("*").alias("n"))


def short_loops(log: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Pairs (a, b) of a-b-a patterns that begin at an even 0-based position, in both directions."""
    order = order or ORDER
    df = O.row_index(log, ["caseid"], order, "i")
    df = O.neighbours(df, ["caseid"], order, next={"b": "task"})
    df = O.neighbours(df, ["caseid"], order, next={"c": "b"})
    hit = df.filter(((F.col("i") - 1) % 2 == 0) & (F.col("task") == F.col("c"))).select(F.col("task").alias("a"), "b").distinct()
    return hit.unionByName(hit.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def footprint(log: DataFrame, loops: bool = True, order: list[str] | None = None) -> DataFrame:
    """``(a, b, rel)`` for all pairs of tasks.

    A self loop counts as FOLLOWS; a-b-a loops make both directions PRECEDES.
    """
    names = F.array(*[F.lit(t) for t in task_names(log)])
    dfg = directly_follows(log, order).select("a", "b")
    axis = log.sparkSession.range(1).select(F.explode(names).alias("a")).withColumn("b", F.explode(names))
    ab = dfg.withColumn("ab", F.lit(True))
    ba = dfg.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("ba"))
    df = axis.join(ab, ["a", "b"], "left").join(ba, ["a", "b"], "left")
    rel = (
        F.when(F.col("a") == F.col("b"), F.when(F.col("ab"), FOLLOWS).otherwise(NOT_CONNECTED))
        .when(F.col("ab") & F.col("ba"), PARALLEL)
        .when(F.col("ab"), PRECEDES)
        .when(F.col("ba"), FOLLOWS)
        .otherwise(NOT_CONNECTED)
    )
    if loops:
        df = df.join(short_loops(log, order).withColumn("lp", F.lit(True)), ["a", "b"], "left")
        rel = F.when(F.col("lp"), PRECEDES).otherwise(rel)
    return df.select("a", "b", rel.alias("rel"))


def variants(log: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``(seq, n)``: distinct task sequences and their number of cases."""
    return O.gather(log, ["caseid"], order or ORDER, {"seq": "task"}).groupBy("seq").agg(F.count("*").alias("n"))


def filtered_graph(dfg: DataFrame, epsilon: float = 0.3, eta: float = 0.4) -> DataFrame:
    """Frequency-filtered directly-follows edges ``(a, b, n)``.

    Two directions of about equal weight (relative difference under ``epsilon``) are concurrency and are
    dropped; of the rest the edges at or above the ``eta`` quantile of frequency stay, and the best
    incoming and outgoing edge of every node.
    """
    rev = dfg.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("back"))
    df = dfg.join(rev, ["a", "b"], "left").withColumn("back", F.coalesce("back", F.lit(0)))
    even = F.abs(F.col("n") - F.col("back")) / (F.col("n") + F.col("back")) < epsilon
    df = df.filter((F.col("a") == F.col("b")) | (F.col("back") == 0) | ~even).select("a", "b", "n")
    cut = quantiles(df, [], "n", {"cut": eta})
    best_out = df.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("neg"), "b"))["b"].alias("bo"))
    best_in = df.groupBy("b").agg(F.min(F.struct((-F.col("n")).alias("neg"), "a"))["a"].alias("bi"))
    df = df.crossJoin(F.broadcast(cut)).join(best_out, "a").join(best_in, "b")  # cut is one row
    keep = (F.col("n") >= F.col("cut")) | (F.col("b") == F.col("bo")) | (F.col("a") == F.col("bi"))
    return df.filter(keep).select("a", "b", "n")


def bounded_sequences(log: DataFrame, order: list[str] | None = None, token: str = "task") -> DataFrame:
    """Per case the token sequence between addstart and addend."""
    df = O.gather(log, ["caseid"], order or ORDER, {"seq": token})
    return df.select("caseid", F.concat(F.array(F.lit(ADD_START)), "seq", F.array(F.lit(ADD_END))).alias("seq"))


def transitions(pairs: DataFrame) -> DataFrame:
    """``(ctx, nxt)`` rows -> counts, probabilities (ten decimals) and cumulative bounds."""
    n = pairs.groupBy("ctx", "nxt").agg(F.count("*").alias("n"))
    total = n.groupBy("ctx").agg(F.sum("n").alias("all"))
    df = n.join(total, "ctx").withColumn("prob", F.round(F.col("n") / F.col("all"), 10))
    return df.drop("all")


def with_bounds(model: DataFrame, key: list[str], item: str, prob: str = "prob") -> DataFrame:
    """Cumulative interval [cum_lo, cum_hi) of each item; the last one is open to 1 (rounding gap)."""
    df = O.scan(model, key, [item], {"cum_hi": ("sum", F.col(prob), "upto")})
    df = O.neighbours(df, key, [item], next={"_more": F.lit(1)})
    return df.withColumns(
        {
            "cum_lo": F.col("cum_hi") - F.col(prob),
            "cum_hi": F.when(F.col("_more").isNull(), F.lit(2.0)).otherwise(F.col("cum_hi")),
        }
    ).drop("_more")


def prefix_pairs(seqs: DataFrame) -> DataFrame:
    """Every prefix of length 1 or more with the token after it."""
    i = F.explode(F.sequence(F.lit(1), F.size("seq") - 1)).alias("i")
    df = seqs.select("seq", i)
    return df.select(F.slice("seq", F.lit(1), F.col("i")).alias("ctx"), F.element_at("seq", F.col("i") + 1).alias("nxt"))


#: A prefix: its length without addstart, and two running sums of hashes of (token, place).
NODE = ["depth", "sum_a", "sum_b"]


def prefix_trie(rows: DataFrame, order: list[str], token: str = "task") -> DataFrame:
    """The prefixes of all cases as a tree: ``(depth, sum_a, sum_b, nxt, to_depth, to_sum_a, to_sum_b, n, prob, caseid)``.

    One row per prefix and token after it, with the node that both lead to and a case that passes here; the empty prefix (addstart alone)
    is all zeros, and addend leads nowhere. A prefix is known by sums that a scan carries through the case, so one row per event
    moves, whatever the length of the cases. ``with_contexts`` writes prefixes out.
    """
    df = O.row_index(rows.withColumn("nxt", F.col(token)), ["caseid"], order, "to_depth")
    part = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "nxt", "to_depth"), F.lit(1 << 36))
    df = df.withColumns({"_a": part(1), "_b": part(2)})
    df = O.scan(df, ["caseid"], order, {"to_sum_a": ("sum", F.col("_a"), "upto"), "to_sum_b": ("sum", F.col("_b"), "upto")})
    steps = df.select(
        (F.col("to_depth") - 1).alias("depth"), (F.col("to_sum_a") - F.col("_a")).alias("sum_a"), (F.col("to_sum_b") - F.col("_b")).alias("sum_b"),
        "nxt", "to_depth", "to_sum_a", "to_sum_b", "caseid",
    )
    ends = df.groupBy("caseid").agg(F.max("to_depth").alias("depth"), F.sum("_a").alias("sum_a"), F.sum("_b").alias("sum_b"))
    none = [F.lit(None).cast(k).alias("to_" + c) for c, k in zip(NODE, ("int", "long", "long"))]
    steps = steps.unionByName(ends.select(*NODE, F.lit(ADD_END).alias("nxt"), *none, "caseid"))
    n = steps.groupBy(*NODE, "nxt").agg(F.count("*").alias("n"), *[F.first("to_" + c).alias("to_" + c) for c in NODE], F.min("caseid").alias("caseid"))
    total = n.groupBy(*NODE).agg(F.sum("n").alias("all"))
    return n.join(total, NODE).withColumn("prob", F.round(F.col("n") / F.col("all"), 10)).drop("all")


def with_contexts(trie: DataFrame, rows: DataFrame, order: list[str], token: str = "task") -> DataFrame:
    """``(ctx, nxt, n, prob)``: the trie with its prefixes written out, each from a case that passes it."""
    seqs = O.gather(rows, ["caseid"], order, {"seq": token})
    ctx = F.concat(F.array(F.lit(ADD_START)), F.slice("seq", F.lit(1), F.col("depth")))
    return trie.join(seqs, "caseid").select(ctx.alias("ctx"), "nxt", "n", "prob")


def ngram_pairs(seqs: DataFrame, n: int) -> DataFrame:
    """n-gram windows as (context, next); short sequences whole; for n > 2 also the shorter prefixes of
    the first n-1 tokens and suffixes of the last n-1."""
    size, s = F.size("seq"), F.col("seq")
    windows = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice(s, i, n))
    if n > 2:
        ks = F.array(*[F.lit(k) for k in range(2, n)])
        heads = F.transform(ks, lambda k: F.slice(s, F.lit(1), k))
        tails = F.transform(ks, lambda k: F.slice(s, size - k + 1, k))
        windows = F.concat(windows, heads, tails)
    grams = seqs.select(F.explode(F.when(size <= n, F.array(s)).otherwise(windows)).alias("g"))
    return grams.select(F.slice("g", F.lit(1), F.size("g") - 1).alias("ctx"), F.element_at("g", -1).alias("nxt"))


def role_sequences(log: DataFrame, roles: DataFrame, task_ids: DataFrame, default_role: str) -> DataFrame:
    """Task index, role of the task (default pool if none) and the pair (task, next task or End)."""
    from caseloom.operators.profile import dominant_role

    df = O.neighbours(log, ["caseid"], ORDER, next={"nxt": "task"})
    df = df.withColumn("nxt", F.coalesce("nxt", F.lit(END)))
    role = dominant_role(log, roles).select("task", "role")
    ids = task_ids.select(F.col("name").alias("task"), F.col("id").alias("ac_index"))
    nxt = task_ids.select(F.col("name").alias("nxt"), F.col("id").alias("next_index"))
    df = df.join(role, "task", "left").join(ids, "task").join(nxt, "nxt")
    return df.select("caseid", "pos", "ac_index", "next_index", F.coalesce("role", F.lit(default_role)).alias("role"))
