"""What must hold for every random draw, whatever the numbers: sizes, ranges, and only what the model allows."""

from pyspark.sql import functions as F

from caseloom.model import ORDER
from caseloom.operators import arrivals as A
from caseloom.operators import flow as W
from caseloom.operators.profile import shares_per_task
from checks import graph as C
from checks import synthetic as Y
from checks.base import QUERIES, l2, l3, query, sql


def _bad(condition):
    """Number of rows that break a rule."""
    return F.sum(F.when(condition, 0).otherwise(1)).cast("long")


@query("t3_draws_hold", sql("l4", "with " + Y.CTX.format(v="l4") + " select count(*) n, 0 negative, count(distinct (last_act, task)) contexts from al where last_act is not null"))
def _(spark, d):
    df = QUERIES["t3_draw_times"](spark, d)
    return df.agg(F.count("*").alias("n"), _bad(F.col("secs") >= 0).alias("negative"), F.countDistinct("last_act", "task").alias("contexts"))


@query("t9_draws_hold", sql("l3", "with " + Y.LB + """ select count(*) n, 0 strangers,
 count(*) filter (task not in (select task from lb where side = 0)) unknown from lb where side = 1"""))
def _(spark, d):
    df = QUERIES["t9_assign_resources"](spark, d)
    train = Y.gen_train(spark, d)[1].select(F.col("task").alias("t"), F.col("user").alias("u")).distinct()
    users = train.select("u").distinct().withColumnRenamed("u", "known")
    tasks = train.select(F.col("t").alias("task_seen")).distinct()
    df = df.join(users, df["resource"] == users["known"], "left").join(tasks, df["task"] == tasks["task_seen"], "left")
    strange = F.col("resource").isNull() | F.col("known").isNotNull()
    return df.agg(F.count("*").alias("n"), _bad(strange).alias("strangers"), F.sum(F.col("task_seen").isNull().cast("long")).alias("unknown"))


@query("f13_draws_hold", sql("l3", "select count(distinct caseid) cases, 0 edges, 0 steps from l3"))
def _(spark, d):
    """Every drawn sequence runs from addstart to addend, and only steps of the log occur in it."""
    df = QUERIES["f13_sample_trigram"](spark, d).withColumn("s", F.split("seq", ">"))
    log = W.bounded_sequences(l3(spark, d)).select(F.col("seq").alias("s"))
    pairs = lambda x: x.select("*", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("i")).select(F.element_at("s", F.col("i")).alias("a"), F.element_at("s", F.col("i") + 1).alias("b"))
    new = pairs(df).distinct().join(pairs(log).distinct(), ["a", "b"], "left_anti").agg(F.count("*").alias("steps"))
    ends = (F.col("s")[0] == W.ADD_START) & (F.element_at("s", -1) == W.ADD_END)
    return df.agg(F.count("*").alias("cases"), _bad(ends).alias("edges")).crossJoin(new)  # two single rows


@query("a9_draws_hold", sql("l3", "select count(distinct caseid) n, 0 early from l3"))
def _(spark, d):
    last = A.case_arrivals(l3(spark, d)).agg(F.max("ts").alias("last"))
    df = QUERIES["a9_synthetic_arrivals"](spark, d).crossJoin(F.broadcast(last))  # one row
    return df.agg(F.count("*").alias("n"), _bad(F.col("timestamp") >= F.date_trunc("hour", "last").cast("timestamp_ntz")).alias("early"))


@query("k13_draws_hold", "select count(*) n, 0 uniform, 0 exponential, 0 triangular, 0 lognormal, 0 gamma from events")
def _(spark, d):
    df = QUERIES["k13_variates"](spark, d)
    return df.agg(
        F.count("*").alias("n"),
        _bad((F.col("uniform") >= 0) & (F.col("uniform") < 1)).alias("uniform"),
        _bad(F.col("exponential") >= 0).alias("exponential"),
        _bad(F.col("triangular").between(0, 3)).alias("triangular"),
        _bad(F.col("lognormal") > 0).alias("lognormal"),
        _bad(F.col("gamma") > 0).alias("gamma"),
    )


def _far(drawn, model, keys, item):
    """Number of items whose drawn number is more than five standard deviations (and one) from the model's share."""
    n = drawn.groupBy(*keys, item).agg(F.count("*").alias("k"))
    total = drawn.groupBy(*keys).agg(F.count("*").alias("all"))
    df = model.select(*keys, item, "prob").join(total, keys).join(n, [*keys, item], "left")
    mean = F.col("all") * F.col("prob")
    away = F.abs(F.coalesce("k", F.lit(0)) - mean)
    return df.agg(_bad(away <= 1 + 5 * F.sqrt(mean * F.greatest(1 - F.col("prob"), F.lit(0.0)))).alias("far"))


@query("k12_draws_hold", sql("l2", "select count(*) n, count(distinct pos) places, 0 strangers, 0 far from l2"))
def _(spark, d):
    """Every row draws one user of its task, each as often as its share says."""
    log = l2(spark, d)
    df = QUERIES["k12_weighted_choice"](spark, d).withColumnRenamed("drawn", "user")
    known = log.select("task", "user").distinct().withColumn("known", F.lit(True))
    out = df.join(known, ["task", "user"], "left").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("places"), _bad(F.coalesce("known", F.lit(False))).alias("strangers"))
    model = shares_per_task(log, "user").withColumnRenamed("share", "prob")
    return out.crossJoin(_far(df, model, ["task"], "user"))  # two single rows


@query("f13_shares_hold", sql("l3", "select count(distinct caseid) cases, 0 far from l3"))
def _(spark, d):
    """After every prefix the tokens are drawn as often as the model says."""
    df = QUERIES["f13_sample_prefix"](spark, d).withColumn("seq", F.split("seq", ">"))
    log = l3(spark, d)
    model = W.with_contexts(W.prefix_trie(log, ORDER), log, ORDER)
    return df.agg(F.count("*").alias("cases")).crossJoin(_far(W.prefix_pairs(df), model, ["ctx"], "nxt"))  # two single rows


@query("c11_draws_hold", sql("l8", "with " + C.GRAPH + ", " + C.BR + " select count(distinct gate) gates, count(*) paths, 0 outside, 0 sums from gp"))
def _(spark, d):
    """Every path of a gateway gets a share, and they add up to 1 but for their rounding."""
    df = QUERIES["c11_branch_random"](spark, d)
    sums = df.groupBy("gate").agg(F.sum("prob").alias("s"), F.count("*").alias("k"))
    sums = sums.agg(F.count("*").alias("gates"), _bad(F.abs(F.col("s") - 1) <= 0.005 * F.col("k") + 1e-9).alias("sums"))
    return df.agg(F.count("*").alias("paths"), _bad(F.col("prob").between(0, 1)).alias("outside")).crossJoin(sums)  # two single rows


@query("v8_decompositions_hold", sql("", """select m method, count(*) n, 0 lean, 0 unordered from embeddings, (select unnest(['pca','svd']) m) z where embedding is not null group by 1"""))
def _(spark, d):
    """New dimensions of all rows are orthogonal and come in the order of their energy."""
    out = None
    for m in ("pca", "svd"):
        v = QUERIES[f"v8_{m}"](spark, d).select(*[F.element_at("vec", k + 1).alias(f"x{k}") for k in range(3)])
        e = {f"e{a}{b}": F.sum(F.col(f"x{a}") * F.col(f"x{b}")) for a in range(3) for b in range(a, 3)}
        s = v.agg(F.count("*").alias("n"), *[x.alias(k) for k, x in e.items()])
        lean = sum((F.abs(f"e{a}{b}") > 1e-6 * F.sqrt(F.col(f"e{a}{a}") * F.col(f"e{b}{b}"))).cast("long") for a, b in ((0, 1), (0, 2), (1, 2)))
        order = (F.col("e00") < F.col("e11")).cast("long") + (F.col("e11") < F.col("e22")).cast("long")
        one = s.select(F.lit(m).alias("method"), "n", lean.alias("lean"), order.alias("unordered"))
        out = one if out is None else out.unionByName(one)
    return out
