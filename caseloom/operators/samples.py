"""Training samples (sliding n-grams) and duration models."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import ordered as O
from caseloom.functions import times as T
from caseloom.model import ORDER
from caseloom.operators.shape import durations
from caseloom.session import cut

CASE = ["caseid"]


def one_hot_weekday(day: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: (d == day).cast("int"))


def event_features(log: DataFrame, task_ids: DataFrame) -> DataFrame:
    """Task index, next task index, times in seconds, calendar features per activity."""
    ids = task_ids.select(F.col("name").alias("task"), F.col("id").cast("int").alias("ac_index"))
    df = durations(log).join(ids, "task")
    if O.SEG in log.columns:
        df = O.segment(df.drop(O.SEG), CASE, "start_ts")
    df = O.neighbours(df, CASE, ORDER, next={"n_ac_index": "ac_index"})
    return df.withColumns(
        {
            "n_ac_index": F.coalesce("n_ac_index", F.lit(0)),
            "proc": F.col("proc_us") / 1e6,
            "wait": F.col("wait_us") / 1e6,
            "st_daytime": T.sec_of_day("start_ts") / 86400,
            "st_weekday": T.monday0("start_ts"),
            "end_daytime": T.sec_of_day("end_ts") / 86400,
            "end_weekday": T.monday0("end_ts"),
        }
    )


def _gram(col: str, n: int, current: bool) -> Column:
    """Array of the n last values, oldest first, 0 where the trace had not begun."""
    back = range(n - 1 if current else n, 0, -1)
    past = [F.coalesce(F.col(f"{col}__{k}"), F.lit(0)) for k in back]
    return F.array(*past, F.col(col)) if current else F.array(*past)


def sliding_ngrams(events: DataFrame, n: int) -> DataFrame:
    """n-grams up to the current activity. Times in the context stop one activity earlier; the targets
    are the current processing time and the waiting time before the next activity."""
    df = O.neighbours(events, CASE, ORDER, next={"ahead": "wait"})
    df = df.withColumn("wait_next", F.coalesce("ahead", F.lit(0.0)))
    df = O.lags(df, CASE, ORDER, ["ac_index", "st_daytime", "st_weekday", "proc", "wait_next"], n)
    df = O.row_index(df, CASE, ORDER, "i")
    return df.select(
        "caseid",
        (F.col("i") - 1).alias("ngram_num"),
        _gram("ac_index", n, True).alias("ac"),
        _gram("st_daytime", n, True).alias("daytime"),
        F.transform(_gram("st_weekday", n, True), one_hot_weekday).alias("weekday"),
        _gram("proc", n, False).alias("proc"),
        _gram("wait_next", n, False).alias("wait"),
        F.col("proc").alias("y_proc"),
        F.col("wait_next").alias("y_wait"),
    )


def prefix_ngrams(events: DataFrame, n: int, model: str) -> DataFrame:
    """n-grams before the current activity. ``model="proc"`` uses the activity and its start features,
    ``"wait"`` the next activity and the end features; the target is the current time."""
    act, y, tag = {"proc": ("ac_index", "proc", "st"), "wait": ("n_ac_index", "wait", "end")}[model]
    cols = [act, y, f"{tag}_daytime", f"{tag}_weekday"]
    df = O.row_index(O.lags(events, CASE, ORDER, cols, n), CASE, ORDER, "i")
    return df.select(
        "caseid",
        (F.col("i") - 1).alias("ngram_num"),
        _gram(act, n, False).alias("ac"),
        _gram(y, n, False).alias("times"),
        _gram(f"{tag}_daytime", n, False).alias("daytime"),
        F.transform(_gram(f"{tag}_weekday", n, False), one_hot_weekday).alias("weekday"),
        F.col(y).alias("y"),
    )


def prefix_ngrams_next(events: DataFrame, n: int) -> DataFrame:
    """n-grams before the current activity with next activities and both targets."""
    cols = ["ac_index", "n_ac_index", "proc", "wait", "st_daytime", "st_weekday"]
    df = O.row_index(O.lags(events, CASE, ORDER, cols, n), CASE, ORDER, "i")
    return df.select(
        "caseid",
        (F.col("i") - 1).alias("ngram_num"),
        *[_gram(c, n, False).alias(a) for c, a in (("ac_index", "ac"), ("n_ac_index", "next_ac"), ("proc", "procs"), ("wait", "waits"), ("st_daytime", "daytime"))],
        F.transform(_gram("st_weekday", n, False), one_hot_weekday).alias("weekday"),
        F.col("proc").alias("y_proc"),
        F.col("wait").alias("y_wait"),
    )


def arrival_ngrams(gaps: DataFrame, n: int) -> DataFrame:
    """n-grams over the arrival sequence of the whole log (input: ``gaps_global``)."""
    df = gaps.withColumn("day_part", F.col("daytime") / 86400)
    df = O.segment(df, [], "timestamp")
    df = O.lags(df, [], ["timestamp", "caseid"], ["inter_time", "day_part", "weekday"], n)
    return df.select(
        "caseid",
        _gram("inter_time", n, False).alias("gaps"),
        _gram("day_part", n, False).alias("daytime"),
        F.transform(_gram("weekday", n, False), one_hot_weekday).alias("weekday"),
        F.col("inter_time").alias("y"),
    )


# ---- duration models


def flat_features(grams: DataFrame, n: int) -> DataFrame:
    """The context arrays as numeric columns ``x0...`` for the regressors."""
    cols = [F.col("ac")[k] for k in range(n)] + [F.col(c)[k] for c in ("proc", "wait") for k in range(n)]
    cols += [F.col("daytime")[n - 1]] + [F.col("weekday")[n - 1][k] for k in range(7)]
    keep = [c for c in ("caseid", "ngram_num", "y_proc", "y_wait") if c in grams.columns]
    return grams.select(*keep, *[c.cast("double").alias(f"x{k}") for k, c in enumerate(cols)])


#: Rows that one task of a training pass reads, about.
PART_ROWS = 1_000_000


def training_rows(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` of ``flat_features`` cached for training, in partitions of ``part_rows`` rows, or one per core if that is more.

    Boosting is hundreds of passes, and every task of a pass reports to the driver, so there are no more partitions than the
    rows need. Rows are dealt and sorted by their keys: a model does not depend on the order in which they arrive.
    """
    rows = rows.cache()
    n = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / part_rows))
    if rows.rdd.getNumPartitions() <= n:
        return rows
    packed = rows.repartition(n, "caseid", "ngram_num").sortWithinPartitions(*rows.columns).cache()
    packed.count()
    rows.unpersist()
    return packed


def duration_model(train: DataFrame, target: str, n: int, depths=(2, 4), trees: int = 5, seed: int = 1):
    """Boosted trees over the flat features, the depth chosen on a held-out part by mean absolute error."""
    x = VectorAssembler(inputCols=[f"x{k}" for k in range(3 * n + 8)], outputCol="features")
    gbt = GBTRegressor(labelCol=target, predictionCol="p_" + target[2:], maxIter=trees, seed=seed, maxBins=32)
    grid = ParamGridBuilder().addGrid(gbt.maxDepth, list(depths)).build()
    ev = RegressionEvaluator(labelCol=target, predictionCol="p_" + target[2:], metricName="mae")
    tv = TrainValidationSplit(estimator=Pipeline(stages=[x, gbt]), estimatorParamMaps=grid, evaluator=ev, trainRatio=0.8, seed=seed)
    return tv.fit(train).bestModel


def predict(models: dict, df: DataFrame) -> DataFrame:
    """Apply the ``proc`` and ``wait`` models; negative predictions become 0."""
    for name in ("proc", "wait"):
        df = models[name].transform(df).drop("features").withColumn("p_" + name, F.greatest(F.col("p_" + name), F.lit(0.0)))
    return df


def prediction_loss(scored: DataFrame) -> DataFrame:
    """Mean absolute errors and the loss 0.5 proc + 0.5 wait."""
    e = scored.agg(F.avg(F.abs(F.col("y_proc") - F.col("p_proc"))).alias("mae_proc"), F.avg(F.abs(F.col("y_wait") - F.col("p_wait"))).alias("mae_wait"))
    return e.withColumn("loss", 0.5 * F.col("mae_proc") + 0.5 * F.col("mae_wait"))


def best_trial(trials: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The successful trial with the lowest loss; a stored model stays if its loss is lower."""
    rows = trials.filter("status = 'ok'")
    if stored is not None:
        rows = rows.unionByName(stored, allowMissingColumns=True)
    return rows.agg(F.min(F.struct("loss", *[c for c in rows.columns if c != "loss"])).alias("b")).select("b.*")


def roll_forward(seqs: DataFrame, arrivals: DataFrame, models: dict, n: int) -> DataFrame:
    """Timestamps for generated sequences from the duration models, without inter-case effects.

    ``seqs(caseid, idx, task, ac_index)`` with idx from 0, ``arrivals(caseid, ts)``. All cases are scored
    together, one position at a time: end = start + proc, next start = end + wait.
    """
    zeros = F.array_repeat(F.lit(0.0), n)
    state = arrivals.select("caseid", T.us("ts").alias("t"), F.array_repeat(F.lit(0), n).alias("ac"), zeros.alias("proc"), zeros.alias("wait"))
    out, idx = None, 0
    while True:
        here = seqs.filter(F.col("idx") == idx).select("caseid", "task", "ac_index")
        df = state.join(here, CASE)
        at = F.timestamp_micros("t").cast("timestamp_ntz")
        df = df.withColumn("ac", F.concat(F.slice("ac", 2, n - 1), F.array("ac_index")))
        x = df.withColumns(
            {"daytime": F.array_repeat(T.sec_of_day(at) / 86400, n), "weekday": F.array_repeat(one_hot_weekday(T.monday0(at)), n)}
        )
        num = [F.col("ac")[k] for k in range(n)] + [F.col(c)[k] for c in ("proc", "wait") for k in range(n)]
        num += [F.col("daytime")[n - 1]] + [F.col("weekday")[n - 1][k] for k in range(7)]
        x = x.withColumns({f"x{k}": c.cast("double") for k, c in enumerate(num)})
        x = predict(models, x)
        end = F.col("t") + F.round(F.col("p_proc") * 1e6).cast("long")
        x = cut(
            x.select(
                "caseid", F.lit(idx).alias("idx"), "task", F.col("t").alias("start"), end.alias("end"), "ac",
                F.concat(F.slice("proc", 2, n - 1), F.array("p_proc")).alias("proc"),
                F.concat(F.slice("wait", 2, n - 1), F.array("p_wait")).alias("wait"),
                (end + F.round(F.col("p_wait") * 1e6).cast("long")).alias("t"),
            )
        )
        if x.limit(1).count() == 0:
            break
        rows = x.select("caseid", "idx", "task", *[F.timestamp_micros(F.col(c)).cast("timestamp_ntz").alias(a) for c, a in (("start", "start_ts"), ("end", "end_ts"))])
        out = rows if out is None else out.unionByName(rows)
        state = x.select("caseid", "t", "ac", "proc", "wait")
        idx += 1
    return out
