"""Case arrivals: gaps between case starts, hourly series, windowed statistics, forecast table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import ordered as O
from caseloom.functions import times as T
from caseloom.functions.quantiles import quantiles

HOUR_US = 3_600_000_000
WIDTHS = [1, 2, 4, 8, 12]


def case_arrivals(log: DataFrame, tasks: list[str] | DataFrame | None = None, one_ts: bool = False) -> DataFrame:
    """First start (end for one-timestamp logs) per case over the entry tasks."""
    if isinstance(tasks, list):
        log = log.filter(F.col("task").isin(tasks))
    elif tasks is not None:
        log = log.join(tasks, "task", "left_semi")
    return log.groupBy("caseid").agg(F.min("end_ts" if one_ts else "start_ts").alias("ts"))


def gaps_per_day(arrivals: DataFrame) -> DataFrame:
    """Seconds between consecutive arrivals of the same day."""
    df = O.segment(arrivals.withColumn("date", F.to_date("ts")), ["date"], "ts")
    df = O.neighbours(df, ["date"], ["ts", "caseid"], prev={"before": "ts"})
    df = df.filter(F.col("before").isNotNull())
    return df.select("caseid", "date", (T.span_us("before", "ts") / 1e6).alias("inter_time"))


def gaps_global(arrivals: DataFrame) -> DataFrame:
    """Seconds since the previous arrival (0 for the first), second of day and weekday."""
    df = O.neighbours(O.segment(arrivals, [], "ts"), [], ["ts", "caseid"], prev={"before": "ts"})
    return df.select(
        "caseid",
        F.coalesce(T.span_us("before", "ts") / 1e6, F.lit(0.0)).alias("inter_time"),
        F.col("ts").alias("timestamp"),
        T.sec_of_day("ts").alias("daytime"),
        T.monday0("ts").alias("weekday"),
    )


def dense_hours(arrivals: DataFrame, ts: str = "ts") -> DataFrame:
    """Arrivals per hour from the first to the last hour, 0 where there are none."""
    counts = arrivals.groupBy(T.floor_to("hour", ts).alias("ds")).agg(F.count("*").alias("y"))
    axis = counts.agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    axis = axis.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("ds"))
    return axis.join(counts, "ds", "left").select("ds", F.coalesce("y", F.lit(0)).alias("y"))


def hourly_series(arrivals: DataFrame) -> DataFrame:
    """Dense hourly counts with ``cap`` = 1.2 times the largest count and ``floor`` 0."""
    hours = dense_hours(arrivals)
    cap = hours.agg((F.max("y") * 1.2).alias("cap"))
    return hours.crossJoin(F.broadcast(cap)).withColumn("floor", F.lit(0.0))  # cap is one row


def renumber(arrivals: DataFrame) -> DataFrame:
    """Case1..n in arrival order."""
    df = O.global_index(arrivals, ["ts", "caseid"], "i")
    return df.select(F.concat(F.lit("Case"), F.col("i").cast("string")).alias("caseid"), F.col("ts").alias("timestamp"))


def window_gaps(arrivals: DataFrame, widths: list[int] | None = None) -> DataFrame:
    """Gaps inside windows of ``w`` hours of a day; the first is measured from its hour's beginning."""
    df = arrivals.withColumn("w", F.explode(F.array(*[F.lit(w) for w in widths or WIDTHS])))
    df = df.withColumns(
        {
            "window": (F.floor(F.hour("ts") / F.col("w")) + 1).cast("int"),
            "date": F.to_date("ts"),
            "weekday": T.monday0("ts"),
        }
    )
    keys = ["w", "window", "date"]
    df = O.neighbours(O.segment(df, keys, "ts"), keys, ["ts", "caseid"], prev={"before": "ts"})
    start = F.coalesce("before", T.floor_to("hour", "ts"))
    return df.select("w", "window", "date", "weekday", "caseid", (T.span_us(start, "ts") / 1e6).alias("inter_time"))


def trim(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keep values within [q15, q85] of their group; groups of one or two stay whole."""
    qs = quantiles(df, keys, value, {"q15": 0.15, "q85": 0.85})
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    df = O.null_join(df, O.null_join(qs, sizes, keys, "inner"), keys, "inner")
    # the interpolated bounds are compared with a little slack for rounding
    inside = F.col(value).between(F.col("q15") - 1e-9, F.col("q85") + 1e-9)
    return df.filter((F.col("_n") <= 2) | inside).drop("q15", "q85", "_n")


def daily_draws(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """``num``: arrivals to draw per day and group, half the median of the trimmed daily counts."""
    per_day = gaps.groupBy(*keys, "date").agg(F.count("*").alias("c"))
    num = quantiles(trim(per_day, keys, "c"), keys, "c", {"med": 0.5})
    return num.select(*keys, F.ceil(F.col("med") / 2).cast("int").alias("num"))


def window_stats(gaps: DataFrame) -> DataFrame:
    """Per width, window and weekday: trimmed gap statistics, arrivals to draw per day, and the mean and
    population variance of all gaps."""
    keys = ["w", "window", "weekday"]
    trimmed = trim(gaps, keys, "inter_time").groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("inter_time").alias("mean_trim"),
        F.stddev_pop("inter_time").alias("std_trim"),
        F.min("inter_time").alias("min_trim"),
        F.max("inter_time").alias("max_trim"),
    )
    num = daily_draws(gaps, keys)
    whole = gaps.groupBy(*keys).agg(F.avg("inter_time").alias("mean"), F.var_pop("inter_time").alias("var"))
    return trimmed.join(num, keys).join(whole, keys)


def moving_count(arrivals: DataFrame, hours: int = 3) -> DataFrame:
    """Arrivals in the ``hours`` up to and including each arrival (left end open).

    Difference of two running counts: at the arrival and ``hours`` earlier. Both are probes into one
    ordered sequence, so a busy hour is not copied around.
    """
    t = T.us("ts")
    probes = arrivals.select(
        "caseid",
        "ts",
        F.explode(
            F.array(
                F.struct(t.alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("one")),
                F.struct(t.alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("one")),
                F.struct((t - hours * HOUR_US).alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("one")),
            )
        ).alias("e"),
    ).select("caseid", "ts", "e.*")
    df = O.scan(O.segment(probes, [], "at"), [], ["at", "kind"], {"cum": ("sum", F.col("one"), "upto")})
    out = df.groupBy("caseid", "ts").agg(
        (F.max(F.when(F.col("kind") == 1, F.col("cum"))) - F.max(F.when(F.col("kind") == 2, F.col("cum")))).alias("arrivals")
    )
    return out


def rate_table(hours: DataFrame) -> DataFrame:
    """Expected, low (10 %) and high (90 %) arrivals per weekday and hour, within [0, 1.2 max]."""
    df = hours.select("y", T.monday0("ds").alias("weekday"), F.hour("ds").alias("hour"))
    keys = ["weekday", "hour"]
    qs = quantiles(df, keys, "y", {"low": 0.1, "high": 0.9})
    cap = hours.agg((F.max("y") * 1.2).alias("cap"))
    out = df.groupBy(*keys).agg(F.avg("y").alias("expected")).join(qs, keys).crossJoin(F.broadcast(cap))  # cap is one row
    clip = {c: F.greatest(F.least(F.col(c), F.col("cap")), F.lit(0.0)) for c in ("expected", "low", "high")}
    return out.withColumns(clip).select(*keys, "expected", "low", "high")
