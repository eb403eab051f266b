"""Splitting a log by cases, sampling cases, and thinning arrivals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import ordered as O
from caseloom.functions.rand import hash_order
from caseloom.operators.arrivals import dense_hours
from caseloom.operators.shape import durations

# Normal quantile per confidence level used by the sample-size formula.
CONFIDENCE = {50: 0.67, 68: 0.99, 90: 1.64, 95: 1.96, 99: 2.57}


def case_starts(log: DataFrame, ts: str = "start_ts") -> DataFrame:
    return log.groupBy("caseid").agg(F.min(ts).alias("start_time"))


def _numbered(cases: DataFrame, order: list[str]) -> DataFrame:
    n = cases.agg(F.count("*").alias("n"))
    return O.global_index(cases, order, "i").crossJoin(F.broadcast(n))  # n is one row


def _mark(log: DataFrame, chosen: DataFrame) -> DataFrame:
    """``split`` = train for the chosen cases, test for the rest."""
    out = log.join(chosen.select("caseid", F.lit(True).alias("_in")), "caseid", "left")
    return out.withColumn("split", F.when(F.col("_in"), "train").otherwise("test")).drop("_in")


def timeline_contained(log: DataFrame, share: float = 0.8) -> DataFrame:
    """The first ``int(share * n)`` cases by start are train."""
    num = _numbered(case_starts(log), ["start_time", "caseid"])
    return _mark(log, num.filter(F.col("i") <= F.floor(F.lit(share) * F.col("n"))))


def timeline_trace(log: DataFrame, size: float) -> DataFrame:
    """The ``round(n * (1 - size))`` latest cases are test (half to even)."""
    num = _numbered(case_starts(log), ["start_time", "caseid"])
    return _mark(log, num.filter(F.col("i") <= F.col("n") - F.bround(F.col("n") * F.lit(1 - size), 0)))


def random_cases(log: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """A random ``int(share * n)`` of the cases are train; the draw does not depend on partitioning."""
    cases = log.select("caseid").distinct().withColumn("h", hash_order(seed, "caseid"))
    num = _numbered(cases, ["h", "caseid"])
    return _mark(log, num.filter(F.col("i") <= F.floor(F.lit(share) * F.col("n"))))


def contained_or_trace(log: DataFrame, size: float, share: float = 0.8) -> DataFrame:
    """Contained split, unless its test part has under ``int(10 %)`` of all events; then the trace split."""
    split = timeline_contained(log, share)
    c = split.agg(F.count("*").alias("n"), F.count(F.when(F.col("split") == "test", 1)).alias("t")).first()
    return timeline_trace(log, size) if c["t"] < int(c["n"] * 0.1) else split


def sample_size(population: int, level: int = 95, interval: float = 3.0) -> int:
    z, e = CONFIDENCE[level], interval / 100
    n0 = z * z * 0.25 / (e * e)
    return math.ceil(n0 / (1 + (n0 - 1) / population))


def sample_cases(log: DataFrame, seed: int = 1, level: int = 95, interval: float = 3.0) -> DataFrame:
    """A representative sample of the cases, for a confidence level and interval (percent)."""
    n = log.select("caseid").distinct().count()
    cases = log.select("caseid").distinct().orderBy(hash_order(seed, "caseid"), "caseid")
    return log.join(cases.limit(sample_size(n, level, interval) if n else 0), "caseid", "left_semi")


def arrival_chunks(log: DataFrame, chunks: int = 6) -> DataFrame:
    """Cases in ``chunks`` consecutive groups by start (earlier groups take the remainder), with the
    0-based position ``j`` in the group."""
    num = _numbered(case_starts(log), ["start_time", "caseid"])
    base, rem, i0 = F.floor(F.col("n") / chunks), F.col("n") % chunks, F.col("i") - 1
    big = rem * (base + 1)
    rest = F.greatest(base, F.lit(1))
    return num.select(
        "caseid",
        "start_time",
        F.when(i0 < big, F.floor(i0 / (base + 1))).otherwise(rem + F.floor((i0 - big) / rest)).cast("int").alias("chunk"),
        F.when(i0 < big, i0 % (base + 1)).otherwise((i0 - big) % rest).cast("int").alias("j"),
    )


def thinned_cases(log: DataFrame, step: int = 3) -> DataFrame:
    """All cases of even chunks and every third of odd ones."""
    return arrival_chunks(log).filter((F.col("chunk") % 2 == 0) | (F.col("j") % step == 0))


def thin_arrivals(log: DataFrame) -> DataFrame:
    return log.join(thinned_cases(log).select("caseid"), "caseid", "left_semi")


def chunk_dates(log: DataFrame) -> DataFrame:
    return arrival_chunks(log).groupBy("chunk").agg(F.min("start_time").alias("start_date"), F.max("start_time").alias("end_date"))


def shorten_waits(log: DataFrame, reduction: float = 0.3) -> DataFrame:
    """Thinned log with waiting times; in odd chunks they are cut by ``reduction``."""
    kept = log.join(thinned_cases(log).select("caseid", "chunk"), "caseid")
    odd = F.col("chunk") % 2 == 1
    return durations(kept).withColumn("new_wait", F.when(odd, F.col("wait_us") * (1 - reduction)).otherwise(F.col("wait_us").cast("double")))


def hourly_before_after(log: DataFrame, changed: DataFrame) -> DataFrame:
    """Case starts per hour in both logs, empty hours as 0."""
    a = dense_hours(case_starts(log), "start_time").withColumn("source", F.lit("original"))
    b = dense_hours(case_starts(changed), "start_time").withColumn("source", F.lit("modified"))
    return a.unionByName(b)


