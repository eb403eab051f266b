"""Exact quantiles with linear interpolation, without collecting a group's values in one task.

Equal values are counted first; a running count over the distinct values then locates the two ranks
each quantile needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.ordered import null_join, scan, segment


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """One row per group with the quantiles ``qs`` (new column -> fraction) of the non-null values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    counts = null_join(counts, sizes, keys, "inner") if keys else counts.crossJoin(F.broadcast(sizes))  # one-row side
    ranked = scan(segment(counts, keys, value), keys, [value], {"_hi": ("sum", F.col("_n"), "upto")})
    ranked = ranked.withColumn("_lo", F.col("_hi") - F.col("_n"))
    picks = []
    for name, q in qs.items():
        at = (F.col("_all") - 1) * F.lit(float(q))
        for tag, rank in (("l", F.floor(at)), ("h", F.ceil(at))):
            hit = (F.col("_lo") <= rank) & (rank < F.col("_hi"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{tag}_{name}"))
    out = ranked.groupBy(*keys).agg(F.first("_all").alias("_all"), *picks)
    cols = []
    for name, q in qs.items():
        at = (F.col("_all") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_l_{name}").cast("double"), F.col(f"_h_{name}").cast("double")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*keys, *cols)



