"""Evaluation flow: score generated logs against a held-out log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators import metrics as M


def evaluate(test: DataFrame, runs: DataFrame, matched: tuple[str, ...] = (), epsilon: float = 0.01) -> DataFrame:
    """``(run_num, metric, sim_val)`` for all runs (``run_num`` column). ``matched`` adds the metrics that
    need a case matching (tsd, dl, dl_mae), one matching per run."""
    out = M.sql_metrics(test, runs)
    if not matched:
        return out
    numbers = [r["run_num"] for r in runs.select("run_num").distinct().collect()]  # one per repetition
    parts = [
        M.matched_score(test, runs.filter(F.col("run_num") == n).drop("run_num"), m, epsilon).select(F.lit(n).alias("run_num"), "metric", "sim_val")
        for n in numbers
        for m in matched
    ]
    return reduce(DataFrame.unionByName, [out, *parts])
