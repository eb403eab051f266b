"""What-if flows: disturb a log, extend a model by new tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from caseloom.operators import embed as E
from caseloom.operators import split as P


def disturb(log: DataFrame, method: str = "reduce_arrivals", reduction: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """The changed log and the hourly arrivals before and after."""
    if method == "reduce_arrivals":
        new = P.thin_arrivals(log)
    elif method == "reduce_times":
        new = P.shorten_waits(log, reduction)
    else:
        raise ValueError(method)
    return new, P.hourly_before_after(log, new)


def extend_model(vectors: DataFrame, log: DataFrame, roles_table: DataFrame, roles: DataFrame, log_size: int, seed: int = 1):
    """Vectors for the tasks the model does not know, and the pairs to train them with."""
    wide = E.extend_embedding(vectors, log.select("task"), seed)
    new = log.select("task").distinct().join(vectors.selectExpr("name as task"), "task", "left_anti")
    return wide, E.new_task_pairs(new, roles_table, roles, log_size, seed)
