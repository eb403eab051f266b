"""Connected components by repeated joins: smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes(id)``, ``edges(a, b)`` -> ``(id, root)``; root is the smallest id of the component.

    Rounds grow with the logarithm of the longest chain, because every round also follows the label's
    own label. Each round is written to the checkpoint folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.filter(F.col("a") != F.col("b")).distinct())
    lab = cut(nodes.select("id", F.col("id").alias("root")).distinct())
    while True:
        near = (
            both.join(lab.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("root").alias("near"))
        )
        step = lab.join(near, "id", "left").select("id", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        # hook: an old root takes the smallest label any of its members saw
        hook = step.groupBy(F.col("root").alias("r")).agg(F.min("new").alias("via"))
        step = step.join(hook, step["root"] == hook["r"]).select("id", "root", F.least("new", "via").alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        nxt = step.join(jump, "new", "left").select("id", "root", F.least("new", F.coalesce("far", "new")).alias("new"))
        nxt = cut(nxt)
        changed = nxt.filter(F.col("root") != F.col("new")).limit(1).count()
        lab = nxt.select("id", F.col("new").alias("root"))
        if not changed:
            return lab
