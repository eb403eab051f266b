"""Process-model source: BPMN files, any number at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.session import prepare

# BPMN element names read as nodes.
KINDS = ["task", "exclusiveGateway", "inclusiveGateway", "parallelGateway", "startEvent", "endEvent", "intermediateCatchEvent"]
TIMER = "intermediateCatchEvent"

_NODE = "array<struct<_id: string, _name: string, _gatewayDirection: string>>"
SCHEMA = ", ".join(f"{k} {_NODE}" for k in KINDS) + ", sequenceFlow array<struct<_id: string, _sourceRef: string, _targetRef: string>>"


def read_bpmn(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``nodes(element_id, kind, name, direction)`` and ``edges(src, dst, flow_id)`` of all processes."""
    raw = prepare(spark).read.format("xml").option("rowTag", "process").option("ignoreNamespace", True).schema(SCHEMA).load(path)
    per_kind = [
        raw.select(F.explode(k).alias("e")).select(
            F.col("e._id").alias("element_id"),
            F.lit("timerEvent" if k == TIMER else k).alias("kind"),
            F.coalesce("e._name", F.lit("")).alias("name"),
            F.coalesce("e._gatewayDirection", F.lit("")).alias("direction"),
        )
        for k in KINDS
    ]
    flows = raw.select(F.explode("sequenceFlow").alias("f"))
    edges = flows.select(F.col("f._sourceRef").alias("src"), F.col("f._targetRef").alias("dst"), F.col("f._id").alias("flow_id"))
    return reduce(DataFrame.unionByName, per_kind), edges
