"""Schemas of the event-log tables.

The interval log (one row per executed activity) is the shape every operator takes. ``pos`` is the
record order and breaks timestamp ties.
"""

from __future__ import annotations

from pyspark.sql import types as T

LOG = T.StructType(
    [
        T.StructField("caseid", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("start_ts", T.TimestampNTZType()),
        T.StructField("end_ts", T.TimestampNTZType()),
        T.StructField("pos", T.LongType()),
    ]
)

LIFECYCLE = T.StructType(
    [
        T.StructField("caseid", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("transition", T.StringType()),
        T.StructField("pos", T.LongType()),
    ]
)

LOG_COLS = ["caseid", "task", "user", "start_ts", "end_ts", "pos"]
LIFE_COLS = ["caseid", "task", "user", "ts", "transition", "pos"]
ORDER = ["start_ts", "pos"]

# The names the input and output formats use.
START, END = "Start", "End"
NO_USER, SYSTEM_USER = "sys", "AUTO"
