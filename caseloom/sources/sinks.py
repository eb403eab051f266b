"""Sinks: XES, CSV, embedding matrices, and side tables that are reused when they exist."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import ordered as O
from caseloom.sources.logs import CONCEPT, CSV_NAMES, LIFECYCLE, TIME

# What a missing resource is called on export, and the timestamp format.
NO_RESOURCE = "no_resource"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _pair(key: str, value):
    return F.struct(F.lit(key).alias("_key"), value.alias("_value"))


def xes_traces(life: DataFrame) -> DataFrame:
    """One nested row per case, events by (time, record)."""
    event = F.struct(
        F.array(
            _pair(CONCEPT, F.col("task")), _pair(LIFECYCLE, F.col("transition")), _pair("user", F.coalesce("user", F.lit(NO_RESOURCE)))
        ).alias("string"),
        F.array(_pair(TIME, F.date_format("ts", TIME_FORMAT))).alias("date"),
    )
    ev = F.array_sort(F.collect_list(F.struct("ts", "pos", event.alias("e"))))
    df = life.groupBy("caseid").agg(ev.alias("ev"))
    return df.select(F.array(_pair(CONCEPT, F.col("caseid"))).alias("string"), F.transform("ev", lambda x: x["e"]).alias("event"))


#: Bytes of XML in one file of a written log, about; a trace is never parted.
XES_FILE_BYTES = 128 << 20
#: Bytes of tags, keys and the timestamp around one event's values.
XES_EVENT_BYTES = 320


def write_xes(life: DataFrame, path: str, mode: str = "error", file_bytes: int = XES_FILE_BYTES) -> None:
    """One folder of XML files. Text is many times larger than the shuffled rows it comes from, so the number of files
    follows the size of the text: a reader takes a file in one task."""
    values = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("task", "transition", "user")), F.lit(XES_EVENT_BYTES))
    size = life.agg(F.sum(values.cast("long"))).first()[0] or 0
    parts = math.ceil(size / file_bytes)
    if parts > 1:
        # grouping keeps this number of partitions; one of its own would be made smaller by the size of the shuffled rows
        life = life.repartition(parts, "caseid")
    xes_traces(life).write.format("xml").option("rootTag", "log").option("rowTag", "trace").mode(mode).save(path)


def write_csv(log: DataFrame, path: str, names: dict[str, str] | None = None, mode: str = "error") -> None:
    """Interval log as CSV with the source column names."""
    back = {v: k for k, v in (names or CSV_NAMES).items()}
    stamps = {c: F.date_format(c, TIME_FORMAT) for c in ("start_ts", "end_ts")}
    log.drop(O.SEG).withColumns(stamps).withColumnsRenamed(back).write.option("header", True).mode(mode).csv(path)


def write_results(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.option("header", True).mode(mode).csv(path)


def write_embedding(vectors: DataFrame, path: str, mode: str = "error") -> None:
    """``(idx, name, vec)`` as header-less lines: index, name, values."""
    line = F.concat_ws(", ", F.col("idx").cast("string"), "name", F.array_join(F.transform("vec", lambda x: x.cast("string")), ", "))
    vectors.select(line.alias("value")).write.mode(mode).text(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def reuse(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table if it is complete, else the built one after storing it."""
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
