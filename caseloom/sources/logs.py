"""Event-log sources: CSV, XES, compressed files."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.model import LOG_COLS
from caseloom.session import prepare

# Usual CSV column names, XES attribute keys, and the names the readers drop or keep.
CSV_NAMES = {
    "Case ID": "caseid",
    "Activity": "task",
    "Resource": "user",
    "Start Timestamp": "start_ts",
    "Complete Timestamp": "end_ts",
}
CONCEPT, LIFECYCLE, TIME, ELEMENT = "concept:name", "lifecycle:transition", "time:timestamp", "elementId"
USER_KEYS = ["user", "org:resource"]
CSV_DROPPED = ["Start", "End"]
XES_DROPPED = ["Start", "End", "start", "end"]
TRANSITIONS = ["start", "complete"]
SIMULATOR_SOURCE = "com.qbpsimulator"
ELEMENT_TYPES = ["Task", "Activity"]
EXTENSIONS = [".csv", ".xes", ".csv.gz", ".xes.gz", ".zip"]

_ATTR = "array<struct<_key: string, _value: string>>"
XES_SCHEMA = f"string {_ATTR}, event array<struct<string: {_ATTR}, date: {_ATTR}>>"


def wall_clock(text: Column, fmt: str | None = None) -> Column:
    """Timestamp without zone: an offset in the text is dropped, not applied."""
    if fmt:
        return F.to_timestamp_ntz(text, F.lit(fmt))
    return F.regexp_replace(text, r"(Z|[+-]\d\d:?\d\d)$", "").cast("timestamp_ntz")


def shape_csv(raw: DataFrame, names: dict[str, str], one_ts: bool = False, canonical_only: bool = True, fmt: str | None = None) -> DataFrame:
    """Rename, parse and clean raw text columns of a CSV log."""
    df = raw.withColumnsRenamed(names).filter(~F.col("task").isin(CSV_DROPPED))
    df = df.withColumn("end_ts", wall_clock(F.col("end_ts"), fmt))
    df = df.withColumn("start_ts", F.col("end_ts") if one_ts else wall_clock(F.col("start_ts"), fmt))
    df = df.withColumn("caseid", F.col("caseid").cast("string"))
    df = df.withColumn("pos", F.col("pos").cast("long") if "pos" in df.columns else F.monotonically_increasing_id())
    return df.select(*LOG_COLS) if canonical_only else df


def read_csv(spark: SparkSession, path: str, names: dict[str, str] | None = None, one_ts: bool = False, canonical_only: bool = True, fmt: str | None = None) -> DataFrame:
    """Interval log from CSV (also ``.csv.gz``). Columns are text first; nothing is inferred."""
    raw = prepare(spark).read.option("header", True).csv(path)
    return shape_csv(raw, names or CSV_NAMES, one_ts, canonical_only, fmt)


def simulator_filter(life: DataFrame) -> DataFrame:
    """For logs written by the simulator keep task events (by the prefix of the element id).

    ``life`` has ``source`` and ``element_id``. Logs whose element ids have no prefix stay whole.
    """
    prefix = F.split("element_id", "_")
    typed = F.size(prefix) > 1
    return life.filter((F.col("source") != SIMULATOR_SOURCE) | ~typed | prefix[0].isin(ELEMENT_TYPES))


def xes_sources(spark: SparkSession, path: str) -> DataFrame:
    """``(file, source)``: the ``source`` attribute of each log, from what stands before its first trace."""
    head = spark.read.option("lineSep", "<trace").text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    tag = F.regexp_extract("value", r"<string\s[^>]*key=\"source\"[^>]*>", 0)
    return head.filter(F.col("value").contains("<log")).select("file", F.regexp_extract(tag, r"value=\"([^\"]*)\"", 1).alias("source"))


def read_xes(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Lifecycle log from XES: one task reads many traces, split at the trace tags.

    ``source`` overrides the attribute of the same name that a log has.
    """
    raw = prepare(spark).read.format("xml").option("rowTag", "trace").option("ignoreNamespace", True).schema(XES_SCHEMA).load(path)
    # the last attribute of a name counts
    attr = lambda c, key: F.try_element_at(F.filter(c, lambda e: e["_key"] == key), F.lit(-1))["_value"]
    raw = raw.withColumn("file", F.col("_metadata.file_path"))
    df = raw.select("file", attr("string", CONCEPT).alias("caseid"), F.posexplode("event").alias("pos", "e"))
    s, d = (lambda key, c=c: attr(c, key) for c in ("e.string", "e.date"))
    df = df.select(
        "file",
        "caseid",
        s(CONCEPT).alias("task"),
        F.coalesce(*[s(k) for k in USER_KEYS]).alias("user"),
        wall_clock(F.coalesce(d(TIME), s(TIME))).alias("ts"),
        s(LIFECYCLE).alias("transition"),
        F.col("pos").cast("long").alias("pos"),
        s(ELEMENT).alias("element_id"),
    )
    if source is None:
        df = df.join(xes_sources(spark, path), "file", "left").withColumn("source", F.coalesce("source", F.lit("")))
    else:
        df = df.withColumn("source", F.lit(source))
    df = df.filter(~F.col("task").isin(XES_DROPPED) & F.col("transition").isin(TRANSITIONS))
    df = df.withColumn("element_id", F.coalesce("element_id", F.lit("")))
    return simulator_filter(df).drop("element_id", "source", "file")


def unzip_lines(files: DataFrame, suffix: str = "") -> DataFrame:
    """``(file, n, line)`` of the text members in zip archives given as ``(path, content)``."""

    def lines(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith(suffix):
                            continue
                        with z.open(name) as f:
                            chunk, n = [], 0
                            for raw in io.TextIOWrapper(f, "utf-8"):
                                chunk.append((f"{path}/{name}", n, raw.rstrip("\r\n")))
                                n += 1
                                if len(chunk) == 10_000:
                                    yield pd.DataFrame(chunk, columns=["file", "n", "line"])
                                    chunk = []
                            if chunk:
                                yield pd.DataFrame(chunk, columns=["file", "n", "line"])

    return files.select("path", "content").mapInPandas(lines, "file string, n long, line string")


def csv_of_lines(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Parse the lines of CSV members. The first line of each names its columns; ``columns`` are taken by name,
    and one that a member does not have is null there."""
    width = lines.filter("n = 0").agg(F.max(F.size(F.split("line", ",")))).first()[0] or 1
    fields = ", ".join(f"c{k} string" for k in range(width))
    cells = F.from_csv("line", fields)
    values = F.array(*[cells[f"c{k}"] for k in range(width)])
    heads = lines.filter("n = 0").select("file", F.transform(values, lambda c: F.trim(c)).alias("head"))  # one row per member
    rows = lines.filter("n > 0").select("file", values.alias("cells")).join(heads, "file")
    return rows.select(*[F.get("cells", F.nullif(F.array_position("head", F.lit(c)), F.lit(0)).cast("int") - 1).alias(c) for c in columns])


def read_zip_csv(spark: SparkSession, path: str, columns: list[str] | None = None, names: dict[str, str] | None = None, **options) -> DataFrame:
    """Interval log from CSV files in zip archives (one task per archive)."""
    files = prepare(spark).read.format("binaryFile").load(path)
    names = names or CSV_NAMES
    return shape_csv(csv_of_lines(unzip_lines(files, ".csv"), columns or list(names)), names, **options)


def read_log(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """Pick the reader by extension; others are an error."""
    if path.endswith((".xes", ".xes.gz")):
        return read_xes(spark, path, **options)
    if path.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path, **options)
    if path.endswith(".zip"):
        return read_zip_csv(spark, path, columns, **options)
    raise IOError(f"unknown extension of {path}: expected one of {EXTENSIONS}")
