"""Side-table sources: embedding matrices, alignment results, run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.session import prepare

# Layout of the alignment result files.
MOVE_PATTERN = r"^\s*(\w+)\((.*)\)"
IGNORED_MOVE = "MINVI"
CASE_FIELD, TYPE_FIELD, FITNESS_FIELD = 2, 1, 11


def read_embedding(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, name, vec)`` from header-less lines; names are trimmed."""
    parts = F.split("value", ",")
    df = prepare(spark).read.text(path)
    return df.select(
        F.trim(parts[0]).cast("int").alias("idx"),
        F.trim(parts[1]).alias("name"),
        F.transform(F.slice(parts, F.lit(3), F.size(parts) - 2), lambda x: F.trim(x).cast("double")).alias("vec"),
    )


def embedding_mismatch(vectors: DataFrame, tasks: DataFrame) -> DataFrame:
    """Names on one side only: ``(name, side)``; empty for a matrix that fits the log."""
    a, b = vectors.select("name").distinct(), tasks.select(F.col("task").alias("name")).distinct()
    return a.join(b, "name", "left_anti").withColumn("side", F.lit("embedding")).unionByName(
        b.join(a, "name", "left_anti").withColumn("side", F.lit("log"))
    )


def checked_embedding(vectors: DataFrame, tasks: DataFrame) -> DataFrame:
    if embedding_mismatch(vectors, tasks).limit(1).count():
        raise ValueError("the embedding's names are not the log's activities")
    return vectors


def parse_moves(lines: DataFrame) -> DataFrame:
    """``(trace_type, m, move, task)`` from lines ``type, x, MOVE(task), ...`` without header lines."""
    cells = F.split("value", ",")
    df = lines.select(F.trim(cells[0]).cast("string").alias("trace_type"), F.posexplode(F.slice(cells, F.lit(3), F.size(cells) - 2)).alias("m", "cell"))
    df = df.select("trace_type", "m", F.regexp_extract("cell", MOVE_PATTERN, 1).alias("move"), F.trim(F.regexp_extract("cell", MOVE_PATTERN, 2)).alias("task"))
    return df.filter(F.col("move") != IGNORED_MOVE)


def parse_trace_types(lines: DataFrame) -> DataFrame:
    """``(caseid, trace_type, fitness)`` from the second alignment file, without header lines."""
    c = F.split("value", ",")
    return lines.select(F.trim(c[CASE_FIELD]).alias("caseid"), F.trim(c[TYPE_FIELD]).alias("trace_type"), F.trim(c[FITNESS_FIELD]).cast("double").alias("fitness"))


def read_data_lines(spark: SparkSession, path: str, marker: str = r"^\s*\d+\s*,") -> DataFrame:
    """Text lines that begin with a number and a comma; the header lines of a file do not."""
    return prepare(spark).read.text(path).filter(F.col("value").rlike(marker))


def collect_results(spark: SparkSession, glob: str) -> DataFrame:
    """All run-result CSV files together, without rows for zero clusters."""
    df = prepare(spark).read.option("header", True).csv(glob)
    return df.filter(F.col("number_clusters").cast("int") != 0)
