"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options (UTC wall clock, adaptive execution) on an existing session.

    The package's functions travel to the executors by value, so nothing has to be installed there.
    """
    cloudpickle.register_pickle_by_value(sys.modules["caseloom"])
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own, else a temporary one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="caseloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return path


#: What was written within the calls of ``passing`` that are under way, innermost last.
_written: list[list[str]] = []


def noted(path: str) -> str:
    """``path``, which is deleted at the end of the ``passing`` that it is written in."""
    if _written:
        _written[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of a small or iterated frame: written to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if _written:
        noted(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return out


def store(df: DataFrame) -> DataFrame:
    """End the lineage of a large frame that is read several times: a table beside the checkpoints.

    The next steps can prune its columns, and its size is known to the optimizer.
    """
    spark = df.sparkSession
    path = noted(f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def passing(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()``, stored. What was stored or cut to make it is deleted then, and shuffles go with the actions that made them."""
    _written.append([])
    try:
        with alone(spark):
            out = store(make())
        path = _written[-1].pop()  # the last that was written
    finally:
        delete(spark, *_written.pop())
    noted(path)
    return out


@contextmanager
def alone(spark: SparkSession):
    """Shuffles of the actions within are removed when these end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def delete(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more; other files of their folders go with them."""
    for df in tables:
        delete(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})
