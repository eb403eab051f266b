"""Session settings and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.session import alone, checkpoint_dir, discard, prepare, store

#: Rows of one Arrow batch; texts can be long, so fewer than Spark's default.
BATCH_ROWS = 2000


def ready(spark: SparkSession) -> SparkSession:
    """The session with the settings the operators rely on."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store_alone(df: DataFrame) -> DataFrame:
    """``store``, for a frame that nothing else is read from: the shuffles it took are removed at once, not when the driver collects garbage."""
    with alone(df.sparkSession):
        return store(df)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, per_bucket: int = 20_000) -> DataFrame:
    """Gapless numbers from 0 within ``keys``, ordered by the small integer columns ``order``, then by hash.

    The first of ``order`` may be any small set of classes. Rows are dealt to buckets by a hash of all columns,
    bucket sizes are counted, and each row's number is the size of what lies before plus its place in the bucket,
    so no task holds a whole key. Equal rows are interchangeable; where they crowd a bucket, all rows are dealt by hash and place of reading, from
    a table that fixes the deal.
    """
    total = df.count()
    n = max(1, -(-total // per_bucket))
    h = F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])
    bucket = F.pmod(F.shiftright("_h", 20), F.lit(n))
    df = df.withColumn("_h", h)
    if n > 1 and df.groupBy(bucket.alias("_b")).count().agg(F.max("count")).first()[0] > 2 * per_bucket:
        df = store(df.withColumn("_h", F.xxhash64("_h", F.monotonically_increasing_id())))
    df = df.withColumn("_b", bucket)
    cells = [*keys, *order, "_b"]
    sizes = df.groupBy(*cells).count()
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order, "_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(c).alias("_" + c) for c in cells], F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*cells).orderBy("_h")) - 1
    df = df.withColumn("_place", place)
    on = [F.col(c).eqNullSafe(F.col("_" + c)) for c in cells]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return (
        df.join(before, cond)
        .withColumn(out, (F.col("_place") + F.col("_before")).cast("long"))
        .drop("_h", "_b", "_place", "_before", *["_" + c for c in cells])
    )


__all__ = ["ready", "table", "parts", "scratch", "store", "store_alone", "alone", "discard", "checkpoint_dir", "ascii_lower", "fresh", "numbered"]
