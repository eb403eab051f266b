"""Event-log views over the test tables, in Spark and in DuckDB SQL, and the query registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from caseloom.functions.ordered import segment
from caseloom.functions.times import from_us, us
from caseloom.session import prepare

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{d}/{name}.parquet")


def _k() -> "F.Column":
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def _raw2(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").cast("string").alias("caseid"),
        F.col("event_type").alias("task"),
        F.concat(F.lit("r"), (_k() % 12).cast("string")).alias("user"),
        F.col("ts").alias("start_ts"),
        from_us(us("ts") + F.round(F.col("value") * 60).cast("long") * 1000000).alias("end_ts"),
        F.col("event_id").alias("pos"),
        (_k() % 10).alias("k"),
    )


def l1(spark, d):
    """One-timestamp log: case = user."""
    return segment(_raw2(spark, d).withColumn("end_ts", F.col("start_ts")).drop("k"), ["caseid"], "start_ts", derived=False)


def l2(spark, d):
    """Interval log: case = user, end = start + value minutes."""
    return segment(_raw2(spark, d).drop("k"), ["caseid"], "start_ts", derived=False)


def l3(spark, d):
    """Session log: case = user and day of month."""
    df = _raw2(spark, d).drop("k")
    df = df.withColumn("caseid", F.concat("caseid", F.lit("-"), F.day("start_ts").cast("string")))
    return segment(df, ["caseid"], "start_ts", derived=False)


def lifecycle_of(log: DataFrame) -> DataFrame:
    """Lifecycle rows of an interval log, ``pos`` renumbered per case by (ts, start first, record)."""
    from caseloom.functions.ordered import row_index
    from caseloom.operators.shape import to_lifecycle

    df = to_lifecycle(log.drop("seg")).withColumnRenamed("pos", "epos")
    df = df.withColumn("late", (F.col("transition") == "complete").cast("int"))
    df = row_index(segment(df, ["caseid"], "ts"), ["caseid"], ["ts", "late", "epos"], "pos")
    return df.withColumn("pos", F.col("pos").cast("long")).drop("epos", "late")


def l4(spark, d):
    """Lifecycle log of L2."""
    return lifecycle_of(_raw2(spark, d).drop("k"))


def l4s(spark, d):
    """Lifecycle log of the sessions."""
    df = _raw2(spark, d).drop("k")
    return lifecycle_of(df.withColumn("caseid", F.concat("caseid", F.lit("-"), F.day("start_ts").cast("string"))))


def l5(spark, d):
    """Log with many ties: case = order."""
    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax", "l_discount"
    )
    df = li.select(
        F.col("l_orderkey").cast("string").alias("caseid"),
        F.concat("l_returnflag", "l_linestatus").alias("task"),
        F.col("l_suppkey").cast("string").alias("user"),
        F.col("l_shipdate").alias("start_ts"),
        F.col("l_shipdate").alias("end_ts"),
        F.row_number().over(w).cast("long").alias("pos"),
    )
    return df


def l6(spark, d):
    """Sequences with explicit position: case = conversation."""
    c = table(spark, d, "conversations")
    df = c.select(F.col("conv_id").cast("string").alias("caseid"), F.col("role").alias("task"), F.col("turn").alias("pos"))
    return segment(df, ["caseid"], "pos", derived=False)


def l7(spark, d):
    """L2 with 50 task names."""
    df = _raw2(spark, d).withColumn("task", F.concat("task", F.lit("_"), F.col("k").cast("string"))).drop("k")
    return segment(df, ["caseid"], "start_ts", derived=False)


def l8(spark, d):
    """Sessions with the 50 task names."""
    df = _raw2(spark, d).withColumn("task", F.concat("task", F.lit("_"), F.col("k").cast("string"))).drop("k")
    df = df.withColumn("caseid", F.concat("caseid", F.lit("-"), F.day("start_ts").cast("string")))
    return segment(df, ["caseid"], "start_ts", derived=False)


_U = "concat('r', cast(cast(regexp_extract(props,'([0-9]+)',1) as int) % 12 as varchar))"
VIEWS = {
    "l1": f"select cast(user_id as varchar) caseid, event_type task, {_U} \"user\", ts start_ts, ts end_ts, event_id pos from events",
    "l2": f"select cast(user_id as varchar) caseid, event_type task, {_U} \"user\", ts start_ts, ts + to_seconds(cast(round(value*60) as bigint)) end_ts, event_id pos from events",
    "l3": "select concat(caseid,'-',cast(day(start_ts) as varchar)) caseid, task, \"user\", start_ts, end_ts, pos from l2",
    "l4": """select caseid, task, "user", ts, transition, row_number() over (partition by caseid order by ts, transition desc, epos) pos
             from (select caseid, task, "user", start_ts ts, 'start' transition, pos epos from l2
                   union all select caseid, task, "user", end_ts, 'complete', pos from l2) x""",
    "l4s": """select caseid, task, "user", ts, transition, row_number() over (partition by caseid order by ts, transition desc, epos) pos
             from (select caseid, task, "user", start_ts ts, 'start' transition, pos epos from l3
                   union all select caseid, task, "user", end_ts, 'complete', pos from l3) x""",
    "l5": """select cast(l_orderkey as varchar) caseid, concat(l_returnflag,l_linestatus) task, cast(l_suppkey as varchar) "user",
             l_shipdate start_ts, l_shipdate end_ts,
             row_number() over (partition by l_orderkey order by l_shipdate,l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_tax,l_discount) pos
             from lineitem""",
    "l6": "select cast(conv_id as varchar) caseid, role task, turn pos from conversations",
    "l7": """select caseid, concat(task,'_',cast(k as varchar)) task, "user", start_ts, end_ts, pos
             from l2 join (select event_id, cast(regexp_extract(props,'([0-9]+)',1) as int) % 10 k from events) e on event_id = pos""",
    "l8": """select concat(caseid,'-',cast(day(start_ts) as varchar)) caseid, task, "user", start_ts, end_ts, pos from l7""",
}
_NEEDS = {"l8": ["l2", "l7"], "l3": ["l2"], "l4": ["l2"], "l4s": ["l2", "l3"], "l7": ["l2"]}


def sql(views: str, body: str) -> str:
    """DuckDB text: the named views as CTEs, then the body (which may start with its own WITH)."""
    names: list[str] = []
    for v in views.split():
        for n in _NEEDS.get(v, []) + [v]:
            if n not in names:
                names.append(n)
    ctes = [f"{n} as ({VIEWS[n]})" for n in names]
    body = body.strip()
    head = "with "
    low = body.lower()
    if low.startswith("with recursive "):
        head, body = "with recursive ", ", " + body[len("with recursive "):]
    elif low.startswith("with "):
        body = ", " + body[len("with "):]
    if not ctes:
        return head + body[2:] if body.startswith(", ") else body
    return head + ",\n".join(ctes) + "\n" + body
