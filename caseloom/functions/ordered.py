"""Ordered calculations (previous row, running sum, row number) that survive hot groups.

A plain window sends a whole group to one task. ``segment`` first checks the group sizes: groups over
the limit are cut into time segments and get a ``seg`` number from 1 on (all others keep 0); if nothing
is over the limit, no column is added. Every function here then works on (group, segment) and carries
the state from segment to segment through a summary with one row per segment of a hot group. There are
at most MAX_SEGMENTS * 2 such rows, so that table is broadcast.

With ``keys=[]`` the group is the whole table, so a global order never runs in one task either, unless
the table was found to be under the limit.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import store

SEG = "seg"
MAX_SEGMENTS = 256
DEFAULT_LIMIT = 4_000_000


def segment_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.caseloom.segment.rows", str(DEFAULT_LIMIT)))


def surely_small(df: DataFrame, limit: int) -> bool:
    """True if all inputs of the plan together are a few megabytes: then no job has to count the rows.

    Only a shortcut: a wrong answer costs time, not correctness.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())) <= 8 * limit


def sized(df: DataFrame) -> DataFrame:
    """A join side with a known size: stored first unless its inputs are small.

    Spark then broadcasts it if it is under the session's broadcast threshold, without shuffling the other
    side by what may be a few hot keys; above the threshold it is a sort-merge join with skew handling.
    """
    return df if surely_small(df, segment_limit(df)) else store(df)


def null_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equality join that also matches null keys; the key columns of ``left`` stay."""
    right = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(right, cond, how).drop(*[f"_k_{k}" for k in keys])


def _order_value(df: DataFrame, name: str) -> Column:
    """The order column in a form that literals can be compared with."""
    kind = dict(df.dtypes)[name]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if kind == "date":
        return F.unix_date(F.col(name)).cast("long")
    if kind.startswith("decimal") or kind == "float":
        return F.col(name).cast("double")
    return F.col(name)


#: Values of a hot group that its cut points are taken from, about, where quantiles are not defined (strings).
CUT_SAMPLE = 4000


def _cut_points(slim: DataFrame, keys: list[str], size: str, steps: list[float]) -> DataFrame:
    """Per group of ``slim(keys, _o, size)`` the values that part it in about equal pieces."""
    if dict(slim.dtypes)["_o"] != "string":
        return slim.groupBy(*keys).agg(F.percentile_approx("_o", steps, 10000).alias("_c"))
    every = F.greatest(F.lit(1), F.floor(F.col(size) / CUT_SAMPLE))
    some = slim.filter(F.pmod(F.xxhash64("_o", "_r"), every) == 0)
    held = some.groupBy(*keys).agg(F.array_sort(F.collect_list("_o")).alias("_s"))  # about CUT_SAMPLE values each
    return held.select(*keys, F.array(*[F.get("_s", F.floor(F.size("_s") * q).cast("int")) for q in steps]).alias("_c"))


def segment(df: DataFrame, keys: list[str], order: str, limit: int | None = None, derived: bool = True) -> DataFrame:
    """Add ``seg`` if some group of ``keys`` has more rows than the limit; else return ``df`` as it is.

    Sizes and cut points take up to three passes. A ``derived`` frame (joins, aggregates, windows) is
    therefore written to the checkpoint folder first unless its inputs are small; a plain scan is not.
    Rows with equal order values stay together.
    """
    if SEG in df.columns:
        df = df.drop(SEG)
    limit = segment_limit(df) if limit is None else limit
    if surely_small(df, limit):
        return df
    if derived:
        df = store(df)
    total = df.count()
    if total <= limit:
        return df
    limit = max(limit, math.ceil(total / MAX_SEGMENTS))
    o = _order_value(df, order)
    slim = df.select(*keys, o.alias("_o"), F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]).alias("_r"))
    sizes = slim.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    hot = sizes.collect()  # at most total/limit <= MAX_SEGMENTS rows
    if not hot:
        return df
    most = max(math.ceil(r["_n"] / limit) for r in hot)
    if most < 2:
        return df
    steps = [i / most for i in range(1, most)]
    spark = df.sparkSession
    if not keys:
        rows = _cut_points(slim.withColumn("_n", F.lit(total)), [], "_n", steps).collect()
        cuts = sorted({c for c in rows[0]["_c"] if c is not None})
        return _marked(df, _rank_in(F.array(*[F.lit(c) for c in cuts]), o) + 1, order) if cuts else df
    names = spark.createDataFrame([tuple(r[k] for k in keys) + (r["_n"],) for r in hot], sizes.schema)
    points = _cut_points(null_join(slim, F.broadcast(names), keys, "inner"), keys, "_n", steps)
    rows = points.collect()
    table = spark.createDataFrame([tuple(r[k] for k in keys) + (sorted({c for c in r["_c"] if c is not None}),) for r in rows], points.schema)
    out = null_join(df, F.broadcast(table), keys)
    return _marked(out, F.when(F.col("_c").isNull(), 0).otherwise(_rank_in(F.col("_c"), o) + 1), order).drop("_c")


def _marked(df: DataFrame, number: Column, order: str) -> DataFrame:
    """``seg`` remembers the column that its borders belong to."""
    return df.withColumn(SEG, number.alias(SEG, metadata={"order": order}))


def _rank_in(cuts: Column, o: Column) -> Column:
    return F.coalesce(F.size(F.filter(cuts, lambda c: c < o)), F.lit(0))


def aligned(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with segments that follow its first order column; cut anew if they follow another."""
    if SEG not in df.columns or df.schema[SEG].metadata.get("order") == order[0]:
        return df
    return segment(df, keys, order[0])


def parts(df: DataFrame, keys: list[str]) -> list[str]:
    """The columns that bound one task's ordered work."""
    return keys + [SEG] if SEG in df.columns else list(keys)


def _window(df: DataFrame, keys: list[str], order: list, forward: bool = True):
    cols = parts(df, keys) or [F.lit(0)]
    by = [F.col(o).asc() if forward else F.col(o).desc() for o in order]
    return Window.partitionBy(*cols).orderBy(*by)


def scan(df: DataFrame, keys: list[str], order: list[str], outs: dict[str, tuple]) -> DataFrame:
    """Running values. ``outs`` maps a new column to (kind, column, reach).

    kind: "sum", "max", "last" (nearest non-null value); reach: "upto" (with this row), "before", "after".
    """
    df = aligned(df, keys, order)
    new, carry = {}, {}
    for name, (kind, col, reach) in outs.items():
        forward = reach != "after"
        frame = _window(df, keys, order, forward).rowsBetween(
            Window.unboundedPreceding, 0 if reach == "upto" else -1
        )
        agg = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[kind]
        inner = agg(col).over(frame)
        new[name] = F.coalesce(inner, F.lit(0)) if kind == "sum" else inner
        if kind == "last":
            tagged = F.when(col.isNotNull(), F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], col.alias("_v")))
            carry[name] = ((F.max if forward else F.min)(tagged))["_v"]
        else:
            carry[name] = agg(col)
    out = df.withColumns(new)
    if SEG not in df.columns:
        return out
    keyed = list(keys)
    summary = (
        df.filter(F.col(SEG) > 0).groupBy(*keyed, SEG).agg(*[c.alias("_c_" + n) for n, c in carry.items()])
    )
    cols = keyed or [F.lit(0)]
    moved = {}
    for name, (kind, _, reach) in outs.items():
        w = Window.partitionBy(*cols).orderBy(F.col(SEG).asc() if reach != "after" else F.col(SEG).desc())
        agg = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[kind]
        moved["_c_" + name] = agg(F.col("_c_" + name)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    carried = summary.select(*keyed, SEG, *[c.alias(n) for n, c in moved.items()])
    out = null_join(out, F.broadcast(carried), keyed + [SEG])
    final = {}
    for name, (kind, _, _) in outs.items():
        c = F.col("_c_" + name)
        if kind == "sum":
            final[name] = F.col(name) + F.coalesce(c, F.lit(0))
        elif kind == "max":
            final[name] = F.greatest(F.col(name), c)
        else:
            final[name] = F.coalesce(F.col(name), c)
    return out.withColumns(final).drop(*moved)


def neighbours(df: DataFrame, keys: list[str], order: list[str], prev: dict | None = None, next: dict | None = None) -> DataFrame:
    """Values of the row before (``prev``) and after (``next``): new column -> column or expression."""
    df = aligned(df, keys, order)
    prev = {n: F.col(c) if isinstance(c, str) else c for n, c in (prev or {}).items()}
    next = {n: F.col(c) if isinstance(c, str) else c for n, c in (next or {}).items()}
    if SEG not in df.columns:
        w = _window(df, keys, order)
        return df.withColumns(
            {n: F.lag(c).over(w) for n, c in prev.items()} | {n: F.lead(c).over(w) for n, c in next.items()}
        )
    outs = {"_p_" + n: ("last", F.struct(c.alias("v")), "before") for n, c in prev.items()}
    outs |= {"_p_" + n: ("last", F.struct(c.alias("v")), "after") for n, c in next.items()}
    out = scan(df, keys, order, outs)
    return out.withColumns({n: F.col("_p_" + n)["v"] for n in (prev | next)}).drop(*outs)


def lags(df: DataFrame, keys: list[str], order: list[str], cols: list[str], n: int) -> DataFrame:
    """The values of the 1..n rows before, as columns ``<col>__<k>``."""
    df = aligned(df, keys, order)
    if SEG not in df.columns:
        w = _window(df, keys, order)
        return df.withColumns({f"{c}__{k}": F.lag(c, k).over(w) for c in cols for k in range(1, n + 1)})
    for k in range(1, n + 1):
        df = neighbours(df, keys, order, prev={f"{c}__{k}": c if k == 1 else f"{c}__{k - 1}" for c in cols})
    return df


def row_index(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """1-based row number inside the group."""
    df = aligned(df, keys, order)
    if SEG not in df.columns:
        return df.withColumn(out, F.row_number().over(_window(df, keys, order)))
    return scan(df, keys, order, {out: ("sum", F.lit(1), "upto")}).withColumn(out, F.col(out).cast("int"))


def global_index(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """1-based number of each row in the order of the whole table; ties are the caller's to break."""
    return row_index(segment(df, [], order[0]), [], order, out).drop(SEG)


def totals(df: DataFrame, keys: list[str], aggs: dict[str, Column], local: bool = False) -> DataFrame:
    """Attach group aggregates to every row.

    Aggregates before the shuffle and joins back, so a group may be any size; ``local=True`` says the
    group is already one task's work (a case that is not hot) and a window saves the join.
    """
    if local and SEG not in df.columns:
        w = Window.partitionBy(*keys)
        return df.withColumns({n: c.over(w) for n, c in aggs.items()})
    agg = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return null_join(df, sized(agg), keys)


def _field(name: str):
    return lambda s: s[name]


def gather(df: DataFrame, keys: list[str], order: list[str], fields: dict[str, str]) -> DataFrame:
    """One row per group with arrays in order: the array is the group's value, so it is never parted."""
    packed = F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).alias("_f_" + n) for n, c in fields.items()])))
    out = df.groupBy(*keys).agg(packed.alias("_a"))
    return out.select(*keys, *[F.transform("_a", _field("_f_" + n)).alias(n) for n in fields])
