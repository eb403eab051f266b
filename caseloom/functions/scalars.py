"""Scalar helpers over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_name(c: Column) -> Column:
    """Name as a column name: trimmed, lower case, blanks as underscores."""
    return F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))


def captured(c: Column, pattern: str, group: int) -> Column:
    """Regex group, null where the pattern does not match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def prefixed(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def parse_time(c: Column, fmt: str) -> Column:
    return F.to_timestamp_ntz(c, F.lit(fmt))


def rounded(c: Column, digits: int) -> Column:
    """Rounded to ``digits`` and then to two decimals."""
    return F.round(F.round(c, digits), 2)


def nan_to_zero(c: Column) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def zero_to_null(c: Column) -> Column:
    return F.when(c != 0, c)


def flat_distinct(c: Column) -> Column:
    return F.array_distinct(F.flatten(c))


def padded(c: Column, size: int, fill) -> Column:
    """Array with ``fill`` on the left up to ``size`` values, or its last ``size`` values."""
    missing = F.greatest(F.lit(size) - F.size(c), F.lit(0))
    return F.slice(F.concat(F.array_repeat(F.lit(fill), missing), c), -size, size)


def symmetric_offsets(width: float, n: Column) -> Column:
    """n positions with distance ``width``, centred on 0."""
    return F.transform(F.sequence(F.lit(1), n), lambda i: width * i - width * (n + 1) / 2)


def is_superset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def same_set(a: Column, b: Column) -> Column:
    return is_superset(a, b) & is_superset(b, a)


def inverted(m: Column) -> Column:
    """Map with keys and values exchanged."""
    return F.map_from_arrays(F.map_values(m), F.map_keys(m))
