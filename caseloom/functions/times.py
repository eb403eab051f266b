"""Time expressions. Timestamps are TIMESTAMP_NTZ; arithmetic is in whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def us(c: C) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def from_us(c: C) -> Column:
    return F.timestamp_micros(F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def floor_to(unit: str, c: C) -> Column:
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def span_us(a: C, b: C) -> Column:
    """b - a in microseconds."""
    return us(b) - us(a)


def sec_of_day(c: C) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def monday0(c: C) -> Column:
    return F.weekday(c)


def day_moment(c: C) -> Column:
    """[0,12) morning, [12,17) afternoon, [17,24) night."""
    h = F.hour(c)
    return F.when(h < 12, "morning").when(h < 17, "afternoon").otherwise("night")
