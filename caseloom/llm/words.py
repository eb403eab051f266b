"""Words of a text as Spark expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.llm.common import ascii_lower

#: What separates words: ASCII other than digits and letters (letters are lower-cased before).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def letter_words(text: Column) -> Column:
    """Array of words of a lower-cased text; a null text has none."""
    plain = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " ")
    return F.array_remove(F.split(plain, " "), "")
