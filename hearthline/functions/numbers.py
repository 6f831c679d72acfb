from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_cents(value: Column) -> Column:
    """Two decimals, halves towards plus infinity (``round`` would go away from zero)."""
    return F.floor(value * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


# How a number may be spelled in text; other spellings that a cast would take are none.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?\s*\z"
_SPECIAL = ["NaN", "INF", "Infinity", "-INF", "-Infinity"]


def parse_double(text: Column) -> Column:
    """Double from text, null when it is not one (also under ANSI mode)."""
    return F.when(text.rlike(_NUMBER) | F.trim(text).isin(_SPECIAL), text.try_cast("double"))
