"""Reading of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of an unknown user in the source data.
INVALID_USERS = ("", "/undefined", "undefined", "nan", "none", "null")


def clean_id(c: Column) -> Column:
    """Trimmed text; ``123.0`` reads as ``123``; null and empty stay null."""
    t = F.trim(c.cast("string"))
    return F.regexp_replace(F.when(t != "", t), r"^([0-9]+)\.0+$", "$1")


def is_invalid_user(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*INVALID_USERS), F.lit(True))


def strip_float_suffix(c: Column) -> Column:
    """Everything before the first point."""
    return F.split_part(F.trim(c.cast("string")), F.lit("."), F.lit(1))
