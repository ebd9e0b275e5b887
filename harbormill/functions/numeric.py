"""Numbers: null-safe ratings, scaling, clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges up to this width count as constant.
FLAT = 1e-12


def no_nan(c: Column) -> Column:
    """NaN as null, so that comparisons and maxima behave."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def finite(c: Column, nan: float = 0.0, posinf: float = 1.0, neginf: float = 0.0) -> Column:
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d), nan).when(d == float("inf"), posinf).when(d == float("-inf"), neginf).otherwise(d)


def keep_count(n: Column, removed: float | Column) -> Column:
    """How many of n stay when a share is removed: rounded half to even, at least one."""
    f = removed if isinstance(removed, Column) else F.lit(removed)
    return F.greatest(F.lit(1), F.least(n, F.bround(n * (1 - f.cast("double"))).cast("int")))


def min_max(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``col`` scaled to [0, 1], constant columns 0.  The bounds are one broadcast row."""
    bounds = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    width = F.col("__hi") - F.col("__lo")
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, F.when(width > FLAT, (F.col(col) - F.col("__lo")) / width).otherwise(0.0)).drop("__lo", "__hi")


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))
