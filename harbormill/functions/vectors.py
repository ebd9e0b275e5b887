"""Vectors as array columns; higher-order functions keep them in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest norm that is divided by.
EPS = 1e-12


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Divided by its length; a zero vector stays zero.

    The length is bound to a lambda variable, so it is computed once and not once per element.
    """
    both = F.array(F.struct(v.alias("v"), F.greatest(norm(v), F.lit(EPS)).alias("l")))
    return F.transform(both, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["l"]))[0]


def usable(v: Column, dim: int) -> Column:
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))) & F.exists(v, lambda x: x != 0), F.lit(False))
