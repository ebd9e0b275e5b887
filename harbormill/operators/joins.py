"""Joins that check their keys, and joins by dense index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _guarded(df: DataFrame, on: list[str], side: str) -> DataFrame:
    """``df``, failing at run time on a key that comes twice."""
    n = F.count(F.lit(1)).over(W.partitionBy(*on))
    ok = F.when(n > 1, F.raise_error(F.concat(F.lit(f"key is not unique on the {side} side: "), F.concat_ws(",", *on)))).otherwise(F.lit(True))
    return df.withColumn("__ok", ok).filter("__ok is null or __ok").drop("__ok")


def checked_left_join(left: DataFrame, right: DataFrame, on: list[str], kind: str) -> DataFrame:
    """A left join that fails if the keys are not as ``kind`` says: one_to_one or many_to_one."""
    if kind not in ("one_to_one", "many_to_one"):
        raise ValueError(kind)
    return (_guarded(left, on, "left") if kind == "one_to_one" else left).join(_guarded(right, on, "right"), on, "left")


def double_keys(df: DataFrame, on: list[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def gather(df: DataFrame, index: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """``df`` with ``idx`` of its key in an (id, idx) map; an unknown key fails (``strict``) or is dropped."""
    if not strict:
        return df.join(index.withColumnRenamed("id", key), key)
    idx = F.when(F.col("idx").isNull(), F.raise_error(F.concat(F.lit("no index for "), F.col(key).cast("string")))).otherwise(F.col("idx"))
    return df.join(index.withColumnRenamed("id", key), key, "left").withColumn("idx", idx.cast("long"))


def keep_last(df: DataFrame, on: list[str], order: str) -> DataFrame:
    """One row per key, the last in ``order``; an aggregation, so no key's rows are ever sorted together."""
    rest = [c for c in df.columns if c not in on]
    return df.groupBy(*on).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*on, "__r.*")


def replaced(df: DataFrame, col: str, mapping: dict[str, str]) -> DataFrame:
    return df.replace(mapping, subset=[col])


def in_order(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """``df`` with ``position`` of its value in a fixed display order, unknown values last."""
    cases = F.lit(len(order))
    for k, v in reversed(list(enumerate(order))):
        cases = F.when(F.col(col) == v, k).otherwise(cases)
    return df.withColumn("position", cases).orderBy("position", col)
