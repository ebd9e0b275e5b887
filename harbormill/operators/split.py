"""Per-user random splits and dense indexes.

Random order is the order of ``md5(seed|user|item)``: it needs no generator state, is the
same on every cluster and in every engine, and costs one sort per user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harbormill.session import written


def order_key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def user_split(pairs: DataFrame, seed: int = 42, dense: int = 2, share: float = 0.1) -> DataFrame:
    """``pairs`` with ``split``: per user a share each for val and test, the rest train.

    A user with fewer than ``dense`` pairs is train only; one with exactly two gives one to val; from three on val
    and test get max(1, floor(share n)) each.
    """
    per = W.partitionBy("u")
    rn = F.row_number().over(per.orderBy(order_key(str(seed), F.col("u"), F.col("i")), "i"))
    n = F.count(F.lit(1)).over(per)
    held = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share))).cast("int")
    split = (
        F.when((F.col("n") < dense) | (F.col("n") < 2), "train")
        .when(F.col("n") == 2, F.when(F.col("rn") == 1, "val").otherwise("train"))
        .when(F.col("rn") <= held, "test")
        .when(F.col("rn") <= 2 * held, "val")
        .otherwise("train")
    )
    return pairs.withColumn("rn", rn).withColumn("n", n).withColumn("split", split).drop("rn", "n")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: its rows numbered from 0 in a global order.

    Range partitions are sorted in parallel and each is numbered from the count of those before it, so no
    single task sorts all rows.  The ranges are written once, so that numbers can't move on recomputation.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = written(spread, "ranges").withColumn("__pid", F.shiftright("__at", 33)).withColumn("__local", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition
    before = W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(offsets), "__pid").withColumn(out, (F.col("__before") + F.col("__local")).cast("long")).drop("__pid", "__local", "__before", "__at")


def dense_index(df: DataFrame, col: str) -> DataFrame:
    """(id, idx): distinct values in order, numbered from 0; nulls are left out."""
    ids = df.select(F.col(col).alias("id")).filter("id is not null").distinct()
    return numbered(ids, [F.col("id")], "idx").select("id", "idx")


def histories(pairs: DataFrame) -> DataFrame:
    """(u, items): sorted distinct items per user; a list is bounded by the catalogue."""
    return pairs.groupBy("u").agg(F.array_sort(F.collect_set("i")).alias("items"))


def summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("u").alias("n_users"), F.count_distinct("i").alias("n_items"))
