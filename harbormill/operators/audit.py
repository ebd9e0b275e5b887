"""Data-quality checks: each returns the offending rows, none on sound data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(split: DataFrame) -> DataFrame:
    """(u, i, n_splits): pairs that stand in more than one split."""
    return split.groupBy("u", "i").agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def duplicates(split: DataFrame) -> DataFrame:
    """(split, u, i, n): pairs that a split holds more than once."""
    return split.groupBy("split", "u", "i").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def cold(split: DataFrame, col: str) -> DataFrame:
    """(split, id): users or items of val and test that train doesn't know."""
    train = split.filter("split = 'train'").select(F.col(col).alias("id")).distinct()
    return split.filter("split != 'train'").select("split", F.col(col).alias("id")).distinct().join(train, "id", "left_anti").select("split", "id")


def unmapped(df: DataFrame, col: str, index: DataFrame) -> DataFrame:
    """Ids of ``df`` that an (id, idx) map lacks."""
    return df.select(F.col(col).alias("id")).distinct().join(index, "id", "left_anti")


def index_faults(index: DataFrame) -> DataFrame:
    """(fault, n): ids or numbers that come twice, numbers outside 0..n-1."""
    a = index.agg(
        (F.count(F.lit(1)) - F.count_distinct("id")).alias("double_ids"), (F.count(F.lit(1)) - F.count_distinct("idx")).alias("double_idx"), F.min("idx").alias("lo"), (F.max("idx") + 1 - F.count(F.lit(1))).alias("gap")
    )
    faults = F.array(F.struct(F.lit("double_ids").alias("fault"), F.col("double_ids").alias("n")), F.struct(F.lit("double_idx").alias("fault"), F.col("double_idx").alias("n")), F.struct(F.lit("start").alias("fault"), F.abs("lo").alias("n")), F.struct(F.lit("gap").alias("fault"), F.abs("gap").alias("n")))
    return a.select(F.inline(faults)).filter("n > 0")


def not_one_to_one(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(side, id, n): ids of either side with more than one partner."""
    def many(x: str, y: str, side: str) -> DataFrame:
        return pairs.groupBy(F.col(x).cast("string").alias("id")).agg(F.count_distinct(y).alias("n")).filter("n > 1").select(F.lit(side).alias("side"), "id", "n")

    return many(a, b, a).unionByName(many(b, a, b))


def held_out_seen(split: DataFrame) -> DataFrame:
    """Held-out pairs that the user has in train."""
    train = split.filter("split = 'train'").select("u", "i")
    return split.filter("split != 'train'").join(train, ["u", "i"], "left_semi")


def out_of_range(df: DataFrame, cols: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rows with a value that is null, NaN or outside the bounds."""
    bad = reduce(lambda x, y: x | y, [F.coalesce(F.isnan(F.col(c).cast("double")) | ~F.col(c).between(low, high), F.lit(True)) for c in cols])
    return df.filter(bad)


def missing_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations of the keys' values that no run has."""
    grid = reduce(lambda a, b: a.crossJoin(b), [runs.select(k).distinct() for k in keys])
    return grid.join(runs.select(*keys).distinct(), keys, "left_anti")


def double_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def not_nested(masks: DataFrame) -> DataFrame:
    """Kept (item, slot) rows of a stronger removal that the weaker one before it lacks; masks have seed, level, item, slot."""
    levels = masks.select("level").distinct()
    steps = levels.alias("x").join(levels.alias("y"), F.col("x.level") < F.col("y.level")).groupBy(F.col("y.level").alias("level")).agg(F.max("x.level").alias("weaker"))
    strong = masks.join(F.broadcast(steps), "level")
    weak = masks.select("seed", F.col("level").alias("weaker"), "item", "slot")
    return strong.join(weak, ["seed", "weaker", "item", "slot"], "left_anti")
