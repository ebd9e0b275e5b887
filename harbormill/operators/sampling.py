"""Deterministic sampling: negatives, permutations, subsets, nested masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harbormill.functions.numeric import keep_count
from harbormill.operators.split import numbered, order_key
from harbormill.session import written


def negatives(positives: DataFrame, seen: DataFrame, catalogue: DataFrame, per: int, salt: str, attempts: int = 8) -> DataFrame:
    """(u, i, k, negative): ``per`` uniform draws from the catalogue for every positive, with replacement, none of them seen.

    ``catalogue`` has (id, idx).  Each draw has ``attempts`` candidates from md5 of salt, pair, draw and attempt; the
    first unseen one counts.  A draw whose candidates are all seen takes a hashed rank among the user's unseen items
    instead, so only users who have seen the whole catalogue get none, and sampling always ends.
    """
    size = catalogue.agg(F.count(F.lit(1)).alias("size"))
    draws = positives.select("u", "i").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(per)))).withColumn("a", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
    text = order_key(salt, F.col("u"), F.col("i"), F.col("k").cast("string"), F.col("a").cast("string"))
    draws = draws.crossJoin(F.broadcast(size)).withColumn("idx", F.pmod(F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), F.col("size")))
    named = draws.join(catalogue.select(F.col("id").alias("negative"), "idx"), "idx")
    known = seen.select("u", F.col("i").alias("negative")).distinct()
    marked = named.join(known.withColumn("known", F.lit(True)), ["u", "negative"], "left")
    fresh = F.col("known").isNull()
    first = marked.groupBy("u", "i", "k").agg(F.min_by(F.when(fresh, F.col("negative")), F.when(fresh, F.col("a"))).alias("negative"))
    first = written(first, "draws")
    missed = first.filter("negative is null").select("u", "i", "k")
    return first.filter("negative is not null").unionByName(_ranked_unseen(missed, known, catalogue, size, salt))


def _ranked_unseen(draws: DataFrame, known: DataFrame, catalogue: DataFrame, size: DataFrame, salt: str) -> DataFrame:
    """(u, i, k, negative): the r-th item that the user has not seen, r from md5 of salt, pair and draw.

    With the seen indices s_0 < s_1 < ... of a user, it has the index r + |{j: s_j - j <= r}|: a running count over
    the user's draws and seen items in one order, so neither meets the other as pairs.
    """
    users = draws.select("u").distinct()
    seen = known.join(users, "u", "left_semi").join(catalogue.select(F.col("id").alias("negative"), "idx"), "negative")
    seen = seen.select("u", (F.col("idx") - F.row_number().over(W.partitionBy("u").orderBy("idx")) + 1).alias("at"))
    n_seen = seen.groupBy("u").agg(F.count(F.lit(1)).alias("n_seen"))
    text = order_key(salt, F.col("u"), F.col("i"), F.col("k").cast("string"), F.lit("rank"))
    rank = F.pmod(F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), F.col("size") - F.col("n_seen"))
    ranked = draws.join(n_seen, "u").crossJoin(F.broadcast(size)).filter("n_seen < size").select("u", "i", "k", rank.alias("at"))
    rows = seen.select("u", F.lit(None).cast(draws.schema["i"].dataType).alias("i"), F.lit(None).cast("int").alias("k"), "at", F.lit(1).alias("before"))
    rows = rows.unionByName(ranked.withColumn("before", F.lit(0)))
    shift = F.sum("before").over(W.partitionBy("u").orderBy("at", F.desc("before")).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = rows.withColumn("idx", F.col("at") + shift).filter("before = 0")
    return placed.join(catalogue.select(F.col("id").alias("negative"), "idx"), "idx").select("u", "i", "k", "negative")


def permuted(df: DataFrame, key: str, value: str, salt: str) -> DataFrame:
    """(key, value): the values dealt anew among the keys, by rank of a hash; the multiset stays."""
    base = df.select(F.col(key).alias("key"), F.col(value).alias("value"))
    give = numbered(base, [order_key(salt, F.col("key").cast("string")), F.col("key")], "r").select("r", "value")
    take = numbered(base, [F.col("key")], "r").select("r", "key")
    return take.join(give, "r").select(F.col("key").alias(key), F.col("value").alias(value))


def subset(df: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """``n`` keys in hash order."""
    return df.select(key).distinct().orderBy(order_key(salt, F.col(key).cast("string")), key).limit(n)


def nested_masks(images: DataFrame, seeds: list[int], removed: list[float]) -> DataFrame:
    """(seed, level, item, slot): images that stay when a share is removed; of one seed stronger removals keep a part of what weaker ones keep."""
    spark = images.sparkSession
    grid = spark.createDataFrame([(s, float(f)) for s in seeds for f in removed], "seed int, level double")
    rows = images.select("item", "slot", F.count(F.lit(1)).over(W.partitionBy("item")).alias("n"))
    each = rows.crossJoin(F.broadcast(grid.select("seed").distinct()))
    rn = F.row_number().over(W.partitionBy("seed", "item").orderBy(order_key(F.col("seed").cast("string"), F.col("item"), F.col("slot").cast("string")), "slot"))
    ranked = each.withColumn("rn", rn)
    return ranked.join(F.broadcast(grid), "seed").filter(F.col("rn") <= keep_count(F.col("n"), F.col("level"))).select("seed", "level", "item", "slot")

