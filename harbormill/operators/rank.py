"""Full-catalogue ranking and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harbormill.operators.split import numbered


def popularity(pairs: DataFrame) -> DataFrame:
    """(i, n, rank) by train rows, ties to the smaller id."""
    counts = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, [F.desc("n"), F.col("i")], "rank").select("i", "n", (F.col("rank") + 1).alias("rank"))


def popular_unseen(train: DataFrame, users: DataFrame, k: int = 20) -> DataFrame:
    """(u, i, rank) of each user's k most popular items that they have not seen.

    A user's k unseen items lie among the first k + |seen| of the catalogue, so each user meets only those and never
    the whole catalogue.  Seen counts are grouped, so that users with as many seen items share one range.
    """
    ranked = popularity(train)
    seen = train.select("u", "i").distinct()
    reach = users.select("u").distinct().join(seen.groupBy("u").agg(F.count(F.lit(1)).alias("s")), "u", "left").select("u", (F.coalesce("s", F.lit(0)) + k).alias("reach"))
    reach = reach.withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("reach").cast("int"))))
    candidates = reach.join(ranked.select(F.col("rank").alias("pos"), "i"), "pos").join(seen, ["u", "i"], "left_anti")
    return top_k(candidates.select("u", "i", (-F.col("pos")).alias("score")), k)


def top_k(scores: DataFrame, k: int = 20, digits: int | None = None) -> DataFrame:
    """(u, i, rank): best scores per user, ties to the smaller item."""
    s = F.round("score", digits) if digits is not None else F.col("score")
    rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc(s), "i"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k).select("u", "i", "rank")


def drop_seen(scores: DataFrame, seen: DataFrame) -> DataFrame:
    return scores.join(seen.select("u", "i").distinct(), ["u", "i"], "left_anti")


def user_metrics(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(u, n_relevant, hr10, hr20, ndcg10, ndcg20, mrr20) of every user with relevant items, hits or none."""
    rel = relevant.select("u", "i").distinct()
    sizes = rel.groupBy("u").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = ranked.filter("rank <= 20").join(rel, ["u", "i"])
    gain = 1 / F.log2(F.col("rank") + 1)
    h = hits.groupBy("u").agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 10, gain).otherwise(0.0)).alias("d10"), F.sum(gain).alias("d20"))
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant").cast("int"), F.lit(k))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    j = sizes.join(h, "u", "left")
    return j.select(
        "u",
        "n_relevant",
        F.coalesce((F.col("first") <= 10).cast("double"), F.lit(0.0)).alias("hr10"),
        F.col("first").isNotNull().cast("double").alias("hr20"),
        (F.coalesce("d10", F.lit(0.0)) / ideal(10)).alias("ndcg10"),
        (F.coalesce("d20", F.lit(0.0)) / ideal(20)).alias("ndcg20"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr20"),
    )


METRICS = ("hr10", "hr20", "ndcg10", "ndcg20", "mrr20")


def macro(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    return metrics.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_users"), *[F.avg(m).alias(m) for m in METRICS])
