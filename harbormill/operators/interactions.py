"""From raw interactions to unique positive pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbormill.functions.ids import clean_id, is_invalid_user
from harbormill.functions.names import core_name
from harbormill.functions.numeric import no_nan


def user_items(df: DataFrame, user: str = "user_id", item: str = "img_hotel_id", rating: str = "rating") -> DataFrame:
    """(u, i, rating) with valid users and items only."""
    u, i = F.trim(F.col(user).cast("string")), clean_id(F.col(item))
    return df.select(u.alias("u"), i.alias("i"), no_nan(F.col(rating)).alias("rating")).filter(~is_invalid_user(F.col("u")) & F.col("i").isNotNull())


def positives(df: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Rows rated at least ``threshold``; neither null nor NaN passes."""
    return df.filter(no_nan(F.col("rating")) >= threshold).withColumn("label", F.lit(1))


def with_media(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows whose item has at least one image."""
    have = registry.filter(F.size("available_images") > 0).select(clean_id(F.col("img_hotel_id")).alias("i")).distinct()
    return df.join(have, "i", "left_semi")


def unique_pairs(df: DataFrame) -> DataFrame:
    """(u, i, max_rating, n_rows)."""
    return df.groupBy("u", "i").agg(F.max("rating").alias("max_rating"), F.count(F.lit(1)).alias("n_rows"))


def aggregate_pairs(df: DataFrame, user: Column, item: Column, text: Column, order: str) -> DataFrame:
    """One row per pair: number of rows, highest rating, first row, and its texts joined by a blank in ``order``.

    Empty texts and the word ``nan`` are left out.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    rows = df.select(user.alias("u"), item.alias("i"), no_nan(F.col("rating")).alias("rating"), t.alias("t"), F.col(order).alias("o")).filter("u is not null and i is not null")
    told = F.when((F.col("t") != "") & (F.lower("t") != "nan"), F.struct("o", "t"))
    g = rows.groupBy("u", "i").agg(F.count(F.lit(1)).alias("n_rows"), F.max("rating").alias("max_rating"), F.min("o").alias("first_row"), F.sort_array(F.collect_list(told)).alias("told"))
    return g.select("u", "i", "n_rows", "max_rating", "first_row", F.array_join(F.transform("told", lambda s: s["t"]), " ").alias("text"))


def item_core(pairs: DataFrame, k: int = 5, iterations: int = 1) -> DataFrame:
    """Pairs of items with at least ``k`` of them; one pass by default."""
    for _ in range(iterations):
        keep = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("i")
        pairs = pairs.join(keep, "i", "left_semi")
    return pairs


def dense_pairs(pairs: DataFrame, user_least: int) -> DataFrame:
    """Pairs of users with at least ``user_least`` of them."""
    keep = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= user_least).select("u")
    return pairs.join(keep, "u", "left_semi")


def resolve_one_to_one(a: DataFrame, a_id: str, a_name: Column, b: DataFrame, b_id: str, b_name: Column, min_tokens: int = 0) -> DataFrame:
    """(core, a_id, b_id): records of two registries whose core name is unique on both sides.

    A side's core counts as unique if all its rows carry one id.
    """

    def unique(df: DataFrame, key: str, name: Column) -> DataFrame:
        rows = df.select(F.col(key).alias(key), core_name(name, min_tokens=min_tokens).alias("core")).filter("core != ''")
        # one id per core: smallest and largest agree, which needs no distinct count
        return rows.groupBy("core").agg(F.min(key).alias(key), F.max(key).alias("__max")).filter(F.col(key) == F.col("__max")).drop("__max")

    return unique(a, a_id, a_name).join(unique(b, b_id, b_name), "core")


def image_lists(images: DataFrame, key: Column, url: Column, chunk: int = 1000) -> DataFrame:
    """(hotel, part, n, urls): each hotel's distinct image addresses, in as many lists as its size asks for.

    Addresses are dealt to a hotel's parts by hash, so no task holds all of a large hotel's images.
    """
    rows = images.select(key.alias("hotel"), url.alias("url")).filter("hotel is not null and url is not null").distinct()
    parts = rows.groupBy("hotel").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts"))
    hashed = F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long")
    dealt = rows.join(parts, "hotel").withColumn("part", F.pmod(hashed, F.col("parts")).cast("long"))
    return dealt.groupBy("hotel", "part").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("url")).alias("urls"))


def not_functional(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")
