"""Evidence features: history depth, popularity, availability, coherence; pooled vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbormill.functions import numeric, vectors

SLOTS = 32


def log_evidence(train: DataFrame, key: str) -> DataFrame:
    """(key, n, evidence): min-max scaled log1p of the key's train rows."""
    counts = train.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("__l", F.log1p("n"))
    return numeric.min_max(counts, "__l", "evidence").drop("__l")


def item_images(vecs: DataFrame, item: Column, slot: str = "slot", vec: str = "vec", dim: int = 64, slots: int = SLOTS) -> DataFrame:
    """(item, slot, vec): usable vectors in the first ``slots`` slots, in doubles."""
    rows = vecs.select(item.alias("item"), F.col(slot).alias("slot"), F.col(vec).alias("vec"))
    ok = F.col("item").isNotNull() & (F.col("slot") < slots) & vectors.usable(F.col("vec"), dim)
    return rows.filter(ok).withColumn("vec", vectors.as_double(F.col("vec")))


def availability(images: DataFrame, slots: int = SLOTS) -> DataFrame:
    return images.groupBy("item").agg(F.count(F.lit(1)).alias("n_images")).withColumn("availability", F.col("n_images") / slots)


def vector_sums(df: DataFrame, keys: list[str], vec: str, dim: int, *more: Column) -> DataFrame:
    """(keys, sums, more): element-wise sums, one partially aggregated buffer a dimension instead of exploded rows."""
    sums = F.array(*[F.sum(F.col(vec)[d]) for d in range(dim)]).alias("sums")
    return df.groupBy(*keys).agg(sums, *more)


def coherence_raw(images: DataFrame, dim: int = 64, keys: list[str] | None = None) -> DataFrame:
    """(item, n, raw): mean cosine over the pairs of an item's images, 0 with fewer than two.

    Closed form over unit vectors: the pairs' cosines add up to (|sum v|^2 - sum |v|^2) / 2, so no pair is ever built:
    one sum per dimension instead of a self-join.
    """
    keys = keys or ["item"]
    units = images.select(*keys, vectors.unit(F.col("vec")).alias("v"))
    sums = vector_sums(units, keys, "v", dim, F.count(F.lit(1)).alias("n"), F.sum(vectors.dot(F.col("v"), F.col("v"))).alias("own"))
    n, total = F.col("n"), vectors.dot(F.col("sums"), F.col("sums"))
    return sums.select(*keys, "n", F.when(n < 2, 0.0).otherwise((total - F.col("own")) / (n * (n - 1))).alias("raw"))


def coherence(images: DataFrame, dim: int = 64) -> DataFrame:
    raw = coherence_raw(images, dim).withColumn("raw", numeric.finite(F.col("raw")))
    return numeric.min_max(raw, "raw", "coherence").withColumn("coherence", numeric.clip(F.col("coherence")))


def scaled_by(df: DataFrame, col: str, bounds: DataFrame, out: str) -> DataFrame:
    """``col`` scaled by bounds taken elsewhere: one row with lo and hi."""
    width = F.col("hi") - F.col("lo")
    scaled = F.when(width > numeric.FLAT, (F.col(col) - F.col("lo")) / width).otherwise(0.0)
    return df.crossJoin(F.broadcast(bounds.select("lo", "hi"))).withColumn(out, numeric.clip(scaled)).drop("lo", "hi")


def pooled(vecs: DataFrame, key: str, vec: str = "vec", dim: int = 64, normalize: bool = True) -> DataFrame:
    """(key, vec): mean vector per key, to unit length."""
    sums = vector_sums(vecs, [key], vec, dim, F.count(F.lit(1)).alias("n"))
    out = sums.select(key, F.transform("sums", lambda x: x / F.col("n")).alias("vec"))
    return out.withColumn("vec", vectors.unit(F.col("vec"))) if normalize else out


def user_profiles(train: DataFrame, item_vecs: DataFrame, dim: int = 64) -> DataFrame:
    """(u, vec): normalised mean of the vectors of a user's train items (u, i joined to item, vec)."""
    joined = train.select("u", F.col("i").alias("item")).distinct().join(item_vecs, "item").select("u", "vec")
    return pooled(joined, "u", dim=dim)
