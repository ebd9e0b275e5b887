"""Queries of the problems on corpora and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbormill.llm import leakage, linkage, neighbours, packing, pagespam
from harbormill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "clip_per_image_v4"))
    return near.select(F.least("id", "neighbour").alias("vec_id_lo"), F.greatest("id", "neighbour").alias("vec_id_hi")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = linkage.match_hotels(table(spark, d, "item_images_v3"), table(spark, d, "hotel_info"))
    return pairs.select("ta_hotel_id", "hotel_info_id").distinct()


def p4_confidence(spark: SparkSession, d: str) -> DataFrame:
    return linkage.match_hotels(table(spark, d, "item_images_v3"), table(spark, d, "hotel_info"), sure=0.02)


def p4_calibration(spark: SparkSession, d: str) -> DataFrame:
    return linkage.calibration(linkage.hotel_links(table(spark, d, "item_images_v3"), table(spark, d, "hotel_info")))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), 2048)


def p7_packed_512(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), 512)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    bins = packing.pack(table(spark, d, "documents"), 2048).groupBy("bin_id").agg(F.sum("n_tokens").alias("held"))
    return bins.agg(F.count(F.lit(1)).alias("n_bins"), F.sum("held").alias("n_tokens"), F.round(F.avg("held") / 2048, 6).alias("fill"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    clean = leakage.remove_leaks(docs, items, leakage.find_leaks(docs, items), "spans")
    return clean.select("doc_id", F.length("text").alias("n_chars_left"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("host"), "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pagespam.score_pages(_pages(spark, d)).filter("score > 0.5").select("doc_id").distinct()


def p9_hosts(spark: SparkSession, d: str) -> DataFrame:
    s = pagespam.score_pages(_pages(spark, d))
    return s.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("score") > 0.5).alias("n_spam"))


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_confidence, p4_calibration, p7_packed, p7_packed_512, p7_fill, p8_found, p8_clean, p9_found, p9_hosts)}
ORACLE: dict[str, str] = {}
