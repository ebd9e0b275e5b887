"""Queries of the general problems: drift (p2), skew (p3), broken rows (p5), times (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbormill.functions.ids import clean_id
from harbormill.operators import drift, records, skew, timestamps
from harbormill.session import table

#: Shares from which a hotel counts as heavy.
ROW_SHARE, IMAGE_FACTOR = 0.03, 50
#: Rows of a chunk where hot keys are to be split at any size, and lines of a file.
CHUNK, FILE_LINES = 50, 400


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "review_dumps")).distinct()


def p2_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return drift.alternatives(table(spark, d, "review_dumps"))


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    u = drift.unified(table(spark, d, "review_dumps"))
    return u.withColumns({c: F.to_json(c) for c in ("extras", "tags", *(f"{r}_union" for r in drift.STANDARD))})


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each file were loaded, and left out for which reason: together all but the headers."""
    read = drift.read_dumps(table(spark, d, "review_dumps"))
    return read.groupBy("feed_id", "file_no", F.coalesce("fault", F.lit("loaded")).alias("outcome")).agg(F.count(F.lit(1)).alias("n_lines"))


def _hotel_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "multimodal_interactions_v3")
    return rows.select(clean_id(F.col("img_hotel_id")).alias("img_hotel_id"), "rating")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    stats = skew.per_key_stats(_hotel_rows(spark, d), "img_hotel_id", "rating", stable=True)
    rows = skew.heavy_keys(stats, "img_hotel_id", ROW_SHARE)
    images = table(spark, d, "item_images_v3").select(clean_id(F.col("img_hotel_id")).alias("img_hotel_id"), "image_count")
    per_hotel = skew.per_key_stats(images, "img_hotel_id", "image_count", stable=True)
    counts = images.filter("image_count is not null").groupBy("image_count").agg(F.count(F.lit(1)).alias("n"))
    median = counts.agg(F.percentile("image_count", F.lit(0.5), F.col("n")).alias("median"))
    # one row
    many = per_hotel.crossJoin(F.broadcast(median)).filter(F.col("high") >= IMAGE_FACTOR * F.col("median"))
    return (
        rows.select(F.lit("multimodal_interactions_v3").alias("table_name"), "img_hotel_id")
        .unionByName(many.select(F.lit("item_images_v3").alias("table_name"), "img_hotel_id"))
        .distinct()
    )


def p3_hotel_ratings(spark: SparkSession, d: str) -> DataFrame:
    s = skew.per_key_stats(_hotel_rows(spark, d), "img_hotel_id", "rating", stable=True)
    return s.select("img_hotel_id", "n", "n_values", F.round("total", 4).alias("total"), F.col("low").alias("lowest"), F.col("high").alias("highest"))


def p3_hotel_images(spark: SparkSession, d: str) -> DataFrame:
    """Per-hotel results over all listed images, of which a few hotels hold most."""
    lists = table(spark, d, "item_images_v3").select(clean_id(F.col("img_hotel_id")).alias("img_hotel_id"), F.explode("available_images").alias("url"))
    s = skew.per_key_stats(lists.withColumn("size", F.length("url")), "img_hotel_id", "size", stable=True)
    return s.select("img_hotel_id", "n", "n_values", F.col("total").cast("long").alias("n_chars"), F.col("low").cast("long").alias("shortest"), F.col("high").cast("long").alias("longest"))


def p3_chunked(spark: SparkSession, d: str) -> DataFrame:
    """Per-hotel results with chunks far smaller than the heavy hotels, which are split over many."""
    s = skew.per_key_stats(_hotel_rows(spark, d), "img_hotel_id", "rating", chunk_rows=CHUNK, stable=True)
    return s.select("img_hotel_id", "n", "n_values", F.round("total", 4).alias("total"), F.col("low").alias("lowest"), F.col("high").alias("highest"), "n_chunks")


def p3_rating_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each hotel has each rating, from states that a Python function makes of one chunk at a time."""
    rows = _hotel_rows(spark, d).filter("img_hotel_id is not null and rating is not null and not isnan(rating)").select("img_hotel_id", F.col("rating").cast("double").alias("rating"))
    states = skew.apply_per_key_chunk(rows, "img_hotel_id", lambda g: g.groupby(["img_hotel_id", "rating"]).size().rename("n").reset_index(), "img_hotel_id string, rating double, n long", CHUNK, stable=True)
    return states.groupBy("img_hotel_id", "rating").agg(F.sum("n").alias("n"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    parsed = records.parse_lines(table(spark, d, "train_set_lines"), "line_id", "line")
    return parsed.filter("reason is not null").select("line_id", "reason").distinct()


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    parsed = records.parse_lines(table(spark, d, "train_set_lines"), "line_id", "line")
    return parsed.filter("reason is null").select("line_id", *records.FIELDS)


def p5_reasons(spark: SparkSession, d: str) -> DataFrame:
    parsed = records.parse_lines(table(spark, d, "train_set_lines"), "line_id", "line")
    return parsed.groupBy(F.coalesce("reason", F.lit("loaded")).alias("outcome")).agg(F.count(F.lit(1)).alias("n_lines"))


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """Whole files, made of ``FILE_LINES`` lines each, read with recovery: one row a record with its place and outcome."""
    lines = table(spark, d, "train_set_lines").select("line_id", F.coalesce("line", F.lit("")).alias("line"))
    file_no = F.floor(F.col("line_id") / FILE_LINES).cast("long").alias("file_no")
    # a file has at most FILE_LINES lines, as line_id is unique
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "line"))), lambda x: x["line"]), "\n")
    parsed = records.parse_texts(lines.groupBy(file_no).agg(text.alias("text")), "file_no", "text")
    return parsed.select("file_no", F.col("line_no").cast("long").alias("line_no"), F.col("n_lines").cast("long").alias("n_lines"), F.coalesce("reason", F.lit("loaded")).alias("outcome"), "image_id")


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    clock = table(spark, d, "source_clock")
    a = timestamps.normalise_times(table(spark, d, "merged_hotelrec"), "row_id", "timestamp", "source_dump", clock)
    b = timestamps.normalise_times(table(spark, d, "train_set"), "row_id", "upload_timestamp", "image_source", clock)
    return a.withColumn("table_name", F.lit("merged_hotelrec")).unionByName(b.withColumn("table_name", F.lit("train_set")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _normalised(spark, d).filter("status = 'ok'").select("table_name", "row_id", "epoch_ms")


def p6_status(spark: SparkSession, d: str) -> DataFrame:
    return _normalised(spark, d).groupBy("table_name", "status", "format").agg(F.count(F.lit(1)).alias("n_rows"))


def p6_withheld(spark: SparkSession, d: str) -> DataFrame:
    """The readings chosen where the clock keeps each source's order of day and month to itself, against those it names.

    One row a source: texts with several readings, how many of them the mixture reads as the clock does, otherwise or not at all,
    the weight it gives to the day first, and the clock's word.
    """
    clock = table(spark, d, "source_clock")
    out = None
    for name, text, source in (("merged_hotelrec", "timestamp", "source_dump"), ("train_set", "upload_timestamp", "image_source")):
        read = timestamps.read_all(table(spark, d, name), "row_id", text, source, clock)
        counts = read.groupBy("source", "sig").agg(F.count(F.lit(1)).alias("n"))
        told, learned = timestamps.mixture(counts, clock), timestamps.mixture(counts)
        several = read.filter(F.size("instants") > 1)
        a = timestamps.choose_readings(several, told, keep=("source", "sig", "instants", "statuses")).withColumnRenamed("epoch_ms", "want")
        b = timestamps.choose_readings(a.select("id", "source", "sig", "instants", "statuses", "want"), learned, keep=("source", "want"))
        both = b.groupBy("source").agg(
            F.count(F.lit(1)).alias("n_open"), F.count_if(F.col("epoch_ms") == F.col("want")).alias("n_same"), F.count_if(F.col("epoch_ms") != F.col("want")).alias("n_other"), F.count_if(F.col("status") == "ambiguous").alias("n_ambiguous")
        )
        habits = learned.select(F.col("source").alias("s"), F.round("w_dmy", 4).alias("w_dmy"))
        part = both.join(habits, F.col("source") == F.col("s")).join(clock.select(F.col("source_name").alias("c"), "day_first"), F.col("source") == F.col("c"), "left").drop("s", "c")
        part = part.withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_alternatives, p2_unified, p2_loaded, p3_found, p3_hotel_ratings, p3_hotel_images, p3_chunked, p3_rating_counts, p5_found, p5_loaded, p5_reasons, p5_files, p6_found, p6_status, p6_withheld)
}

_ID = "regexp_replace(nullif(trim({0}), ''), '^([0-9]+)\\.0+$', '\\1')"
_RATED = f"SELECT {_ID.format('img_hotel_id')} AS img_hotel_id, CASE WHEN NOT isnan(rating) THEN CAST(rating AS DOUBLE) END AS rating FROM multimodal_interactions_v3"
#: The grammar as one regular expression over a line without mark and carriage return.
_LINES = r"""
WITH bare AS (
  SELECT line_id, regexp_replace(regexp_replace(coalesce(line, ''), '^\x{FEFF}', ''), '\r$', '') AS s FROM train_set_lines),
quoted AS (
  SELECT line_id, s, regexp_full_match(s, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS well,
         regexp_replace(s, '("([^"]|"")*")', 'q', 'g') AS plain FROM bare),
cut AS (
  SELECT *, length(plain) - length(replace(plain, ',', '')) + 1 AS n_fields,
         regexp_extract(s, '(?s)^("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),', 2) AS f2,
         regexp_extract(s, '(?s)^("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),', 3) AS f3 FROM quoted),
named AS (
  SELECT *, trim(CASE WHEN f2 LIKE '"%' THEN replace(substr(f2, 2, length(f2) - 2), '""', '"') ELSE f2 END, ' ') AS hotel,
         trim(CASE WHEN f3 LIKE '"%' THEN replace(substr(f3, 2, length(f3) - 2), '""', '"') ELSE f3 END, ' ') AS url FROM cut),
judged AS (
  SELECT line_id, CASE WHEN NOT well THEN 'quoting' WHEN n_fields <> 5 THEN 'column_count'
    WHEN NOT regexp_full_match(hotel, '0*[1-9][0-9]*(\.0)?') THEN 'hotel_id'
    WHEN NOT regexp_full_match(url, '(?i)https?://([^/?#@]*@)*[^/?#@:]+.*') OR regexp_matches(url, '[\s\x{A0}\x{85}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}\x{1680}\x{205F}\v]') THEN 'image_url' END AS reason
  FROM named)
"""

#: The fields of the loadable lines.
_FIELDS = _LINES + r"""
, f AS (
  SELECT line_id, regexp_extract(s, '(?s)^("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*),("(?:[^"]|"")*"|[^",]*)$', ['a', 'b', 'c', 'd', 'e']) AS g
  FROM named JOIN judged USING (line_id) WHERE reason IS NULL),
u AS (SELECT line_id, list_transform([g.a, g.b, g.c, g.d, g.e], lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS v FROM f)
"""
#: A line starts a record anew if it reads as five fields, the first a whole number; lines between a broken quote and such a line belong to the error.
_FILES = _LINES + rf"""
, placed AS (
  SELECT n.line_id, CAST(floor(n.line_id / {FILE_LINES}) AS BIGINT) AS file_no, n.s, j.reason, n.well AND n.n_fields = 5 AND regexp_matches(n.s, '^("[0-9]+"|[ ]*[0-9]+[ ]*),') AS anchor FROM named n JOIN judged j USING (line_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY line_id) AS line_no FROM placed),
past AS (
  SELECT *, max(CASE WHEN reason = 'quoting' THEN line_no END) OVER b AS broken, max(CASE WHEN anchor THEN line_no END) OVER b AS sound
  FROM numbered WINDOW b AS (PARTITION BY file_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
taken AS (SELECT *, NOT anchor AND broken IS NOT NULL AND broken > coalesce(sound, 0) AS lost FROM past),
heads AS (SELECT *, count(CASE WHEN NOT lost THEN 1 END) OVER (PARTITION BY file_no ORDER BY line_no) AS region FROM taken)
"""

ORACLE = {
    "p2_loaded": r"""
WITH l AS (
  SELECT feed_id, file_no, line_no, regexp_matches(lower(file_name), '\.(json|jsonl|ndjson)$') AS js, coalesce(line, '') AS raw,
    regexp_replace(regexp_replace(coalesce(line, ''), '\r+$', ''), '^\x{FEFF}+', '') AS s FROM review_dumps),
w AS (SELECT *, CASE WHEN s = '' THEN 0 ELSE length(p) - length(replace(p, ',', '')) + 1 END AS width
  FROM (SELECT *, regexp_replace(s, '(^|,)"([^"]|"")*("|$)', '\1', 'g') AS p FROM l)),
h AS (SELECT feed_id, file_no, min(width) AS columns FROM w WHERE NOT js AND line_no = 1 GROUP BY 1, 2)
SELECT feed_id, file_no, CASE WHEN js THEN CASE WHEN json_valid(raw) AND json_type(CASE WHEN json_valid(raw) THEN raw END) = 'OBJECT' THEN 'loaded' ELSE 'not_an_object' END
    WHEN columns IS NULL THEN 'no_header' WHEN columns <> width THEN 'column_count' ELSE 'loaded' END AS outcome, count(*) AS n_lines
FROM w LEFT JOIN h USING (feed_id, file_no) WHERE js OR line_no <> 1 GROUP BY 1, 2, 3""",
    "p5_loaded": _FIELDS + r"""
SELECT line_id, CASE WHEN regexp_full_match(trim(v[1], ' '), '[0-9]{1,18}') THEN CAST(trim(v[1], ' ') AS BIGINT) END AS image_id,
  regexp_extract(trim(v[2], ' '), '^0*([1-9][0-9]*)', 1) AS hotel_id, trim(v[3], ' ') AS image_url, nullif(v[4], '') AS image_source, nullif(v[5], '') AS upload_timestamp FROM u""",
    "p5_files": _FILES + r"""
, g AS (SELECT file_no, region, min(line_no) AS line_no, count(*) AS n_lines, arg_min(coalesce(reason, 'loaded'), line_no) AS outcome, arg_min(s, line_no) AS s FROM heads GROUP BY 1, 2)
SELECT file_no, line_no, n_lines, outcome, CASE WHEN outcome = 'loaded' THEN TRY_CAST(nullif(regexp_extract(s, '^"?[ ]*([0-9]{1,18})[ ]*"?,', 1), '') AS BIGINT) END AS image_id FROM g WHERE NOT (s = '' AND n_lines = 1)""",
    "p3_found": f"""
WITH r AS ({_RATED}), c AS (SELECT img_hotel_id, count(*) AS n FROM r WHERE img_hotel_id IS NOT NULL GROUP BY 1)
SELECT 'multimodal_interactions_v3' AS table_name, img_hotel_id FROM c WHERE n >= {ROW_SHARE} * (SELECT sum(n) FROM c)
UNION
SELECT 'item_images_v3', {_ID.format('img_hotel_id')} FROM item_images_v3
WHERE {_ID.format('img_hotel_id')} IS NOT NULL AND image_count >= {IMAGE_FACTOR} * (SELECT quantile_cont(image_count, 0.5) FROM item_images_v3)""",
    "p3_hotel_ratings": f"""
WITH r AS ({_RATED})
SELECT img_hotel_id, count(*) AS n, count(rating) AS n_values, round(sum(rating), 4) AS total, min(rating) AS lowest, max(rating) AS highest
FROM r WHERE img_hotel_id IS NOT NULL GROUP BY 1""",
    "p3_chunked": f"""
WITH r AS ({_RATED})
SELECT img_hotel_id, count(*) AS n, count(rating) AS n_values, round(sum(rating), 4) AS total, min(rating) AS lowest, max(rating) AS highest, CAST(ceil(count(*) / {CHUNK}) AS BIGINT) AS n_chunks
FROM r WHERE img_hotel_id IS NOT NULL GROUP BY 1""",
    "p3_rating_counts": f"""
WITH r AS ({_RATED}) SELECT img_hotel_id, rating, count(*) AS n FROM r WHERE img_hotel_id IS NOT NULL AND rating IS NOT NULL GROUP BY 1, 2""",
    "p3_hotel_images": f"""
WITH r AS (SELECT {_ID.format('img_hotel_id')} AS img_hotel_id, unnest(available_images) AS url FROM item_images_v3)
SELECT img_hotel_id, count(*) AS n, count(url) AS n_values, sum(length(url))::BIGINT AS n_chars, min(length(url)) AS shortest, max(length(url)) AS longest FROM r WHERE img_hotel_id IS NOT NULL GROUP BY 1""",
    "p5_found": _LINES + "SELECT DISTINCT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_reasons": _LINES + "SELECT coalesce(reason, 'loaded') AS outcome, count(*) AS n_lines FROM judged GROUP BY 1",
}
