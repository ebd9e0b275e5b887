"""Readers and writers: discovery, alias mapping, quarantine, resumption, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harbormill.functions.numeric import no_nan

#: Spellings of the five standard columns in review dumps, best first.
ALIASES = {
    "user_id": ("user_id", "userId", "user", "reviewerID", "author"),
    "hotel_id": ("hotel_id", "hotelId", "item", "itemID", "hotel_url", "hotel"),
    "rating": ("rating", "overall", "score", "stars"),
    "review_text": ("review_text", "text", "review", "content"),
    "timestamp": ("timestamp", "date", "reviewTime", "time"),
}
IMAGE_LIST = T.StructType([T.StructField(c, T.StringType()) for c in ("image_id", "hotel_id", "image_url", "image_source", "upload_timestamp")])
EXCLUDED = ("temp_merged", "hotel_info")


def discover(spark: SparkSession, root: str, pattern: str = "*.{csv,json,jsonl}", excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, length, modified) of the files below ``root``, without those whose name holds an excluded word."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    keep = F.lit(True)
    for word in excluded:
        keep = keep & ~name.contains(word)
    # the content column is pruned: only the listing is read
    return files.filter(keep).select("path", "length", F.col("modificationTime").alias("modified"))


def standardize(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """The standard columns under whatever name ``df`` has them; rows without user or hotel are dropped.

    Ids and texts are trimmed strings, a missing text is '', ratings that don't parse (and NaN) are null; absent columns are null.
    """
    have = set(df.columns)

    def pick(std: str) -> Column:
        found = [F.col(f"`{a}`").cast("string") for a in aliases[std] if a in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    rating = no_nan(F.trim(pick("rating")).try_cast("double"))
    out = df.select(
        F.trim(pick("user_id")).alias("user_id"), F.trim(pick("hotel_id")).alias("hotel_id"), rating.alias("rating"), F.trim(F.coalesce(pick("review_text"), F.lit(""))).alias("review_text"), pick("timestamp").alias("timestamp")
    )
    return out.dropna(subset=["user_id", "hotel_id"])


def _apart(raw: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    # the reader parses a line only if some data column is asked for
    parsed = F.coalesce(F.length(columns[0]), F.lit(0)) >= 0
    return raw.filter(F.col("_broken").isNull() & parsed).drop("_broken"), raw.filter(F.col("_broken").isNotNull() & parsed).select("_broken")


def read_csv_dumps(spark: SparkSession, paths: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): headed files with the given columns; lines that don't fit are set apart instead of lost."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_broken", T.StringType())])
    raw = spark.read.schema(schema).option("header", True).option("columnPruning", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").csv(paths)
    return _apart(raw, columns)


def read_json_dumps(spark: SparkSession, paths: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_broken", T.StringType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(paths)
    return _apart(raw, columns)


def read_image_lists(spark: SparkSession, headless: str, headed: str | None = None) -> DataFrame:
    """Image rows of a headerless file and, if given, one with a header."""
    a = spark.read.schema(IMAGE_LIST).csv(headless)
    return a.unionByName(spark.read.option("header", True).schema(IMAGE_LIST).csv(headed), allowMissingColumns=True) if headed else a


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier run has not finished."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def signature(*cols: Column) -> Column:
    """The first 16 hex digits of a hash of the columns in canonical form: separators inside values are escaped and nulls are
    told from every text, so different rows have different forms."""
    plain = [F.coalesce(F.regexp_replace(c.cast("string"), r"([\\|])", r"\\$1"), F.lit(r"\N")) for c in cols]
    return F.substring(F.sha2(F.concat_ws("|", *plain), 256), 1, 16)


def write_single_csv(df: DataFrame, path: str) -> None:
    """A small result table as one file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def latex_table(df: DataFrame, digits: int = 4) -> str:
    """A result table of at most some dozen rows as LaTeX."""
    rows = df.limit(100).collect()
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    head = " & ".join(df.columns) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", head, *(" & ".join(show(v) for v in r) + r" \\" for r in rows), r"\end{tabular}"])


def write_id_map(df: DataFrame, path: str) -> None:
    """An (id, idx) table as JSON lines."""
    df.select("id", "idx").write.mode("overwrite").json(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, idx long").json(path)


def append_manifest(df: DataFrame, path: str) -> None:
    """Adds provenance rows to a manifest table."""
    df.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)
