"""Per-key results when a few keys hold most records: exact offset chunking.

1. Rows are counted per input partition and key (partial counts, one small shuffle).
2. A prefix sum over the partitions gives each (partition, key) its offset, so each
   row has an exact number within its key.
3. The number divided by ``chunk_rows`` is the row's chunk: chunks of a key are of
   equal size whatever the key's frequency, and no task ever holds a whole hot key.
4. Each chunk yields an ordered boundary state (counts, sums, first and last value,
   changes inside); the states of a key merge in chunk order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harbormill.session import ship, written

_PID, _MID, _RN, _CHUNK = "__pid", "__mid", "__rn", "__chunk"


def number_within_key(df: DataFrame, key: str, stable: bool = False) -> DataFrame:
    """``df`` with ``__pid``, ``__mid`` and ``__rn``, the exact 1-based number of each row within its key.

    The order is that of the input partitions.  ``stable`` says that the input is a
    plain scan, which gives the same partitions when it is computed again; any
    other input is first written, with its order, to the shared folder.  Null keys are numbered
    as a key of their own.
    """
    rows = df.withColumn(_MID, F.monotonically_increasing_id())
    if not stable:
        rows = written(rows, "numbering")
    rows = rows.withColumn(_PID, F.shiftright(_MID, 33))
    counts = rows.groupBy(_PID, key).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(key).orderBy(_PID).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(_PID).alias("__opid"), F.col(key).alias("__okey"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    local = rows.withColumn("__local", F.row_number().over(W.partitionBy(_PID, key).orderBy(_MID)))
    joined = local.join(offsets, (F.col(_PID) == F.col("__opid")) & F.col(key).eqNullSafe(F.col("__okey")))
    return joined.withColumn(_RN, F.col("__off") + F.col("__local")).drop("__opid", "__okey", "__off", "__local")


def per_key_stats(df: DataFrame, key: str, value: str, chunk_rows: int = 100_000, stable: bool = False) -> DataFrame:
    """One row per key: n, n_values, total, low, high, first_value, last_value, n_changes, n_chunks.

    ``first_value``/``last_value`` are the first and last non-null values in input order
    and ``n_changes`` counts neighbouring non-null values that differ.  NaN counts as
    null; null keys are left out; an empty table gives no rows; other columns of
    ``df`` are not read.
    """
    v = F.col(value).cast("double")
    slim = df.select(F.col(key).alias("__k"), F.when(~F.isnan(v), v).alias("__v")).filter(F.col("__k").isNotNull())
    numbered = number_within_key(slim, "__k", stable).withColumn(_CHUNK, F.floor((F.col(_RN) - 1) / chunk_rows))
    inside = W.partitionBy("__k", _PID).orderBy(_MID).rowsBetween(W.unboundedPreceding, -1)
    numbered = numbered.withColumn("__prev", F.last("__v", ignorenulls=True).over(inside))
    seen = F.col("__v").isNotNull()
    # fragments: what one input partition adds to one chunk; __prev of a fragment's first value reaches back into
    # the fragment before it in the same partition, so it only counts when it lies in the same chunk
    at = F.when(seen, F.col(_RN))
    fragments = numbered.groupBy("__k", _CHUNK, _PID).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("__v").alias("nv"),
        F.sum("__v").alias("total"),
        F.min("__v").alias("low"),
        F.max("__v").alias("high"),
        F.min_by("__v", at).alias("first_v"),
        F.max_by("__v", at).alias("last_v"),
        F.min_by("__prev", at).alias("first_prev"),
        F.sum(F.when(seen & F.col("__prev").isNotNull() & (F.col("__v") != F.col("__prev")), 1).otherwise(0)).alias("changes"),
    )
    order = W.partitionBy("__k").orderBy(_CHUNK, _PID).rowsBetween(W.unboundedPreceding, -1)
    # a boundary inside one partition is already counted through first_prev; one between partitions is not
    states = fragments.withColumn("__before", F.last("last_v", ignorenulls=True).over(order)).withColumn(
        "changes",
        F.col("changes")
        + F.when(F.col("first_prev").isNull() & F.col("__before").isNotNull() & F.col("first_v").isNotNull() & (F.col("__before") != F.col("first_v")), 1).otherwise(0),
    )
    place = F.struct(_CHUNK, _PID)
    return states.groupBy(F.col("__k").alias(key)).agg(
        F.sum("n").alias("n"),
        F.sum("nv").alias("n_values"),
        F.sum("total").alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min_by("first_v", F.when(F.col("first_v").isNotNull(), place)).alias("first_value"),
        F.max_by("last_v", F.when(F.col("last_v").isNotNull(), place)).alias("last_value"),
        F.sum("changes").alias("n_changes"),
        (F.max(_CHUNK) + 1).alias("n_chunks"),
    )


def apply_per_key_chunk(df: DataFrame, key: str, fn: Callable, schema: str, chunk_rows: int = 100_000, stable: bool = False) -> DataFrame:
    """Runs ``fn(pandas frame)`` on equal-sized chunks of each key's rows, at most ``chunk_rows`` in one call.

    The frame has the columns of ``df`` plus ``__chunk`` and ``__rn``; ``fn`` returns states with
    ``schema``, which the caller merges in chunk order.
    """
    ship(df.sparkSession)
    numbered = number_within_key(df, key, stable).withColumn(_CHUNK, F.floor((F.col(_RN) - 1) / chunk_rows)).drop(_PID, _MID)
    return numbered.groupBy(key, _CHUNK).applyInPandas(fn, schema)


def heavy_keys(stats: DataFrame, key: str, share: float) -> DataFrame:
    """Keys holding at least ``share`` of all rows of a ``per_key_stats`` result."""
    total = stats.agg(F.sum("n").alias("__all"))
    return stats.crossJoin(F.broadcast(total)).filter(F.col("n") >= F.lit(share) * F.col("__all")).select(key, "n")
