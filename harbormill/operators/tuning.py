"""Search over configurations: grids, coordinate stages, early stopping, best trials."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grid(spark: SparkSession, axes: dict[str, list[float]]) -> DataFrame:
    """(trial, one column per axis): the Cartesian product in the order of the axes."""
    rows = [(k, *[float(x) for x in v]) for k, v in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, "trial int, " + ", ".join(f"{a} double" for a in axes))


def coordinate_search(start: dict, stages: list[tuple[str, list]], score: Callable[[dict], float]) -> tuple[dict, list[tuple[dict, float]]]:
    """The best configuration when one axis after the other is tried, and every trial once; of equals the first wins."""
    best, seen, log = dict(start), {}, []
    for axis, values in stages:
        tried = []
        for v in values:
            c = best | {axis: v}
            key = tuple(sorted(c.items()))
            if key not in seen:
                seen[key] = score(c)
                log.append((c, seen[key]))
            tried.append((seen[key], c))
        best = max(tried, key=lambda t: t[0])[1]
    return best, log


def best_trials(trials: DataFrame, by: list[str], metric: str, order: str) -> DataFrame:
    """One row per group: the highest metric, of equals the first in ``order``."""
    rest = [c for c in trials.columns if c not in by]
    return trials.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.col(metric), -F.col(order))).alias("__r")).select(*by, "__r.*")


def distinct_trials(trials: DataFrame, config: list[str], order: str) -> DataFrame:
    """The last trial of each configuration."""
    rest = [c for c in trials.columns if c not in config]
    return trials.groupBy(*config).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*config, "__r.*")


def stopping_points(curves: DataFrame, by: list[str], epoch: str, metric: str, patience: int, least: float = 1e-8) -> DataFrame:
    """(by, best_epoch, best, stopped_at): where training ends when ``patience`` epochs bring no gain above ``least``.

    A run's epochs are few; the window is per run.
    """
    w = W.partitionBy(*by).orderBy(epoch)
    before = F.max(metric).over(w.rowsBetween(W.unboundedPreceding, -1))
    gains = curves.withColumn("__gain", F.coalesce(F.col(metric) > before + least, F.lit(True)))
    last_gain = F.max(F.when(F.col("__gain"), F.col(epoch))).over(w.rowsBetween(W.unboundedPreceding, 0))
    idle = gains.withColumn("__at", last_gain).withColumn("__stop", F.col(epoch) - F.col("__at") >= patience)
    stop = idle.groupBy(*by).agg(F.min(F.when(F.col("__stop"), F.col(epoch))).alias("s"), F.max(epoch).alias("m")).withColumn("stopped_at", F.coalesce("s", "m")).drop("s", "m")
    seen = idle.join(stop, by).filter(F.col(epoch) <= F.col("stopped_at"))
    return seen.groupBy(*by, "stopped_at").agg(F.max(metric).alias("best"), F.max(F.when(F.col("__gain"), F.col(epoch))).alias("best_epoch"))


def parameter_counts(weights: DataFrame) -> DataFrame:
    """(model, n): numbers in a weight table (model, param, row, vec)."""
    return weights.groupBy("model").agg(F.sum(F.size("vec")).cast("long").alias("n"))
