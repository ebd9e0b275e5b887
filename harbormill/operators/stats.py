"""Statistics of experiments: summaries, strata, rank tests, bootstraps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harbormill.operators.split import numbered
from harbormill.session import ship


def sd(c: str | Column) -> Column:
    """Sample deviation, 0 for a single value."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def seed_summary(runs: DataFrame, by: str, value: str) -> DataFrame:
    return runs.groupBy(by).agg(F.avg(value).alias("mean"), sd(value).alias("sd"), F.count(F.lit(1)).alias("n_seeds"))


def two_level(runs: DataFrame, by: list[str], outer: str, value: str) -> DataFrame:
    """Mean inside each outer seed first, then mean and deviation across them, and the mean deviation inside."""
    inner = runs.groupBy(*by, outer).agg(F.avg(value).alias("m"), sd(value).alias("s"))
    return inner.groupBy(*by).agg(F.avg("m").alias("mean"), sd("m").alias("sd_between"), F.avg("s").alias("sd_within"), F.count(F.lit(1)).alias("n_outer"))


def relative_drop(levels: DataFrame, by: str, level: str, value: str) -> DataFrame:
    """Percentage lost against the clean level 0 of the same group."""
    clean = F.max(F.when(F.abs(F.col(level)) < 1e-8, F.col(value))).over(W.partitionBy(by))
    return levels.withColumn("clean", clean).withColumn("drop_pct", F.when(F.col("clean") != 0, 100 * (F.col("clean") - F.col(value)) / F.col("clean")))


def average_ranks(df: DataFrame, col: str, by: list[str] | None = None, out: str = "rank") -> DataFrame:
    """(by..., col, ``out``, __c): the mean rank of each distinct value within its group, and how often it stands there.

    All rows are numbered in one global order by sorted range partitions; a value's mean number less the one before its
    group is its rank, so no task sorts a whole group.
    """
    keys = list(by or [])
    rows = numbered(df.select(*keys, col), [F.col(k) for k in keys] + [F.col(col)], "__no")
    ranks = rows.groupBy(*keys, col).agg(F.avg("__no").alias("__mean"), F.count(F.lit(1)).alias("__c"))
    if not keys:
        return ranks.select(col, (F.col("__mean") + 1).alias(out), "__c")
    starts = rows.groupBy(*keys).agg(F.min("__no").alias("__from"))
    return ranks.join(starts, keys).select(*keys, col, (F.col("__mean") - F.col("__from") + 1).alias(out), "__c")


def quartiles(df: DataFrame, col: str, out: str = "quartile") -> DataFrame:
    """Q1-low .. Q4-high by average rank over the number of rows."""
    ranks = average_ranks(df, col)
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    named = ranks.crossJoin(F.broadcast(total)).withColumn("__p", F.col("rank") / F.col("__all"))
    named = named.select(col, F.when(F.col("__p") <= 0.25, "Q1-low").when(F.col("__p") <= 0.5, "Q2").when(F.col("__p") <= 0.75, "Q3").otherwise("Q4-high").alias(out))
    return df.join(named, col)


def quantile_bins(df: DataFrame, col: str, cuts: int = 4) -> DataFrame:
    """(lo, hi, n): rows per quantile bin, right-closed, the first with its minimum; equal edges are merged."""
    probs = [i / cuts for i in range(cuts + 1)]
    edges = df.agg(F.array_distinct(F.percentile(col, F.array(*[F.lit(p) for p in probs]))).alias("e"))
    bins = edges.select(F.posexplode(F.expr("slice(e, 2, size(e) - 1)")).alias("b", "hi"), "e").select("b", F.col("e")[F.col("b")].alias("lo"), "hi")
    inside = (F.col(col) <= F.col("hi")) & ((F.col(col) > F.col("lo")) | ((F.col("b") == 0) & (F.col(col) == F.col("lo"))))
    return df.select(col).join(F.broadcast(bins), inside).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation per group, null for a constant side."""
    base = df.select(*by, x, y)
    r = base.join(average_ranks(base, x, by, "rx").drop("__c"), [*by, x]).join(average_ranks(base, y, by, "ry").drop("__c"), [*by, y])
    flat = (F.coalesce(F.stddev_pop("rx"), F.lit(0.0)) < 1e-12) | (F.coalesce(F.stddev_pop("ry"), F.lit(0.0)) < 1e-12)
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return r.groupBy(*by).agg(F.when(~flat, rho).alias("rho"), F.count(F.lit(1)).alias("n"))


def paired(a: DataFrame, b: DataFrame, value: str, seeds: int | None = None) -> DataFrame:
    """(u, diff) of the users that both have; a and b hold (u, seed, value), averaged over seeds first.

    With ``seeds`` a side with several seeds must have exactly so many for a user, or the user is left out; a side with one seed is deterministic.
    """
    x, y = (t.groupBy("u").agg(F.avg(value).alias(v), F.count_distinct("seed").alias("k")) for t, v in ((a, "va"), (b, "vb")))
    if seeds is not None:
        x, y = (t.filter(F.col("k").isin(1, seeds)) for t in (x, y))
    x, y = x.drop("k"), y.drop("k")
    return x.join(y, "u").select("u", (F.col("va") - F.col("vb")).alias("diff"))


def difference_summary(diffs: DataFrame) -> DataFrame:
    d = F.col("diff")
    return diffs.agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.percentile(d, F.lit(0.5)).alias("median"), F.avg((d > 0).cast("double")).alias("win_rate"), F.avg((d == 0).cast("double")).alias("tie_rate")
    )


def wilcoxon(diffs: DataFrame) -> DataFrame:
    """(n, w_plus, w_minus, ties, z): signed ranks with zeros split, ties at mean rank, normal approximation.

    Ranks are those of ``average_ranks``, so no task sorts all differences.
    """
    base = diffs.select(F.abs("diff").alias("a"), F.signum("diff").alias("s"))
    g = base.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("s") > 0).alias("p"), F.count_if(F.col("s") < 0).alias("m"))
    r = g.join(average_ranks(base, "a").drop("__c"), "a")
    zero = F.col("c") - F.col("p") - F.col("m")
    t = r.agg(
        F.sum("c").alias("n"),
        F.sum(F.col("rank") * (F.col("p") + zero / 2.0)).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("m") + zero / 2.0)).alias("w_minus"),
        F.sum(F.pow(F.col("c"), 3) - F.col("c")).alias("ties"),
        F.sum(zero).alias("zeros"),
    )
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return t.select("n", "w_plus", "w_minus", "zeros", F.when(var > 0, (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(var)).alias("z"))


def two_sided_p(z: float | None) -> float:
    """Two-sided normal p value; no difference at all gives 1."""
    return 1.0 if z is None else math.erfc(abs(z) / math.sqrt(2))


def holm(tests: DataFrame, p: str = "p", name: str = "test") -> DataFrame:
    """Step-down adjusted p values; a family of tests is small."""
    order = W.orderBy(p, name)
    m = F.count(F.lit(1)).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("step", step).withColumn("adjusted", F.max("step").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("step")


def bootstrap_mean(diffs: DataFrame, replicates: int = 10_000, seed: int = 2026) -> DataFrame:
    """(n, mean, lo, hi): percentile interval of resampled means.

    A resample's mean only depends on how often each distinct value is drawn, and these counts are multinomial; so
    the values travel as a table of distinct values with counts and every task does a block of replicates.  Values
    are rounded to 9 digits first.
    """
    spark = diffs.sparkSession
    ship(spark)
    table = diffs.select(F.round("diff", 9).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    packed = table.agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("t"))
    blocks = spark.range(0, -(-replicates // 200)).withColumnRenamed("id", "block").crossJoin(F.broadcast(packed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, t in zip(b["block"], b["t"]):
                v = np.array([x["v"] for x in t], dtype=float)
                c = np.array([x["c"] for x in t], dtype=float)
                n, todo = int(c.sum()), min(200, replicates - int(block) * 200)
                if not n:
                    continue
                rng = np.random.default_rng([seed, int(block)])
                yield pd.DataFrame({"m": [float(rng.multinomial(n, c / n) @ v / n) for _ in range(todo)]})

    means = blocks.repartition("block").mapInPandas(run, "m double")
    ci = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return diffs.agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean")).crossJoin(ci).select("n", "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def hierarchical_bootstrap(runs: DataFrame, value: str, outer: str = "model_seed", inner: str = "corruption_seed", replicates: int = 20_000, seed: int = 2026) -> DataFrame:
    """(mean, lo, hi): outer seeds are resampled, and inside each its inner seeds; a grid of seeds is a few dozen rows."""
    spark = runs.sparkSession
    ship(spark)
    cells = runs.groupBy(outer, inner).agg(F.avg(value).alias("x"))
    packed = cells.groupBy(outer).agg(F.transform(F.array_sort(F.collect_list(F.struct(inner, "x"))), lambda s: s["x"]).alias("xs")).agg(F.transform(F.array_sort(F.collect_list(F.struct(outer, "xs"))), lambda s: s["xs"]).alias("g"))
    blocks = spark.range(0, -(-replicates // 2000)).withColumnRenamed("id", "block").crossJoin(F.broadcast(packed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, g in zip(b["block"], b["g"]):
                groups = [np.array(x, dtype=float) for x in g]
                todo = min(2000, replicates - int(block) * 2000)
                rng = np.random.default_rng([seed, int(block)])
                pick = rng.integers(0, len(groups), (todo, len(groups)))
                out = np.zeros(todo)
                for r in range(todo):
                    out[r] = np.mean([groups[j][rng.integers(0, len(groups[j]), len(groups[j]))].mean() for j in pick[r]])
                yield pd.DataFrame({"m": out})

    means = blocks.repartition("block").mapInPandas(run, "m double")
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def pick_cases(df: DataFrame, value: str, key: list[str], quantiles: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """(quantile, key..., value, distance): for each quantile in turn the nearest row whose first key is not taken yet.

    Every pass is a top-1 over the rows; the rows themselves never meet in one task.
    """
    spark, out, taken = df.sparkSession, None, []
    for q in quantiles:
        target = df.agg(F.percentile(value, F.lit(q)).alias("t"))
        left = df.filter(~F.col(key[0]).isin(taken)) if taken else df
        d = left.crossJoin(F.broadcast(target)).select(F.lit(q).alias("quantile"), *key, value, F.round(F.abs(F.col(value) - F.col("t")), 9).alias("distance")).orderBy("distance", *key).limit(1)
        got = d.collect()
        if not got:
            break
        taken.append(got[0][key[0]])
        part = spark.createDataFrame(got, d.schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.select(F.lit(0.0).alias("quantile"), *key, value, F.lit(0.0).alias("distance")).limit(0)
