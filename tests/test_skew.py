import math
import random

import pandas as pd
import pytest

from harbormill.operators import skew


def brute(rows):
    out = {}
    for k, v in rows:
        if k is None:
            continue
        s = out.setdefault(k, {"n": 0, "vals": []})
        s["n"] += 1
        if v is not None and not math.isnan(v):
            s["vals"].append(v)
    return out


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_per_key_stats_equals_brute_force(spark, chunk):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([1.0, 2.0, 3.0, None, float("nan")])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3).sortWithinPartitions("k")
    # the order is that of the input partitions
    df = spark.createDataFrame(df.collect(), "k string, v double").coalesce(3)
    want = brute([(r["k"], r["v"]) for r in df.collect()])
    got = {r["k"]: r for r in skew.per_key_stats(df, "k", "v", chunk_rows=chunk).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        g, v = got[k], w["vals"]
        assert (g["n"], g["n_values"]) == (w["n"], len(v))
        assert g["total"] == pytest.approx(sum(v)) and (g["low"], g["high"]) == (min(v), max(v))
        assert (g["first_value"], g["last_value"]) == (v[0], v[-1])
        assert g["n_changes"] == sum(x != y for x, y in zip(v, v[1:]))
        assert g["n_chunks"] == -(-w["n"] // chunk)


def test_numbers_within_a_key_are_exact(spark):
    df = spark.createDataFrame([("x",)] * 50 + [(None,)] * 7 + [("y",)] * 3, "k string").repartition(5)
    n = skew.number_within_key(df, "k").toPandas()
    assert sorted(n[n["k"] == "x"]["__rn"]) == list(range(1, 51))
    assert sorted(n[n["k"].isna()]["__rn"]) == list(range(1, 8))


def test_chunks_are_of_equal_size(spark):
    df = spark.createDataFrame([("hot", i) for i in range(95)] + [("cold", 1)], "k string, v long")

    def size(g):
        return pd.DataFrame({"k": [g["k"].iloc[0]], "chunk": [int(g["__chunk"].iloc[0])], "n": [len(g)]})

    got = skew.apply_per_key_chunk(df, "k", size, "k string, chunk long, n long", 10).toPandas()
    assert got["n"].max() == 10 and sorted(got[got["k"] == "hot"]["n"]) == [5] + [10] * 9


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert skew.per_key_stats(empty, "k", "v").count() == 0
    odd = spark.createDataFrame([("a", 1.0, 9), ("a", None, 9)], "k string, v double, n int")
    assert skew.per_key_stats(odd, "k", "v").first()["n"] == 2


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a", 1.0)] * 97 + [("b", 1.0)] * 3, "k string, v double")
    s = skew.per_key_stats(df, "k", "v")
    assert {r["k"] for r in skew.heavy_keys(s, "k", 0.03).collect()} == {"a", "b"}
    assert {r["k"] for r in skew.heavy_keys(s, "k", 0.031).collect()} == {"a"}
