"""Graphs as edge tables: bipartite adjacency, nearest-neighbour graphs, propagation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harbormill.session import ship, written


def bipartite(pairs: DataFrame) -> DataFrame:
    """(u, i, w): each distinct pair weighted 1 / sqrt(deg u * deg i); the reverse edge has the same weight."""
    p = pairs.select("u", "i").distinct()
    du, di = p.groupBy("u").agg(F.count(F.lit(1)).alias("du")), p.groupBy("i").agg(F.count(F.lit(1)).alias("di"))
    return p.join(du, "u").join(di, "i").select("u", "i", (1 / F.sqrt(F.col("du") * F.col("di"))).alias("w"))


def nearest_items(items: DataFrame, key: str, vec: str, k: int, block_rows: int = 2000) -> DataFrame:
    """(src, dst, sim, rank): the k most cosine-similar items of each, itself included, ties to the smaller id.

    Exact, in blocks: the items are cut into pieces of ``block_rows`` and every piece meets every other in one NumPy
    product that keeps k a row, so neither pairs nor the whole matrix exist anywhere.  Meant for item catalogues.
    """
    ship(items.sparkSession)
    base = items.select(F.col(key).alias("id"), F.col(vec).alias("vec"))
    n = base.count()
    parts = max(1, -(-n // block_rows))
    placed = base.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    work = placed.select("id", "vec", F.col("part").alias("a"), every.alias("b"), F.lit(True).alias("asks")).unionByName(placed.select("id", "vec", every.alias("a"), F.col("part").alias("b"), F.lit(False).alias("asks")))
    kind = base.schema["id"].dataType.simpleString()

    def top(g: pd.DataFrame) -> pd.DataFrame:
        v = np.array(g["vec"].tolist(), dtype=float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        ask, ids = g["asks"].to_numpy(bool), g["id"].to_numpy()
        q, c, cid = v[ask], v[~ask], ids[~ask]
        if not len(q) or not len(c):
            return pd.DataFrame({"src": ids[:0], "dst": ids[:0], "sim": np.zeros(0)})
        order = np.argsort(cid, kind="stable")
        c, cid = c[order], cid[order]
        s = np.round(q @ c.T, 9)
        at = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"src": np.repeat(ids[ask], at.shape[1]), "dst": cid[at.ravel()], "sim": np.take_along_axis(s, at, 1).ravel()})

    found = work.groupBy("a", "b").applyInPandas(top, f"src {kind}, dst {kind}, sim double")
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def normalized(edges: DataFrame, weight: str = "sim") -> DataFrame:
    """(src, dst, w): d^-1/2 w d^-1/2, where d is the sum of a row's kept weights, at least 1e-12."""
    d = edges.groupBy("src").agg(F.greatest(F.sum(weight), F.lit(1e-12)).alias("d"))
    return (
        edges.join(d, "src")
        .join(d.select(F.col("src").alias("dst"), F.col("d").alias("d2")), "dst")
        .select("src", "dst", (F.col(weight) / F.sqrt(F.col("d")) / F.sqrt(F.col("d2"))).alias("w"))
    )


def max_fusion(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, dst, w): the larger weight over the union of the edges."""
    return a.select("src", "dst", "w").unionByName(b.select("src", "dst", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def mean_neighbours(edges: DataFrame, states: DataFrame) -> DataFrame:
    """(dst, d, x): unweighted mean of the states (node, d, x) of a node's sources."""
    return edges.select("src", "dst").join(states.withColumnRenamed("node", "src"), "src").groupBy("dst", "d").agg(F.avg("x").alias("x"))


def propagate(pairs: DataFrame, states: DataFrame, layers: int = 2) -> DataFrame:
    """(node, d, x): mean of the start states and ``layers`` propagations over the normalised bipartite graph.

    Nodes are ``u|<user>`` and ``i|<item>``.  Each layer is one join and one partially aggregated sum by (node,
    dimension); states are written after each, so lineage stays short.
    """
    b = bipartite(pairs)
    u, i = F.concat(F.lit("u|"), "u"), F.concat(F.lit("i|"), "i")
    edges = b.select(u.alias("src"), i.alias("dst"), "w").unionByName(b.select(i.alias("src"), u.alias("dst"), "w"))
    edges = written(edges, "edges")
    now, total = states, states
    for _ in range(layers):
        step = edges.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "d").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        now = written(step, "layer")
        total = total.unionByName(now)
    return total.groupBy("node", "d").agg((F.sum("x") / (layers + 1)).alias("x"))


def best_cells(s: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded value) of each row's k best cells after rounding, ties to the smaller column; cells that are not finite don't count.

    Columns are folded into groups; the k-th of the groups' maxima is no larger than the row's k-th value, so only cells from there on are rounded and sorted.
    """
    fold = max(1, min(8, s.shape[1] // k))
    groups = s[:, : s.shape[1] // fold * fold].reshape(len(s), fold, -1).max(1)
    least = np.partition(groups, -k, axis=1)[:, -k] if groups.shape[1] > k else np.full(len(s), -np.inf)
    row, col = np.nonzero(s >= (np.round(least, digits) - 10.0**-digits)[:, None])
    val = np.round(s[row, col], digits)
    row, col, val = (x[np.isfinite(val)] for x in (row, col, val))
    order = np.lexsort((col, -val, row))
    row, col, val = row[order], col[order], val[order]
    first = np.searchsorted(row, np.arange(len(s)))
    top = np.arange(len(row)) - first[row] < k
    return row[top], col[top], val[top]


def score_blocks(users: DataFrame, items: DataFrame, k: int, seen: DataFrame | None = None, digits: int = 6, block_rows: int = 4000) -> DataFrame:
    """(u, i, score, rank): each user's k best items by the dot product of (u, vec) and (i, vec, bias).

    Items are cut into pieces and users into slices of up to four blocks; each slice meets each piece, a part of its users
    at a time, and keeps k a piece, so the full matrix never exists and few copies of the vectors travel.
    ``seen`` (u, i) pairs are masked inside the blocks, from per-user lists bounded by the catalogue.
    """
    ship(items.sparkSession)
    n = items.count()
    parts = max(1, -(-n // (4 * block_rows)))
    hist = seen.groupBy("u").agg(F.collect_set("i").alias("seen")) if seen is not None else users.select("u", F.array().cast("array<string>").alias("seen"))
    asked = users.join(hist, "u", "left")
    # one row per piece, with the piece's vectors
    pieces = items.withColumn("part", F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int"))
    if "bias" not in items.columns:
        pieces = pieces.withColumn("bias", F.lit(0.0))
    slices = max(1, -(-users.count() // (4 * block_rows)))
    left = asked.select(F.col("u").alias("u"), F.col("vec").alias("vec"), F.col("seen").alias("seen")).withColumn("slice", F.pmod(F.xxhash64("u"), F.lit(slices)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    # new names keep both sides apart where they come from one table
    right = pieces.select(F.col("i").alias("i"), F.col("vec").alias("ivec"), F.col("bias").alias("ibias"), F.col("part").alias("ipart")).withColumn("islice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def best(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "i": [], "score": []})
        b = b.sort_values("i")
        ids, bias = b["i"].to_numpy(), b["ibias"].to_numpy(float)[None]
        at = {x: j for j, x in enumerate(ids)}
        vecs, turned = np.array(a["vec"].tolist(), dtype=float), np.array(b["ivec"].tolist(), dtype=float).T
        seen, names, step, out = a["seen"].to_numpy(), a["u"].to_numpy(), max(1, block_rows * 1000 // len(b)), []
        for lo in range(0, len(a), step):
            s = vecs[lo : lo + step] @ turned + bias
            s[~np.isfinite(s)] = -np.inf
            for r, h in enumerate(seen[lo : lo + step]):
                if h is not None:
                    s[r, [at[x] for x in h if x in at]] = -np.inf
            row, col, val = best_cells(s, k, digits)
            out.append(pd.DataFrame({"u": names[lo + row], "i": ids[col], "score": val}))
        return pd.concat(out)

    found = left.groupBy("slice", "part").cogroup(right.groupBy("islice", "ipart")).applyInPandas(best, "u string, i string, score double")
    rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc("score"), "i"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)

