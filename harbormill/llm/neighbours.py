"""Most similar vectors for every vector: multi-index hashing.

1. Rotations learned on a bounded sample (iterative quantisation) turn every vector into a binary code whose Hamming
   distance follows the angle.
2. The code is split into m substrings and each is indexed.  By the pigeonhole principle two codes within Hamming
   radius m - 1 agree in at least one substring, so a row's m buckets hold every code within that radius.  The length
   of a substring follows log2(n / bucket), and so does their number from eight on, so that buckets stay as large, and a
   vector is looked up m times, at any n.
3. In a bucket the Hamming distances of the whole codes come first: each row takes the smallest radius that holds
   ``keep`` others, all of that radius, and only these are compared as floats.  Buckets larger than a piece are cut and
   every pair of pieces is compared, so a crowded region is neither capped nor held in one task.
4. The k best of all substrings are merged.  Vectors of one direction are one class; a class is searched once and its
   rows share the answer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harbormill.session import ship, written

#: Rows that a bucket is meant to hold; sets the length of a substring.
BUCKET = 1024
#: Substrings, at least, where there is more than one bucket; a vector's neighbours then have as many ways to be met.
LEAST = 8
#: Bits of a code, at least, for the Hamming distances inside a bucket.
BITS = 64
#: Others that a row's Hamming radius in a bucket has to hold.
KEEP = 128
#: Rows of one piece of a bucket.
PIECE = 4096
#: Vectors that the rotation is learned on, at most, in the order of a hash of their id.
SAMPLE = 20_000
#: Decimals up to which cosines count as tied.
DIGITS = 6
#: Roles of a row in a task: compared with all, or one of two pieces that meet.
_SELF, _FIRST, _SECOND = range(3)


def learn_rotations(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) for a code of ``bits``: as many rotations as it takes, learned from different starts."""
    turns = [learn_rotation(x, seed=11 + t) for t in range(-(-bits // x.shape[1]))]
    return turns[0][0], np.concatenate([r for _, r in turns], 1)[:, :bits]


def learn_rotation(x: np.ndarray, rounds: int = 40, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) such that sign((v - mean) @ projection) is the code: PCA, then the rotation that best fits the signs."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    c = x - mean
    _, axes = np.linalg.eigh(c.T @ c) if len(x) else (None, np.eye(x.shape[1]))
    p = c @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))
    for _ in range(rounds if len(x) else 0):
        u, _, vt = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
        r = (u @ vt).T
    return mean, axes @ r


def plan(n: int, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits of a substring, substrings) for n vectors; what fits one bucket is one bucket and compared whole."""
    length = max(0, math.ceil(math.log2(max(1, n / bucket))))
    return length, max(LEAST, length) if length else 1


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec as floats or else doubles) of the vectors that take part: right length, no null, NaN or infinite component, not all zero."""
    v = F.col("vec")
    narrow = "float" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    slim = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{narrow}>").alias("vec")).filter(F.col("id").isNotNull() & (F.size("vec") == dim))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return slim.filter(fine).filter(F.exists(v, lambda x: x != 0))


def to_units(raw: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in doubles; no row is all zero."""
    v = raw.astype(float)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _top(q: np.ndarray, qid: np.ndarray, qcode: np.ndarray, c: np.ndarray, cid: np.ndarray, ccode: np.ndarray, k: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, cosine) of the k best of ``c`` for each row of ``q`` by rounded cosine, then id, among the codes within the
    smallest Hamming radius of a ladder that holds ``keep`` of them; a vector is not its own neighbour."""
    bits = 64 * qcode.shape[1]
    wide = np.uint16 if bits > 250 else np.uint8
    none = np.iinfo(wide).max
    ladder = np.unique((bits * np.array([0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18, 0.22, 0.27, 0.33, 0.4, 1.0])).astype(int)).astype(wide)
    out: list[tuple] = []
    for lo in range(0, len(qid), 512):
        at = slice(lo, lo + 512)
        far = np.zeros((len(qid[at]), len(cid)), dtype=wide)
        for w in range(qcode.shape[1]):
            far += np.bitwise_count(qcode[at, None, w] ^ ccode[None, :, w])
        far[qid[at, None] == cid[None, :]] = none
        radius = np.full(len(far), ladder[-1])
        for r in ladder[-2::-1]:
            radius[(far <= r).sum(1) >= keep] = r
        near = far <= radius[:, None]
        if near.sum() > 0.1 * near.size:
            s = q[at] @ c.T
            s[~near] = -3.0
            if s.shape[1] > k:  # ties of rounding stay
                near &= s >= np.partition(s, -k, axis=1)[:, -k, None] - 2 * 10.0**-DIGITS
            row, col = np.nonzero(near)
            sims = np.round(s[row, col], DIGITS)
        else:
            row, col = np.nonzero(near)
            sims = np.round(np.einsum("ij,ij->i", q[lo + row], c[col]), DIGITS)
        order = np.lexsort((cid[col], -sims, row))
        row, col, sims = row[order], col[order], sims[order]
        first = np.searchsorted(row, np.arange(len(far)))
        best = np.arange(len(row)) - first[row] < k
        out.append((lo + row[best], cid[col[best]], sims[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "vec", k: int = 5, dim: int = 64, bucket: int = BUCKET, piece: int = PIECE, sample: int = SAMPLE, keep: int = KEEP) -> DataFrame:
    """(id, neighbour, cosine, rank) of the k nearest of every usable vector, ties to the smaller id.

    Unusable vectors (null, wrong length, null or NaN components, all zero) are on neither side.  An id that comes
    twice with different vectors takes part with each.  Fewer than k other vectors give fewer rows, an empty
    table none.  Extra columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    vecs = usable(df, id_col, vec_col, dim)
    length, m = plan(df.count(), bucket)
    rows = vecs.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    x = np.array([np.asarray(v) for v in rows["vec"]], dtype=float).reshape(len(rows), dim)
    x /= np.maximum(1e-300, np.linalg.norm(x, axis=1, keepdims=True))
    bits = max(BITS, m * length)
    model = spark.sparkContext.broadcast(learn_rotations(x, bits))
    words = -(-bits // 64)
    # components travel in their own width and become unit vectors in doubles where they are compared
    kind = np.dtype("<f4" if vecs.schema["vec"].dataType.simpleString() == "array<float>" else "<f8")

    def encode(batches):
        mean, projection = model.value
        powers = 1 << np.arange(length, dtype=np.int64)
        for b in batches:
            if not len(b):
                continue
            raw = np.array(b["vec"].tolist(), dtype=kind).reshape(len(b), dim)
            v = to_units(raw)
            on = (v - mean) @ projection > 0
            code = np.zeros((len(b), 8 * words), dtype=np.uint8)
            packed = np.packbits(on, axis=1)
            code[:, : packed.shape[1]] = packed
            subs = (on[:, : m * length].reshape(len(b), m, length) * powers).sum(2)
            flat = np.round(v, DIGITS - 1) + 0.0
            yield pd.DataFrame({"id": b["id"], "raw": [r.tobytes() for r in raw], "code": [r.tobytes() for r in code], "subs": list(subs), "direction": [r.tobytes() for r in flat]})

    coded = vecs.mapInPandas(encode, "id long, raw binary, code binary, subs array<long>, direction binary")
    coded = written(coded.withColumn("class", F.xxhash64("direction")).drop("direction"), "codes")
    # of rows with one direction only the k + 1 smallest ids can be anyone's neighbours
    sizes = coded.groupBy("class").agg(F.count(F.lit(1)).alias("rows"))
    plural = sizes.filter("rows > 1")
    doubled = coded.join(plural.select("class"), "class")
    rank = F.row_number().over(W.partitionBy("class").orderBy("id"))
    # the filter right behind the number lets each partition keep k + 1 rows of a class before the shuffle
    first = written(doubled.withColumn("rk", rank).filter(F.col("rk") <= k + 1), "firsts")
    cols = ["id", "raw", "code", "subs"]
    heads = coded.join(plural, "class", "left_anti").select(*cols).unionByName(first.select(*cols))
    index = heads.select("id", "raw", "code", F.posexplode("subs").alias("j", "v"))
    # only buckets beyond a piece are named; written first, so that the join is planned by their real number
    counts = heads.select(F.posexplode("subs").alias("j", "v")).groupBy("j", "v").agg(F.count(F.lit(1)).alias("n"))
    crowded = written(counts.filter(F.col("n") > piece).select("j", "v", F.ceil(F.col("n") / piece).cast("int").alias("pieces")), "crowded")
    placed = index.join(crowded, ["j", "v"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    # a task is a pair of pieces of one bucket, which ask each other; a bucket of one piece is its own pair
    side = F.when(F.col("piece") == F.col("x"), _SELF).when(F.col("piece") < F.col("x"), _FIRST).otherwise(_SECOND)
    work = placed.select("j", "v", F.least("piece", "x").alias("a"), F.greatest("piece", "x").alias("b"), "id", "raw", "code", side.alias("side"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        unit = to_units(np.frombuffer(b"".join(g["raw"]), dtype=kind).reshape(len(g), dim))
        code = np.frombuffer(b"".join(g["code"]), dtype=np.uint64).reshape(len(g), words)
        ids, s = g["id"].to_numpy(), g["side"].to_numpy()
        out = []
        for asks, holds in ((_SELF, _SELF), (_FIRST, _SECOND), (_SECOND, _FIRST)):
            q, c = s == asks, s == holds
            if q.any() and c.any():
                row, near, sims = _top(unit[q], ids[q], code[q], unit[c], ids[c], code[c], k, keep)
                out.append(pd.DataFrame({"id": ids[q][row], "neighbour": near, "cosine": sims}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "neighbour": [], "cosine": []}, dtype=object)

    found = work.groupBy("j", "v", "a", "b").applyInPandas(compare, "id long, neighbour long, cosine double")
    # at most k from each substring and piece; one shuffle by id serves both steps
    pairs = found.repartition("id").groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine"))
    order = [F.desc("cosine"), "neighbour"]
    best = pairs.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(*order))).filter(F.col("rank") <= k)
    # rows of a class beyond its first k + 1 have the first k of the class
    rest = doubled.select("id", "class").join(first.select("id"), "id", "left_anti")
    firsts = first.filter(F.col("rk") <= k).select("class", F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine"), F.col("rk").cast("int").alias("rank"))
    return best.unionByName(rest.join(firsts, "class").select("id", "neighbour", "cosine", "rank"))
