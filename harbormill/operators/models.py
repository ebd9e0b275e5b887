"""Scoring models over graph states and item features, and their training.

Start weights are a function of md5, so a score is the same on every cluster and SQL
can compute it too.  Trained weights replace them through the same tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbormill.operators.graph import propagate
from harbormill.operators.split import dense_index
from harbormill.session import ship, written


def hash_weight(salt: str, *parts: Column | str) -> Column:
    """A weight in [-0.1, 0.1] from md5 of salt and parts."""
    text = F.concat_ws("|", F.lit(salt), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(20001)) - 10000) / 100000.0


def hash_states(pairs: DataFrame, dims: int, salt: str) -> DataFrame:
    """(node, d, x) for the users and items of the pairs, as ``u|..`` and ``i|..``."""
    nodes = pairs.select(F.concat(F.lit("u|"), "u").alias("node")).union(pairs.select(F.concat(F.lit("i|"), "i").alias("node"))).distinct()
    return nodes.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(dims - 1)))).withColumn("x", hash_weight(salt, F.col("node"), F.col("d").cast("string")))


def to_vectors(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((u, vec), (i, vec)) of node states; written once, since rankings count and read them several times."""
    v = states.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vec"))
    v = written(v, "vectors")
    split = lambda side: v.filter(F.substring("node", 1, 2) == f"{side}|").select(F.expr("substring(node, 3)").alias(side), "vec")
    return split("u"), split("i")


def light_vectors(pairs: DataFrame, dims: int = 8, layers: int = 2, salt: str = "light") -> tuple[DataFrame, DataFrame]:
    """User and item vectors after propagation; their dot product is the score."""
    return to_vectors(propagate(pairs, hash_states(pairs, dims, salt), layers))


def projected(features: DataFrame, key: str, dims: int, salt: str, source_dims: int) -> DataFrame:
    """(key, vec): features times a weight matrix of md5 weights, row by row in the JVM."""
    rows = [[(int.from_bytes(_md5(f"{salt}|{d}|{s}")[:4], "big") % 20001 - 10000) / 100000.0 for s in range(source_dims)] for d in range(dims)]
    cell = lambda r: F.aggregate(F.zip_with("vec", F.array(*[F.lit(x) for x in r]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return features.select(key, F.array(*[cell(r) for r in rows]).alias("vec"))


def _md5(text: str) -> bytes:
    import hashlib

    return hashlib.md5(text.encode()).digest()


def add_vectors(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Element-wise sum; a key without a vector in ``b`` keeps its own."""
    j = a.join(b.select(key, F.col("vec").alias("__o")), key, "left")
    return j.select(key, F.when(F.col("__o").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "__o", lambda x, y: x + y)).alias("vec"))


def concat_vectors(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Vectors one behind the other; a key missing in ``b`` gets zeros."""
    j = a.join(b.select(key, F.col("vec").alias("__o")), key, "left")
    return j.select(key, F.concat("vec", F.coalesce("__o", F.array_repeat(F.lit(0.0), width))).alias("vec"))


def text_model(pairs: DataFrame, text: DataFrame, text_dims: int, dims: int = 8) -> tuple[DataFrame, DataFrame]:
    """Propagated user against propagated item plus projected text."""
    u, i = light_vectors(pairs, dims, salt="text")
    return u, add_vectors(i, projected(text, "i", dims, "text-proj", text_dims), "i")


def visual_model(pairs: DataFrame, visual: DataFrame, visual_dims: int, dims: int = 8) -> tuple[DataFrame, DataFrame]:
    """g_u.g_i + t_u.(E v_i) + b_i + b.v_i; items carry their bias in its own column."""
    u, i = to_vectors(hash_states(pairs, 2 * dims, "visual"))
    i = i.select("i", F.slice("vec", 1, dims).alias("vec"))
    i = concat_vectors(i, projected(visual, "i", dims, "visual-e", visual_dims), "i", dims)
    b = projected(visual, "i", 1, "visual-b", visual_dims).select("i", F.col("vec")[0].alias("bv"))
    i = i.join(b, "i", "left").select("i", "vec", (hash_weight("visual-bias", F.col("i")) + F.coalesce("bv", F.lit(0.0))).alias("bias"))
    return u, i


def two_branch_model(pairs: DataFrame, features: dict[str, tuple[DataFrame, int]], dims: int = 8) -> tuple[DataFrame, DataFrame]:
    """Sum over modalities of user times item, each propagated over the graph on its own."""
    out = None
    for name, (table, width) in features.items():
        start = hash_states(pairs, dims, f"branch-{name}")
        feats = projected(table, "i", dims, f"branch-{name}-proj", width).select(F.concat(F.lit("i|"), "i").alias("node"), F.posexplode("vec").alias("d", "x"))
        both = start.unionByName(feats.join(start.select("node").distinct(), "node", "left_semi")).groupBy("node", "d").agg(F.sum("x").alias("x"))
        u, i = to_vectors(propagate(pairs, both, 2))
        out = (u, i) if out is None else (concat_vectors(out[0], u, "u", dims), concat_vectors(out[1], i, "i", dims))
    return out


def summed_model(pairs: DataFrame, features: dict[str, tuple[DataFrame, int]], dims: int = 8) -> tuple[DataFrame, DataFrame]:
    """Propagated user against propagated item plus all projected modalities."""
    u, i = light_vectors(pairs, dims, salt="summed")
    for name, (table, width) in features.items():
        i = add_vectors(i, projected(table, "i", dims, f"summed-{name}", width), "i")
    return u, i


def mean_branch_model(pairs: DataFrame, features: dict[str, tuple[DataFrame, int]], dims: int = 8, layers: int = 3) -> tuple[DataFrame, DataFrame]:
    """Mean over modalities of branches that average neighbours: leaky activation, a learned map added to the id state, layer by layer.

    Every layer is one join with the edges and one average by (node, dimension); the small map runs on whole
    vectors in the JVM.
    """
    from harbormill.operators.graph import mean_neighbours

    p = pairs.select("u", "i").distinct()
    u, i = F.concat(F.lit("u|"), "u"), F.concat(F.lit("i|"), "i")
    edges = written(p.select(u.alias("src"), i.alias("dst")).union(p.select(i.alias("src"), u.alias("dst"))), "edges")
    leaky = lambda c: F.when(c > 0, c).otherwise(0.01 * c)
    out = None
    for name, (table, width) in features.items():
        ids = written(hash_states(p, dims, f"mean-{name}-id"), "ids")
        pref = hash_states(p, dims, f"mean-{name}").filter("node like 'u|%'")
        feat = projected(table, "i", dims, f"mean-{name}-proj", width).select(F.concat(F.lit("i|"), "i").alias("node"), F.posexplode("vec").alias("d", "x"))
        x = written(pref.unionByName(feat), "state")
        for layer in range(layers):
            h = mean_neighbours(edges, x).select(F.col("dst").alias("node"), "d", leaky(F.col("x")).alias("x"))
            vec = lambda t: t.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda c: c["x"]).alias("vec"))
            mapped = projected(vec(x), "node", dims, f"mean-{name}-w{layer}", dims).select("node", F.posexplode("vec").alias("d", "m"))
            hat = ids.withColumnRenamed("x", "e").join(mapped, ["node", "d"], "left").join(h, ["node", "d"], "left")
            z = F.coalesce("x", F.lit(0.0)) + leaky(F.coalesce("m", F.lit(0.0))) + F.col("e")
            x = written(hat.select("node", "d", leaky(z).alias("x")), "state")
        out = x if out is None else out.unionByName(x)
    return to_vectors(out.groupBy("node", "d").agg((F.sum("x") / len(features)).alias("x")))


def predicted_model(pairs: DataFrame, dims: int = 8, layers: int = 2, salt: str = "predict") -> tuple[DataFrame, DataFrame]:
    """A shared linear predictor over propagated users and over propagated items plus their id state."""
    start = hash_states(pairs, dims, salt)
    u, i = to_vectors(propagate(pairs, start, layers))
    _, own = to_vectors(start)
    i = add_vectors(i, own, "i")
    return projected(u, "u", dims, f"{salt}-w", dims), projected(i, "i", dims, f"{salt}-w", dims)


def pair_scores(pairs: DataFrame, users: DataFrame, items: DataFrame, digits: int = 6) -> DataFrame:
    """(u, i, score) of given pairs by the vectors' dot product."""
    j = pairs.join(users.select("u", F.col("vec").alias("uv")), "u").join(items.select("i", F.col("vec").alias("iv")), "i")
    score = F.aggregate(F.zip_with("uv", "iv", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    return j.select("u", "i", F.round(score, digits).alias("score"))


def spectral_fusion(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filtered signals of two modalities and of their product in the frequency domain (orthonormal real FFT)."""
    fa, fb = np.fft.rfft(a, axis=1, norm="ortho"), np.fft.rfft(b, axis=1, norm="ortho")
    n = a.shape[1]
    back = lambda x: np.fft.irfft(x, n=n, axis=1, norm="ortho")
    return back(fa * wa), back(fb * wb), back((fa * wa) * (fb * wb))


def spectral_items(text: DataFrame, visual: DataFrame, salt: str = "spectral") -> DataFrame:
    """(i, vec): mean of the two filtered modalities plus their fusion, each through a sigmoid gate of itself.

    ``text`` and ``visual`` are (i, vec) of one width.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, y = np.array(b["vec"].tolist(), float), np.array(b["other"].tolist(), float)
            rng = np.random.default_rng(int.from_bytes(_md5(salt)[:4], "big"))
            m = x.shape[1] // 2 + 1
            wa, wb = (rng.normal(size=m) + 1j * rng.normal(size=m) for _ in range(2))
            parts = spectral_fusion(x, y, wa, wb)
            gate = lambda z: z / (1 + np.exp(-z))
            out = (gate(parts[0]) + gate(parts[1])) / 2 + gate(parts[2])
            yield pd.DataFrame({"i": b["i"], "vec": list(out)})

    ship(text.sparkSession)
    return text.join(visual.select("i", F.col("vec").alias("other")), "i").mapInPandas(run, "i string, vec array<double>")


def attend(query: np.ndarray, tokens: np.ndarray, mask: np.ndarray, heads: int) -> np.ndarray:
    """Multi-head attention of one query a row over its tokens; rows without tokens give zeros."""
    n, t, d = tokens.shape
    q, k = query.reshape(n, heads, 1, d // heads), tokens.reshape(n, t, heads, d // heads).transpose(0, 2, 1, 3)
    s = (q @ k.transpose(0, 1, 3, 2))[:, :, 0] / np.sqrt(d // heads)
    s = np.where(mask[:, None], s, -1e30)
    w = np.exp(s - s.max(2, keepdims=True)) * mask[:, None]
    w /= np.maximum(w.sum(2, keepdims=True), 1e-12)
    return (w[:, :, None] @ k)[:, :, 0].reshape(n, d)


class GatedScorer:
    """Two propagated graphs, attention of the item's text and of the user over the item's images, an element-wise gate
    between both contexts, a small residual, and (``evidence``) a scalar gate of the pair's evidence on the context.

    Evidence is (history, popularity, availability, coherence) in this order.
    """

    def __init__(self, dims: int, heads: int = 4, seed: int = 42, evidence: bool = True):
        rng = np.random.default_rng(seed)
        w = lambda *s: rng.normal(scale=1 / np.sqrt(s[0]), size=s)
        self.dims, self.heads, self.evidence = dims, heads, evidence
        self.gate, self.cross, self.fuse, self.user = w(4 * dims, dims), w(2 * dims, dims), w(3 * dims, dims), w(2 * dims, dims)
        self.enc1, self.enc2, self.g1, self.g2 = w(4, 64), w(64, dims), w(3 * dims, 128), w(128, 1)
        self.alpha = 0.1

    def score(self, tu, vu, ti, vi, images, mask, ev) -> tuple[np.ndarray, np.ndarray]:
        """(scores, evidence gates) of pairs; arrays have a row per pair."""
        sig = lambda x: 1 / (1 + np.exp(-x))
        relu = lambda x: np.maximum(x, 0)
        text_ctx, user_ctx = attend(ti, images, mask, self.heads), attend(vu, images, mask, self.heads)
        cross = np.tanh(np.concatenate([ti, text_ctx], 1) @ self.cross)
        g = sig(np.concatenate([tu, vu, ti, vi], 1) @ self.gate)
        context = g * user_ctx + (1 - g) * text_ctx
        q = np.ones(len(ti))
        if self.evidence:
            enc = relu(relu(ev @ self.enc1) @ self.enc2)
            q = sig(relu(np.concatenate([vu, vi, enc], 1) @ self.g1) @ self.g2)[:, 0]
            context = context * q[:, None]
        item = ti + np.tanh(self.alpha) * (np.concatenate([context, cross, vu], 1) @ self.fuse)
        user = np.concatenate([tu, vu], 1) @ self.user
        return (user * item).sum(1), q


def gated_scores(pairs: DataFrame, scorer: GatedScorer, slots: int = 32) -> DataFrame:
    """(u, i, score, gate) for pairs with tu, vu, ti, vi, images (array of vectors) and ev columns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            m = lambda c: np.array(b[c].tolist(), float)
            images, mask = np.zeros((len(b), slots, scorer.dims)), np.zeros((len(b), slots), bool)
            for r, x in enumerate(b["images"]):
                x = [] if x is None else list(x)[:slots]
                if x:
                    images[r, : len(x)] = np.array([np.asarray(v, float) for v in x])
                    mask[r, : len(x)] = True
            s, q = scorer.score(m("tu"), m("vu"), m("ti"), m("vi"), images, mask, m("ev"))
            yield pd.DataFrame({"u": b["u"], "i": b["i"], "score": s, "gate": q})

    ship(pairs.sparkSession)
    return pairs.select("u", "i", "tu", "vu", "ti", "vi", "images", "ev").mapInPandas(run, "u string, i string, score double, gate double")


def _whole_users(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[str, list[str]]]]:
    """(user, items) of rows sorted by user, also where a user's rows go over the edge of a batch."""
    held: tuple[str, list[str]] | None = None
    for b in batches:
        done = []
        for u, i in zip(b["u"], b["i"]):
            if held is not None and held[0] == u:
                held[1].append(i)
                continue
            if held is not None:
                done.append(held)
            held = (u, [i])
        yield done
    if held is not None:
        yield [held]


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """64 random bits for whole numbers, a function of these alone (splitmix64 over one after another)."""
    out = np.zeros(1, np.uint64)
    for p in parts:
        z = (out ^ np.asarray(p).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out = z ^ (z >> np.uint64(31))
    return out


def _normals(seed: int, users: np.ndarray, dims: int) -> np.ndarray:
    """A row of standard normal numbers for each user (Box and Muller)."""
    cell = users[:, None], np.arange(dims)[None]
    a, b = (((_mixed(seed, salt, *cell) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53 for salt in (0, 1))
    return np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)


def _draws(users: np.ndarray, sizes: np.ndarray, mine: np.ndarray, passes: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(positives, negatives) of every pass, a row each: the items ``mine`` of each user, user by user, in an order
    that is new in each pass, and for each an unseen one of ``n`` items.  No user may have seen all."""
    own = np.repeat(np.arange(len(users)), sizes)
    who, at = users[own], np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seen = np.sort(own * n + mine)
    js, ks = np.empty((passes, len(own)), np.int64), np.empty((passes, len(own)), np.int64)
    for c in range(passes):
        js[c] = mine[np.lexsort((_mixed(seed, 2, who, c, mine), own))]
        left, attempt = np.arange(len(own)), 0
        while len(left):
            k = (_mixed(seed, 3, who[left], c, at[left], attempt) % np.uint64(n)).astype(np.int64)
            ks[c, left] = k
            code = own[left] * n + k
            left, attempt = left[seen[np.minimum(np.searchsorted(seen, code), len(seen) - 1)] == code], attempt + 1
    return js, ks


def _user_steps(p: np.ndarray, v: np.ndarray, sizes: np.ndarray, js: np.ndarray, ks: np.ndarray, rate: float, decay: float) -> None:
    """Takes the steps of the users' vectors ``p`` against items held fast: all users side by side, each through its own draws one after another."""
    start, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
    longest = sizes[order]
    for c in range(len(js)):
        for t in range(int(longest[0])):
            on = order[: int(np.searchsorted(-longest, -t))]  # those with more than t items
            d, q = v[js[c, start[on] + t]] - v[ks[c, start[on] + t]], p[on]
            g = 1 / (1 + np.exp(np.minimum((q * d).sum(1), 700)))
            p[on] = q + rate * (g[:, None] * d - decay * q)


def _item_steps(p: np.ndarray, v: list[np.ndarray], sizes: np.ndarray, js: np.ndarray, ks: np.ndarray, rate: float, decay: float) -> None:
    """Takes the steps of users and items one after another, in place; ``v`` holds the rows of the items' matrix."""
    keep, lo = 1 - rate * decay, 0
    for q, n in zip(p, sizes.tolist()):
        for own, other in zip(js[:, lo : lo + n].ravel().tolist(), ks[:, lo : lo + n].ravel().tolist()):
            x, y = v[own], v[other]
            d = x - y
            g = rate / (1 + math.exp(min(q.dot(d), 700.0)))
            dj = g * q
            d *= g
            q *= keep
            q += d
            x *= keep
            x += dj
            y *= keep
            y -= dj
        lo += n


def train_pairwise(train: DataFrame, dims: int = 16, rounds: int = 4, rate: float = 0.05, decay: float = 1e-4, seed: int = 42, parts: int = 8) -> tuple[DataFrame, DataFrame]:
    """((u, vec), (i, vec)) of a factor model trained by Bayesian personalised ranking.

    Users are partitioned and their vectors never leave their task.  Item vectors, bounded by the catalogue, go to
    every task; after each round each task returns its item vectors with the number of updates, and
    their weighted mean starts the next round.  One negative is drawn for each positive, from unseen items.
    Draws and start vectors are a function of the seed and the user, so they don't depend on who else is in a task.
    """
    spark = train.sparkSession
    distinct = written(train.select("u", "i").distinct(), "pairs")
    parts = max(parts, -(-distinct.count() // 250_000))
    index = written(dense_index(distinct, "i"), "index")
    n_items = index.count()
    numbers = distinct.join(index.withColumnRenamed("id", "i"), "i").select("u", F.col("idx").alias("i"))
    users = written(numbers.withColumn("part", F.pmod(F.xxhash64("u"), F.lit(parts)).cast("int")), "bpr")
    items = np.random.default_rng(seed).normal(scale=0.1, size=(n_items, dims))

    def run_round(sent, no: int, final: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            v = sent.value if final else sent.value.copy()
            rows, n = list(v), np.zeros(len(v))
            for group in _whole_users(batches):
                group = [(u, own) for u, own in group if len(own) < len(v)]
                if not group:
                    continue
                who = np.array([int.from_bytes(_md5(str(u))[:8], "big") for u, _ in group], np.uint64)
                sizes = np.array([len(own) for _, own in group])
                js, ks = _draws(who, sizes, np.array([i for _, own in group for i in own], np.int64), no + 1, len(v), seed)
                # a user's vector is found anew from its own seed in each round, against the current items
                p = 0.1 * _normals(seed, who, dims)
                if final:
                    _user_steps(p, v, sizes, js, ks, rate, decay)
                    yield pd.DataFrame({"u": [u for u, _ in group], "vec": list(p)})
                else:
                    _item_steps(p, rows, sizes, js, ks, rate, decay)
                    n += np.bincount(np.concatenate([js.ravel(), ks.ravel()]), minlength=len(v))
            hit = np.flatnonzero(n)
            if len(hit):
                yield pd.DataFrame({"i": hit, "n": n[hit], "vec": list(v[hit] * n[hit, None])})

        return run

    def by_user() -> DataFrame:
        return users.repartition(parts, "part").sortWithinPartitions("u", "i")

    for no in range(rounds):
        sent = spark.sparkContext.broadcast(items)
        out = by_user().mapInPandas(run_round(sent, no, False), "i int, n double, vec array<double>")
        sums = out.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col("vec")[d]).alias(f"d{d}") for d in range(dims)]).toArrow().to_pandas()
        items = items.copy()
        items[sums["i"]] = sums[[f"d{d}" for d in range(dims)]].to_numpy() / sums[["n"]].to_numpy()
        sent.unpersist()
    sent = spark.sparkContext.broadcast(items)
    user_vecs = by_user().mapInPandas(run_round(sent, rounds - 1, True), "u string, vec array<double>")

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"i": b["id"], "vec": list(sent.value[b["idx"].to_numpy()])})

    return written(user_vecs, "users"), written(index.mapInPandas(named, "i string, vec array<double>"), "items")


#: English words that a text vector leaves out.
STOP_WORDS = "a an and are as at be but by for from had has have he her his i in is it its my no not of on or our she so that the their them then there they this to too very was we were what when which while who will with you your".split()


def tfidf_vectors(texts: DataFrame, key: str, text: str, vocabulary: int = 20_000, dims: int = 32, passes: int = 2, seed: int = 42) -> DataFrame:
    """(key, vec): smoothed TF-IDF of unit length, reduced to ``dims`` by a truncated SVD, and normalised again.

    A key's texts may stand in many rows; their words are counted together and the texts never meet.

    idf is ln((1 + n) / (1 + df)) + 1 over the ``vocabulary`` most frequent words.  The SVD is a randomised range
    finder: each pass sends a (vocabulary x dims) matrix to the rows and adds up their answers, so rows stay
    distributed and only matrices bounded by the vocabulary reach the driver.  A key without known words gets zeros.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    tokens = rows.select("key", F.explode(F.filter(F.split("t", r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))).alias("w"))
    counts = written(tokens.groupBy("key", "w").agg(F.count(F.lit(1)).alias("tf")), "words")
    keys = rows.select("key").distinct()
    n = keys.count()
    terms = counts.groupBy("w").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("all")).orderBy(F.desc("all"), "w").limit(vocabulary)
    known = terms.toPandas().sort_values("w").reset_index(drop=True)
    known["idf"] = np.log((1 + n) / (1 + known["df"])) + 1
    lut = spark.createDataFrame([(w, k, float(x)) for k, (w, x) in enumerate(zip(known["w"], known["idf"]))], "w string, k int, idf double")
    cells = counts.join(lut, "w").select("key", "k", (F.col("tf") * F.col("idf")).alias("x"))
    docs = cells.groupBy("key").agg(F.collect_list(F.struct("k", "x")).alias("c"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    docs = written(docs.select("key", F.transform("c", lambda s: s["k"]).alias("k"), F.transform("c", lambda s: s["x"] / F.col("l")).alias("x")), "tfidf")
    width = min(dims + 8, len(known))
    base = np.random.default_rng(seed).normal(size=(len(known), width))

    def gather(sent):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(sent.value)
            for b in batches:
                for k, x in zip(b["k"], b["x"]):
                    total[k] += np.asarray(x)[:, None] * (np.asarray(x) @ sent.value[k])[None]
            hit = np.flatnonzero(total.any(1))
            if len(hit):
                yield pd.DataFrame({"k": hit, "v": list(total[hit])})

        return run

    for _ in range(passes + 1):
        base, _r = np.linalg.qr(base)
        sent = spark.sparkContext.broadcast(base)
        parts = docs.select("k", "x").mapInPandas(gather(sent), "k int, v array<double>")
        sums = parts.groupBy("k").agg(*[F.sum(F.col("v")[j]).alias(f"c{j}") for j in range(width)]).toPandas()
        new = np.zeros_like(base)
        new[sums["k"].to_numpy()] = sums[[f"c{j}" for j in range(width)]].to_numpy()
        gram, base = base.T @ new, new if _ < passes else base
    # directions of the reduced matrix in order of their strength
    _, turn = np.linalg.eigh((gram + gram.T) / 2)
    sent = spark.sparkContext.broadcast((base @ turn)[:, ::-1][:, :dims])

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [np.asarray(x) @ sent.value[k] for k, x in zip(b["k"], b["x"])]
            yield pd.DataFrame({"key": b["key"], "vec": [v / max(float(np.linalg.norm(v)), 1e-12) for v in out]})

    kind = rows.schema["key"].dataType.simpleString()
    reduced = docs.mapInPandas(reduce, f"key {kind}, vec array<double>")
    zeros = F.array_repeat(F.lit(0.0), min(dims, width))
    return keys.join(reduced, "key", "left").select(F.col("key").alias(key), F.coalesce("vec", zeros).alias("vec"))


def make_model(name: str, pairs: DataFrame, features: dict[str, tuple[DataFrame, int]], dims: int = 8) -> tuple[DataFrame, DataFrame]:
    """Users and items of the named model; ``features`` holds the text and visual item tables with their widths."""
    text, visual = features.get("text"), features.get("visual")
    build = {
        "light": lambda: light_vectors(pairs, dims),
        "text": lambda: text_model(pairs, *text, dims),
        "visual": lambda: visual_model(pairs, *visual, dims),
        "two_branch": lambda: two_branch_model(pairs, features, dims),
        "mean_branch": lambda: mean_branch_model(pairs, features, dims),
        "summed": lambda: summed_model(pairs, features, dims),
        "predicted": lambda: predicted_model(pairs, dims),
        "pairwise": lambda: train_pairwise(pairs, dims),
    }
    if name not in build:
        raise ValueError(f"unknown model {name}")
    return build[name]()
