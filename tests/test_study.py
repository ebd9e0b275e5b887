"""Operators of the study: hand-computed values and brute force on small frames."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harbormill.functions import ids, names, numeric, vectors
from harbormill.operators import audit, evidence, graph, interactions, joins, models, rank, sampling, split, stats, tuning
from harbormill.plans import study
from harbormill.sources import readers


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,want", [("The St. Regis Hotel & Spa", "saint regis and spa"), ("Hotel 7 / B", "7"), (None, ""), ("Café Élan", "caf lan"), ("", ""), ("Inn of Court LLC", "court")])
def test_core_name(spark, text, want):
    assert one(spark, names.core_name, text) == want


@pytest.mark.parametrize("url,want", [("/Hotel_Review-g1-d2-Reviews-Sea_View_Inn-Nice.html", ("Sea View Inn", "Nice")), ("/no-marker.html", ("", "")), (None, ("", "")), ("x-Reviews-Only.htm", ("Only", ""))])
def test_slug(spark, url, want):
    assert tuple(one(spark, names.parse_slug, url)) == want


@pytest.mark.parametrize("v,want", [(" 123.0", "123"), ("123", "123"), ("123.5", "123.5"), ("", None), (None, None), ("a.0", "a.0")])
def test_clean_id(spark, v, want):
    assert one(spark, ids.clean_id, v) == want


def test_invalid_users(spark):
    for bad in (" /Undefined ", "NaN", "", None, "null"):
        assert one(spark, ids.is_invalid_user, bad) is True
    assert one(spark, ids.is_invalid_user, "u1") is False


def test_nan_never_passes_a_threshold(spark):
    df = spark.createDataFrame([("u", "i", r) for r in (float("nan"), None, 3.999, 4.0, 5.0)], "u string, i string, rating double")
    assert sorted(r["rating"] for r in interactions.positives(df).collect()) == [4.0, 5.0]


def test_min_max_and_keep_count(spark):
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert {r["y"] for r in numeric.min_max(flat, "x", "y").collect()} == {0.0}
    for n, f, want in ((5, 0.5, 2), (1, 0.75, 1), (4, 0.25, 3), (3, 0.0, 3)):
        assert one(spark, lambda c, f=f: numeric.keep_count(c, f), n, "int") == want
    for v, want in ((float("nan"), 0.0), (float("inf"), 1.0), (float("-inf"), 0.0), (None, 0.0), (0.5, 0.5)):
        assert one(spark, numeric.finite, v, "double") == want


def test_pairs_texts_and_core(spark):
    rows = [("u", "i", 3.0, "good", 2), ("u", "i", float("nan"), "nan", 1), ("u", "i", 5.0, "", 3), ("u", "i", 4.0, "bad", 4), (None, "i", 4.0, "x", 5)]
    df = spark.createDataFrame(rows, "user string, item string, rating double, text string, row_id long")
    r = interactions.aggregate_pairs(df, F.col("user"), F.col("item"), F.col("text"), "row_id").collect()
    assert [(x["n_rows"], x["max_rating"], x["first_row"], x["text"]) for x in r] == [(4, 5.0, 1, "good bad")]
    p = spark.createDataFrame([(f"u{k}", "five") for k in range(5)] + [(f"u{k}", "four") for k in range(4)], "u string, i string")
    assert {x["i"] for x in interactions.item_core(p, 5).collect()} == {"five"}
    assert interactions.dense_pairs(p, 2).count() == 8


def test_one_to_one_resolution(spark, rows):
    a = spark.createDataFrame([("a1", "Hotel Sun"), ("a2", "Moon"), ("a3", "The Moon"), ("a4", None)], "a string, n string")
    b = spark.createDataFrame([("b1", "Sun Resort"), ("b2", "Moon"), ("b1", "Sun")], "b string, m string")
    assert rows(interactions.resolve_one_to_one(a, "a", F.col("n"), b, "b", F.col("m"))) == [("sun", "a1", "b1")]


@pytest.mark.parametrize("n,want", [(1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (9, (7, 1, 1)), (20, (16, 2, 2)), (392, (314, 39, 39))])
def test_split_sizes(spark, n, want):
    p = spark.createDataFrame([("u", f"i{k}") for k in range(n)], "u string, i string")
    c = Counter(r["split"] for r in split.user_split(p).collect())
    assert (c["train"], c["val"], c["test"]) == want


def test_dense_index(spark):
    vals = [f"k{random.Random(k).random()}" for k in range(500)]
    df = spark.createDataFrame([(v,) for v in vals + vals[:50] + [None]], "x string")
    got = {r["id"]: r["idx"] for r in split.dense_index(df, "x").collect()}
    assert got == {v: k for k, v in enumerate(sorted(vals))}
    assert audit.index_faults(split.dense_index(df, "x")).count() == 0
    bad = spark.createDataFrame([("a", 0), ("a", 1), ("b", 5)], "id string, idx long")
    assert {r["fault"] for r in audit.index_faults(bad).collect()} == {"double_ids", "gap"}


def test_audits_find_seeded_faults(spark):
    s = spark.createDataFrame([("u", "i", "train"), ("u", "i", "test"), ("v", "j", "val"), ("u", "k", "train"), ("u", "k", "train")], "u string, i string, split string")
    assert audit.overlaps(s).count() == 1 and audit.duplicates(s).count() == 1 and audit.held_out_seen(s).count() == 1
    assert {r["id"] for r in audit.cold(s, "u").collect()} == {"v"} and {r["id"] for r in audit.cold(s, "i").collect()} == {"j"}
    r = spark.createDataFrame([(0.5,), (1.5,), (None,), (float("nan"),)], "x double")
    assert audit.out_of_range(r, ["x"]).count() == 3
    p = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "l string, r string")
    assert [tuple(t) for t in audit.not_one_to_one(p, "l", "r").collect()] == [("l", "a", 2)]
    runs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1)], "m int, s int")
    assert [tuple(t) for t in audit.missing_runs(runs, ["m", "s"]).collect()] == [(2, 2)] and audit.double_runs(runs, ["m", "s"]).count() == 1
    assert [t["id"] for t in audit.unmapped(s, "i", spark.createDataFrame([("i", 0), ("k", 1)], "id string, idx long")).collect()] == ["j"]
    assert interactions.not_functional(p, "l", "r").count() == 1


def test_metrics(spark):
    order = ["5", "3", "9"] + [f"x{k}" for k in range(17)]
    r = spark.createDataFrame([("a", x, k + 1) for k, x in enumerate(order)] + [("b", f"y{k}", k + 1) for k in range(20)], "u string, i string, rank int")
    rel = spark.createDataFrame([("a", "3"), ("a", "9"), ("b", "y10"), ("c", "q"), ("a", "3")], "u string, i string")
    m = {x["u"]: x for x in rank.user_metrics(r, rel).collect()}
    assert m["a"]["ndcg10"] == pytest.approx(0.693426, abs=1e-6) and m["a"]["mrr20"] == 0.5 and m["a"]["n_relevant"] == 2
    assert (m["b"]["hr10"], m["b"]["hr20"]) == (0.0, 1.0) and m["b"]["mrr20"] == pytest.approx(1 / 11)
    assert (m["c"]["hr20"], m["c"]["ndcg20"]) == (0.0, 0.0)
    assert rank.macro(rank.user_metrics(r, rel)).first()["n_users"] == 3


def test_popular_unseen_with_ties_and_a_user_who_saw_all(spark):
    rng = random.Random(1)
    items = [f"i{k:02d}" for k in range(30)]
    train = [(f"u{k}", x) for k in range(8) for x in rng.sample(items, 6)] + [("all", x) for x in items]
    t = spark.createDataFrame(train, "u string, i string")
    c = Counter(i for _, i in train)
    order = sorted(c, key=lambda i: (-c[i], i))
    got = {}
    for r in rank.popular_unseen(t, t, 20).collect():
        got.setdefault(r["u"], {})[r["rank"]] = r["i"]
    for u in {u for u, _ in train}:
        seen = {i for v, i in train if v == u}
        want = [i for i in order if i not in seen][:20]
        assert [got.get(u, {})[k + 1] for k in range(len(want))] == want and len(got.get(u, {})) == len(want)


def images(spark, data):
    return spark.createDataFrame([(i, s, [float(x) for x in v]) for i, s, v in data], "item string, slot int, vec array<double>")


def test_coherence(spark):
    rng = np.random.default_rng(3)
    data = [("a", 0, (1, 0)), ("a", 1, (0, 1)), ("a", 2, (1, 0)), ("one", 0, (1, 1))] + [("r", k, rng.normal(size=2)) for k in range(6)]
    raw = {r["item"]: r["raw"] for r in evidence.coherence_raw(images(spark, data), dim=2).collect()}
    u = [np.array(v) / np.linalg.norm(v) for i, _, v in data if i == "r"]
    want = np.mean([u[i] @ u[j] for i in range(6) for j in range(i)])
    assert raw["a"] == pytest.approx(1 / 3) and raw["one"] == 0.0 and raw["r"] == pytest.approx(want)


def test_image_slots_and_unusable_vectors(spark):
    rows = [("h", s, [1.0] * 4) for s in range(40)] + [("h", 0, None), ("h", 1, [1.0]), ("h", 2, [float("nan")] * 4), ("h", 3, [0.0] * 4), (None, 0, [1.0] * 4)]
    df = spark.createDataFrame(rows, "k string, slot int, vec array<double>")
    im = evidence.item_images(df, F.col("k"), dim=4)
    assert im.count() == 32 and evidence.availability(im).first()["availability"] == 1.0
    assert evidence.pooled(im, "item", dim=4).first()["vec"] == pytest.approx([0.5] * 4)


def test_nearest_items_and_normalisation(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    v[7] = v[3] * 2
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "id long, vec array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    for block in (1000, 17):
        got = {}
        for r in graph.nearest_items(df, "id", "vec", 4, block_rows=block).collect():
            got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
        for k in range(60):
            assert [got[k][j] for j in range(1, 5)] == sorted(range(60), key=lambda j: (-s[k, j], j))[:4]
    e = graph.nearest_items(df, "id", "vec", 4)
    d = e.groupBy("src").agg(F.sum("sim").alias("d")).toPandas().set_index("src")["d"].to_dict()
    for r in graph.normalized(e).join(e, ["src", "dst"]).collect():
        assert r["w"] == pytest.approx(r["sim"] / math.sqrt(max(d[r["src"]], 1e-12)) / math.sqrt(max(d[r["dst"]], 1e-12)))


def test_propagation_equals_matrices(spark):
    pairs = [("a", "x"), ("a", "y"), ("b", "y"), ("c", "z"), ("c", "x"), ("a", "x")]
    df = spark.createDataFrame(pairs, "u string, i string")
    nodes = ["u|a", "u|b", "u|c", "i|x", "i|y", "i|z"]
    m = np.zeros((6, 6))
    for u, i in set(pairs):
        m[nodes.index("u|" + u), nodes.index("i|" + i)] = m[nodes.index("i|" + i), nodes.index("u|" + u)] = 1
    d = 1 / np.sqrt(m.sum(1))
    a = d[:, None] * m * d[None]
    start = models.hash_states(df, 3, "t")
    s0 = np.zeros((6, 3))
    for r in start.collect():
        s0[nodes.index(r["node"]), r["d"]] = r["x"]
    want = (s0 + a @ s0 + a @ a @ s0) / 3
    for r in graph.propagate(df, start, 2).collect():
        assert r["x"] == pytest.approx(want[nodes.index(r["node"]), r["d"]])


def test_score_blocks_mask_seen_items(spark):
    rng = np.random.default_rng(2)
    u, i = rng.normal(size=(9, 4)), rng.normal(size=(25, 4))
    du = spark.createDataFrame([(f"u{k}", [float(x) for x in r]) for k, r in enumerate(u)], "u string, vec array<double>")
    di = spark.createDataFrame([(f"i{k:02d}", [float(x) for x in r]) for k, r in enumerate(i)], "i string, vec array<double>")
    seen = spark.createDataFrame([("u0", "i03"), ("u1", "i00")], "u string, i string")
    s = np.round(u @ i.T, 6)
    s[0, 3] = s[1, 0] = -np.inf
    got = {}
    for r in graph.score_blocks(du, di, 5, seen, block_rows=10).collect():
        got.setdefault(r["u"], {})[r["rank"]] = r["i"]
    for k in range(9):
        assert [got[f"u{k}"][j] for j in range(1, 6)] == [f"i{x:02d}" for x in sorted(range(25), key=lambda x: (-s[k, x], x))[:5]]


def test_negatives_end_and_are_unseen(spark):
    pos = spark.createDataFrame([("u", "i0"), ("v", "i0"), ("v", "i1"), ("v", "i2")], "u string, i string")
    cat = spark.createDataFrame([(f"i{k}", k) for k in range(3)], "id string, idx long")
    n = sampling.negatives(pos, pos, cat, 4, "s").collect()
    assert {r["u"] for r in n} == {"u"} and all(r["negative"] != "i0" for r in n) and len(n) >= 3


def test_users_who_have_seen_nearly_everything_get_all_their_negatives(spark):
    cat = spark.createDataFrame([(f"i{k:03d}", k) for k in range(200)], "id string, idx long")
    of = {"u": set(range(200)) - {0, 7, 100, 199}, "v": set(range(180)), "w": {3}, "x": set(range(1, 200)), "y": set(range(200))}
    pos = spark.createDataFrame([(u, f"i{k:03d}") for u, s in of.items() for k in s], "u string, i string")
    seen = pos.unionByName(spark.createDataFrame([("u", "elsewhere")], "u string, i string"))
    got = sampling.negatives(pos, seen, cat, 4, "s").collect()
    n = Counter((r["u"], r["i"]) for r in got)
    assert n == {(u, f"i{k:03d}"): 4 for u, s in of.items() if u != "y" for k in s}
    drawn = Counter((r["u"], int(r["negative"][1:])) for r in got)
    assert not any(k in of[u] for u, k in drawn)
    for u in ("u", "v"):  # uniform over the unseen items
        free = set(range(200)) - of[u]
        want = 4 * len(of[u]) / len(free)
        assert {k for v, k in drawn if v == u} == free and all(abs(drawn[u, k] - want) < 5 * want**0.5 for k in free)


def test_permutation_and_masks(spark):
    df = spark.createDataFrame([(f"k{k}", float(k % 3)) for k in range(20)], "k string, v double")
    p = sampling.permuted(df, "k", "v", "s")
    assert Counter(r["v"] for r in p.collect()) == Counter(r["v"] for r in df.collect()) and p.select("k").distinct().count() == 20
    im = spark.createDataFrame([(i, s) for i, n in (("a", 5), ("b", 1), ("c", 33)) for s in range(n)], "item string, slot int")
    m = sampling.nested_masks(im, [1, 2], [0.0, 0.5, 0.75])
    c = {(r["seed"], r["level"], r["item"]): r["count"] for r in m.groupBy("seed", "level", "item").count().collect()}
    assert c[1, 0.0, "a"] == 5 and c[1, 0.5, "a"] == 2 and c[2, 0.75, "b"] == 1 and c[1, 0.5, "c"] == 16
    assert audit.not_nested(m).count() == 0
    broken = m.filter("not (level = 0.0 and item = 'a' and slot in (0, 1, 2, 3))")
    assert audit.not_nested(broken).count() > 0


def test_holm(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "test string, p double")
    assert {r["test"]: round(r["adjusted"], 9) for r in stats.holm(t).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06, "d": 0.02}


def test_quartiles_and_sd(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (3.0,)], "x double")
    assert sorted(r["quartile"] for r in stats.quartiles(df, "x").collect()) == ["Q2", "Q2", "Q3", "Q4-high"]
    r = spark.createDataFrame([("m", 1.0)], "m string, v double")
    assert stats.seed_summary(r, "m", "v").first()["sd"] == 0.0


def test_spearman_constant_and_ties(spark):
    df = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 2.0), ("h", 1.0, 3.0), ("h", 2.0, 2.0), ("h", 2.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in stats.spearman(df, "x", "y", ["g"]).collect()}
    x = pd.DataFrame({"x": [1, 2, 2], "y": [3, 2, 1]}).rank().corr().iloc[0, 1]
    assert got["g"] is None and got["h"] == pytest.approx(x)


def test_wilcoxon_zero_split(spark):
    d = [1.0, -2.0, 3.0, 0.0, 0.0, 2.0]
    r = stats.wilcoxon(spark.createDataFrame([(x,) for x in d], "diff double")).first()
    rank_ = pd.Series(np.abs(d)).rank()
    plus = sum(k if x > 0 else k / 2 if x == 0 else 0 for x, k in zip(d, rank_))
    assert r["w_plus"] == plus and r["w_plus"] + r["w_minus"] == 21 and r["zeros"] == 2
    none = stats.wilcoxon(spark.createDataFrame([(0.0,)] * 3, "diff double")).first()
    assert none["w_plus"] == none["w_minus"] and stats.two_sided_p(none["z"]) == pytest.approx(1.0)


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0.3, 1, 400)
    r = stats.bootstrap_mean(spark.createDataFrame([(float(v),) for v in x], "diff double"), 600).first()
    half = 1.96 * x.std() / 20
    assert r["lo"] == pytest.approx(x.mean() - half, abs=0.03) and r["hi"] == pytest.approx(x.mean() + half, abs=0.03)


def test_pick_cases_does_not_take_a_row_twice(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "k string, v double")
    assert sorted(r["k"] for r in stats.pick_cases(df, "v", ["k"]).collect()) == ["a", "b", "c"]


def test_bootstrap_queries_run_the_replicates_of_their_operators(spark, monkeypatch):
    rng = np.random.default_rng(5)
    diffs = spark.createDataFrame([(f"u{k}", float(x)) for k, x in enumerate(rng.normal(size=60))], "u string, diff double")
    runs = spark.createDataFrame([("dump_alpha", a, b, 0.75, float(rng.normal())) for a in range(3) for b in range(5)], "model string, model_seed int, corruption_seed int, level double, value double")
    monkeypatch.setattr(study, "_diffs", lambda s, d: diffs)
    monkeypatch.setattr(study, "_runs", lambda s, d: runs)
    pairs = [(study.bootstrap_ci, stats.bootstrap_mean(diffs, 10_000)), (study.hierarchical_bootstrap, stats.hierarchical_bootstrap(runs, "value", replicates=20_000))]
    for query, want in pairs:
        got, want = query(spark, "").first(), want.first()
        assert [got[c] for c in ("mean", "lo", "hi")] == pytest.approx([want[c] for c in ("mean", "lo", "hi")], abs=1e-6)


def test_text_vectors_of_queries_know_rare_words(spark, monkeypatch):
    words = [f"w{k:04d}" for k in range(5200)]
    texts = {"1": " ".join(words[:2600] * 2), "2": " ".join(words[2600:] * 2), "3": "rare words only"}
    tables = {
        "documents": spark.createDataFrame([("h" + k, t) for k, t in texts.items()], "hotel_id string, text string"),
        "item_images_v3": spark.createDataFrame([("h" + k, k) for k in texts], "ta_hotel_id string, img_hotel_id string"),
    }
    monkeypatch.setattr(study, "table", lambda s, d, name: tables[name])
    assert {r["i"]: round(r["norm"], 3) for r in study.tfidf_svd(spark, "").collect()} == {"1": 1.0, "2": 1.0, "3": 1.0}


def test_tfidf_equals_exact_reduction(spark):
    texts = ["sun sea sand", "sun sun hill", "sea sand boat", "hill lake boat", "", None]
    split_up = [(str(k), t) for k, t in enumerate(texts) if k] + [("0", "sun sea"), ("0", "sand")]
    df = spark.createDataFrame(split_up, "k string, t string")
    got = {r["k"]: np.array(r["vec"]) for r in models.tfidf_vectors(df, "k", "t", 100, 3).collect()}
    words = sorted({w for t in texts if t for w in t.split()})
    tf = np.array([[(t or "").split().count(w) for w in words] for t in texts], float)
    x = tf * (np.log(7 / (1 + (tf > 0).sum(0))) + 1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    y = x @ vt[:3].T
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    g = np.stack([got[str(k)] for k in range(6)])
    assert np.allclose(g @ g.T, y @ y.T, atol=1e-6) and not g[4].any() and not g[5].any()


def test_training_beats_chance(spark):
    rng = random.Random(0)
    pairs = [(f"u{k}", f"i{g * 10 + rng.randrange(10)}") for k in range(60) for g in [k % 3] for _ in range(8)]
    df = spark.createDataFrame(pairs, "u string, i string").distinct()
    u, i = models.train_pairwise(df, dims=8, rounds=4, parts=2)
    top = graph.score_blocks(u, i, 3, df).collect()
    same = [int(r["i"][1:]) // 10 == int(r["u"][1:]) % 3 for r in top]
    assert sum(same) > 0.6 * len(same)


def test_users_over_batch_edges_stay_whole():
    rows = [("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("c", "2"), ("c", "3")]
    for size in (1, 2, 4, 6):
        parts = [pd.DataFrame(rows[k : k + size], columns=["u", "i"]) for k in range(0, 6, size)]
        got = [x for g in models._whole_users(iter(parts)) for x in g]
        assert got == [("a", ["1", "2"]), ("b", ["1"]), ("c", ["1", "2", "3"])]


def test_gate_and_attention():
    rng = np.random.default_rng(1)
    q, t = rng.normal(size=(2, 8)), rng.normal(size=(2, 3, 8))
    mask = np.array([[True, False, False], [False] * 3])
    out = models.attend(q, t, mask, 4)
    assert np.allclose(out[0], t[0, 0]) and not out[1].any()
    s, g = models.GatedScorer(8).score(q, q, q, q, t, mask, np.zeros((2, 4)))
    assert ((g > 0) & (g < 1)).all() and np.isfinite(s).all()
    a, b, f = models.spectral_fusion(q, q, np.ones(5), np.ones(5))
    assert np.allclose(a, q) and np.allclose(f, np.fft.irfft(np.fft.rfft(q, axis=1, norm="ortho") ** 2, n=8, axis=1, norm="ortho"))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vectors.unit(F.col("a")).alias("a"), vectors.unit(F.col("b")).alias("b"), vectors.dot(F.col("a"), F.col("a")).alias("d")).first()
    assert r["a"] == pytest.approx([0.6, 0.8]) and r["b"] == [0.0, 0.0] and r["d"] == 25.0


def test_readers(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.csv").write_text("userId,hotel,stars,text\nu1,h1,4.5, fine \nu2,h2,bad,\nx,y\n")
    (tmp_path / "in/deep/b.json").write_text('{"user": "u3", "item": "h3", "overall": 5}\n{broken\n')
    (tmp_path / "in/hotel_info.csv").write_text("id\n1\n")
    found = readers.discover(spark, str(tmp_path / "in"))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.csv", "b.json"]
    good, bad = readers.read_csv_dumps(spark, [str(tmp_path / "in/a.csv")], ["userId", "hotel", "stars", "text"])
    s = readers.standardize(good).collect()
    assert [(r["user_id"], r["rating"], r["review_text"]) for r in s] == [("u1", 4.5, "fine"), ("u2", None, "")] and bad.count() == 1
    good, bad = readers.read_json_dumps(spark, [str(tmp_path / "in/deep/b.json")], ["user", "item", "overall"])
    assert readers.standardize(good).first()["rating"] == 5.0 and bad.count() == 1
    (tmp_path / "img.csv").write_text("1,2,http://x/y,s,t\n")
    assert readers.read_image_lists(spark, str(tmp_path / "img.csv")).first()["hotel_id"] == "2"
    m = spark.createDataFrame([("a", 0)], "id string, idx long")
    readers.write_id_map(m, str(tmp_path / "map"))
    assert readers.read_id_map(spark, str(tmp_path / "map")).collect() == m.collect()
    readers.append_manifest(m, str(tmp_path / "log"))
    readers.append_manifest(m, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    readers.write_single_csv(m, str(tmp_path / "one"))
    assert "0.5000" in readers.latex_table(spark.createDataFrame([(0.5,)], "x double"))
    assert readers.remaining(m, m, "id").count() == 0


def test_checked_joins(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    b = spark.createDataFrame([("a", 3), ("a", 4)], "k string, y int")
    assert joins.checked_left_join(a, a.withColumnRenamed("x", "y"), ["k"], "one_to_one").count() == 2
    with pytest.raises(Exception, match="not unique on the right"):
        joins.checked_left_join(a, b, ["k"], "many_to_one").collect()
    with pytest.raises(Exception, match="not unique on the left"):
        joins.checked_left_join(b, a, ["k"], "one_to_one").collect()
    assert joins.double_keys(b, ["k"]).count() == 1
    with pytest.raises(Exception, match="no index for b"):
        joins.gather(a, spark.createDataFrame([("a", 0)], "id string, idx long"), "k").collect()
    assert joins.gather(a, spark.createDataFrame([("a", 0)], "id string, idx long"), "k", strict=False).count() == 1
    assert joins.keep_last(b, ["k"], "y").first()["y"] == 4


def test_tuning(spark):
    assert tuning.grid(spark, {"a": [1, 2], "b": [3, 4, 5]}).count() == 6
    best, log = tuning.coordinate_search({"a": 1, "b": 1}, [("a", [1, 2, 3]), ("b", [1, 2])], lambda c: -((c["a"] - 2) ** 2) - (c["b"] - 2) ** 2)
    assert best == {"a": 2, "b": 2} and len(log) == 4
    t = spark.createDataFrame([("m", 0, 0.5), ("m", 1, 0.7), ("m", 2, 0.7)], "model string, trial int, v double")
    assert tuning.best_trials(t, ["model"], "v", "trial").first()["trial"] == 1
    assert tuning.distinct_trials(t, ["model"], "trial").first()["trial"] == 2
    c = spark.createDataFrame([("r", e, v) for e, v in enumerate([0.1, 0.3, 0.2, 0.25, 0.9])], "run string, epoch int, v double")
    r = tuning.stopping_points(c, ["run"], "epoch", "v", 2).first()
    assert (r["best_epoch"], r["best"], r["stopped_at"]) == (1, 0.3, 3)
    w = spark.createDataFrame([("m", "p", 0, [1.0, 2.0])], "model string, param string, row int, vec array<double>")
    assert tuning.parameter_counts(w).first()["n"] == 2


def test_streams(spark, tmp_path):
    from harbormill.streaming import counts

    rows = [("a", "2020-01-01 10:00:00"), ("a", "2020-01-01 10:05:00"), ("b", "2020-01-02 10:00:00"), (None, "2020-01-02 10:00:00")]
    df = spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = counts.windowed_counts(stream, "t", "k").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["key"], r["n"]) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]
    assert sorted((r["user"] or "", r["n"]) for r in counts.sessions(df, "t", "k").collect()) == [("", 1), ("a", 2), ("b", 1)]
    q = counts.deduplicated(stream, ["k"], "t").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 3


def test_signatures_tell_nulls_and_separators_apart(spark):
    from pyspark.sql import functions as F

    from harbormill.sources.readers import signature

    rows = [("a", None, "b"), ("a", "b", None), ("a|b", "c", "d"), ("a", "b|c", "d"), ("\\N", "x", "y"), (None, "x", "y"), ("a", "", "b")]
    df = spark.createDataFrame(rows, "a string, b string, c string").select(signature(F.col("a"), F.col("b"), F.col("c")).alias("s"))
    assert len({r["s"] for r in df.collect()}) == len(rows)


def test_draws_are_orders_of_the_own_and_unseen_items():
    users, sizes = np.array([5, 9, 2**63 + 1], np.uint64), np.array([2, 1, 5])
    mine = np.array([0, 3, 5, 0, 1, 2, 3, 4])
    js, ks = models._draws(users, sizes, mine, 40, 6, 1)
    for lo, hi in ((0, 2), (2, 3), (3, 8)):
        assert all(sorted(j) == sorted(mine[lo:hi]) for j in js[:, lo:hi])
        assert not set(ks[:, lo:hi].ravel()) & set(mine[lo:hi])
    assert len({tuple(j) for j in js[:, 3:]}) > 20 and set(ks[:, 2]) == {0, 1, 2, 3, 4}
    alone = models._draws(users[2:], sizes[2:], mine[3:], 40, 6, 1)
    assert (alone[0] == js[:, 3:]).all() and (alone[1] == ks[:, 3:]).all()


@pytest.mark.parametrize("final", [True, False])
def test_steps_equal_the_written_out_rule(final):
    rng = np.random.default_rng(3)
    sizes, n = np.array([3, 1, 4, 2]), 9
    js, ks = rng.integers(0, 5, (3, 10)), rng.integers(5, n, (3, 10))
    p, v = rng.normal(size=(4, 5)), rng.normal(size=(n, 5))
    p2, v2 = p.copy(), v.copy()
    models._user_steps(p, v, sizes, js, ks, 0.05, 1e-4) if final else models._item_steps(p, list(v), sizes, js, ks, 0.05, 1e-4)
    for u, lo in enumerate((0, 3, 4, 8)):
        for j, k in ((j, k) for c in range(3) for j, k in zip(js[c, lo : lo + sizes[u]], ks[c, lo : lo + sizes[u]])):
            d = v2[j] - v2[k]
            g = 1 / (1 + np.exp(p2[u] @ d))
            q, x, y = p2[u].copy(), v2[j].copy(), v2[k].copy()
            p2[u] = q + 0.05 * (g * d - 1e-4 * q)
            if not final:
                v2[j] = x + 0.05 * (g * q - 1e-4 * x)
                v2[k] = y - 0.05 * (g * q + 1e-4 * y)
    assert np.allclose(p, p2, atol=1e-12) and np.allclose(v, v2, atol=1e-12)


@pytest.mark.parametrize("n,k", [(3, 5), (40, 5), (203, 20), (41, 1)])
def test_best_cells_equal_whole_sorts(n, k):
    rng = np.random.default_rng(n)
    s = rng.normal(size=(30, n)).round(1) + rng.normal(size=(30, n)) * 1e-8
    s[rng.random(s.shape) < 0.3] = -np.inf
    s[3] = -np.inf
    got = list(zip(*(x.tolist() for x in graph.best_cells(s, k, 6))))
    r = np.round(s, 6)
    assert got == [(a, b, r[a, b]) for a in range(30) for b in np.argsort(-r[a], kind="stable")[:k] if np.isfinite(r[a, b])]
