import numpy as np
import pytest

from harbormill.llm.neighbours import _top, learn_rotation, learn_rotations, nearest, plan

SCHEMA = "vec_id long, vec array<float>, id string"


def frame(spark, vecs, first=1):
    return spark.createDataFrame([(k + first, None if v is None else [None if x is None else float(x) for x in v], "clash") for k, v in enumerate(vecs)], SCHEMA)


def exact(vecs, k=5):
    v = np.array(vecs, dtype=np.float32).astype(float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    return [[j + 1 for j in sorted((j for j in range(len(v)) if j != i), key=lambda j: (-s[i, j], j))[:k]] for i in range(len(v))]


def answer(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    return {i: [n[k] for k in sorted(n)] for i, n in out.items()}


def clustered(n, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 15, 64))
    return centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, 64)) * rng.uniform(0.3, 1.5, (n, 1))


@pytest.mark.parametrize("bucket,piece", [(1024, 4096), (1024, 40), (4, 4096)])
def test_recall_against_brute_force(spark, bucket, piece):
    """Small pieces cut crowded buckets, small buckets make longer substrings and more of them."""
    vecs = clustered(3000, 1)
    got, want = answer(nearest(frame(spark, vecs), bucket=bucket, piece=piece)), exact(vecs)
    hit = sum(len(set(got.get(i + 1, [])) & set(w)) for i, w in enumerate(want))
    assert hit / (5 * len(want)) > 0.97


def test_plan_follows_the_number_of_vectors():
    """Buckets stay as large at any n, and lookups a vector grow with its logarithm; nothing is switched or capped."""
    assert plan(1000) == (0, 1) and plan(10_000) == (4, 8) and plan(200_000) == (8, 8)
    lengths = [plan(n)[0] for n in (10**5, 3 * 10**5, 10**6, 10**7, 10**8, 10**9, 10**11)]
    assert lengths == sorted(lengths) and lengths[-2:] == [20, 27]
    assert all(n / 2 ** plan(n)[0] <= 1024 for n in (10**5, 10**6, 10**9, 10**11))


def test_long_codes_take_several_rotations():
    x = clustered(400, 6)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, p = learn_rotations(x, 121)
    assert p.shape == (64, 121) and not np.allclose(p[:, :57], p[:, 64:])


@pytest.mark.parametrize("words", [1, 4])
def test_top_is_exact_within_the_radius(words):
    """Against brute force; a radius that holds all rows gives the exact answer, with ties to the smaller id."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(700, 64)).astype(np.float32).astype(float)
    v[600:] = v[:100]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = rng.permutation(700)
    code = rng.integers(0, 2**63, (700, words), dtype=np.int64).astype(np.uint64)
    row, near, sims = _top(v, ids, code, v, ids, code, 5, 700)
    s = np.round(v @ v.T, 6)
    for i in range(0, 700, 37):
        want = sorted((j for j in range(700) if j != i), key=lambda j: (-s[i, j], ids[j]))[:5]
        assert near[row == i].tolist() == ids[want].tolist()


def test_copies_and_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 64)).astype(np.float32)
    vecs = list(base) + [base[0] * 2] * 9 + [base[1]] * 2
    got, want = answer(nearest(frame(spark, vecs))), exact(vecs)
    for i in [0, 12, 15, 20, 1, 21, 22]:
        assert got[i + 1][: len(want[i])] == want[i] if i not in (1, 21, 22) else set(want[i][:2]) <= set(got[i + 1])


def test_unusable_vectors_are_on_neither_side(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(8, 64))
    bad = [None, [], [1.0] * 63, [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] * 64]
    got = answer(nearest(frame(spark, list(good) + bad)))
    assert set(got) <= set(range(1, 9)) and all(n <= 8 for v in got.values() for n in v)


def test_few_vectors_are_exact(spark):
    """Scattered vectors of a small table share no part of their codes and are still found."""
    vecs = np.random.default_rng(9).normal(size=(40, 64))
    assert answer(nearest(frame(spark, vecs), keep=40)) == {i + 1: w for i, w in enumerate(exact(vecs))}


def test_few_and_no_vectors(spark):
    assert nearest(frame(spark, [])).count() == 0
    one = frame(spark, [np.ones(64)])
    assert nearest(one).count() == 0
    assert answer(nearest(frame(spark, [np.ones(64), np.ones(64) * 3]))) == {1: [2], 2: [1]}


def test_rotation_keeps_angles():
    x = clustered(500, 4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, p = learn_rotation(x)
    assert np.allclose(p.T @ p, np.eye(64), atol=1e-8)
    code = (x - mean) @ p > 0
    near = [(code[i] != code[j]).sum() for i in range(100) for j in range(i) if x[i] @ x[j] > 0.95]
    far = [(code[i] != code[j]).sum() for i in range(100) for j in range(i) if x[i] @ x[j] < 0.3]
    assert np.mean(near) < 0.5 * np.mean(far)
