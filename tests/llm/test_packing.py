import random
from pathlib import Path

import pytest

from harbormill.llm import packing

pytestmark = pytest.mark.skipif(not Path(packing.VOCABULARY).exists(), reason="no vocabulary here")


def docs(spark, texts):
    return spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, bin_id int")


def check(spark, texts, capacity, **k):
    df = docs(spark, texts)
    got = packing.pack(df, capacity, **k).toPandas()
    counter = packing.TokenCounter(packing.VOCABULARY, packing.PATTERN)
    want = {i: len(counter.encode(t)) if t else 0 for i, t in enumerate(texts)}
    assert got.groupby("doc_id")["n_tokens"].sum().to_dict() == want
    assert got.groupby("bin_id")["n_tokens"].sum().max() <= capacity
    for i, g in got.groupby("doc_id"):
        pieces = g.sort_values("piece")
        assert list(pieces["piece"]) == list(range(len(g))) and list(pieces["first_token"]) == [p * capacity for p in range(len(g))]
        assert len(g) == 1 or (want[i] > capacity and set(pieces["n_tokens"][:-1]) == {capacity})
    return got, sum(want.values())


def test_pack(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["sea", "harbour", "quiet", "lodge", "über", "naïve", "x9"])
    texts = [None, "", " ", "a" * 5000, "\n\n\t"] + [" ".join(word() for _ in range(rng.choice([3, 20, 60, 150, 700]))) for _ in range(400)] + ["same text"] * 20
    got, total = check(spark, texts, 256, block_items=120)
    assert total / (256 * got["bin_id"].nunique()) > 0.97


def test_one_block_none_and_exact_fits(spark):
    assert packing.pack(docs(spark, []), 64).count() == 0
    got, _ = check(spark, ["sea"] * 64, 32)
    assert got["bin_id"].nunique() == 2


def test_counting_word_by_word_equals_the_whole(spark):
    counter = packing.TokenCounter(packing.VOCABULARY, packing.PATTERN)
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice([" ", "  ", "\n", " \n", "a", "Bc", "é", "12", ".", "'s", "​", " "]) for _ in range(40))
        assert counter.count(t) == len(counter.encode(t)), repr(t)


def test_crossover_keeps_every_item_once():
    import numpy as np

    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 50, 300).tolist()
    order = sorted(range(300), key=lambda i: (-sizes[i], i))
    place = [0] * 300
    for p, i in enumerate(order):
        place[i] = p
    a, b = packing._fresh(order, sizes, 100), packing._fresh(list(range(300)), sizes, 100)
    for _ in range(20):
        a = packing.cross(a, b, place, sizes, 100, rng)
        assert sorted(i for x in a.bins for i in x) == list(range(300))
        assert all(sum(sizes[i] for i in x) + f == 100 and f >= 0 for x, f in zip(a.bins, a.free))


def test_evolution_never_loses_to_its_start():
    import numpy as np

    rng = np.random.default_rng(5)
    sizes = rng.integers(20, 70, 200).tolist()
    first = packing.evolve(sizes, 100, 1, 1, 0, [])[0]
    best = packing.evolve(sizes, 100, 1, 6, 20, [first])[0]
    assert packing._score(sizes, best, 100) >= packing._score(sizes, first, 100)


def triplets(n, seed, capacity=1000):
    """Items that fill n bins of three exactly and leave best fit far behind."""
    import numpy as np

    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(0.38 * capacity, 0.49 * capacity))
        b = int(rng.integers(0.25 * capacity, (capacity - a) // 2 + 1))
        out += [a, b, capacity - a - b]
    return [int(x) for x in rng.permutation(out)]


def best_fit(sizes, capacity):
    return len(packing._fresh(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, capacity).bins)


@pytest.mark.parametrize("seed", range(3))
def test_evolution_beats_best_fit_on_triplets(seed):
    sizes = triplets(20, seed)
    assert best_fit(sizes, 1000) >= 23
    assert max(packing.evolve(sizes, 1000, seed, 20, 60, [])[0]) + 1 <= 21


def test_blocks_evolve_to_fewer_bins_than_best_fit_and_than_their_start(spark):
    """The whole operator on texts whose sizes are triplets: crossovers save bins."""
    sizes = triplets(30, 5, 240)
    texts = ["sea " * (n - 1) + "sea" for n in sizes]
    bins = [packing.pack(docs(spark, texts), 240, generations=g).select("bin_id").distinct().count() for g in (0, 30)]
    assert bins[1] < bins[0] and bins[1] < best_fit(sizes, 240)


def test_large_items_end_all_levels(spark):
    """Items over half a bin leave all bins open; every level still closes half of them and the last closes the rest."""
    texts = ["sea " * (9 + k % 3) for k in range(150)]
    got, _ = check(spark, texts, 16, block_items=20)
    assert got["bin_id"].nunique() == 150
