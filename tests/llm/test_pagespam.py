import random

import numpy as np
import pytest

from harbormill.llm import pagespam

RNG = random.Random(3)
NOUNS = "harbour room porter breakfast terrace window garden menu stair lamp guest kettle bridge market train river hill waiter pool view".split()


def sentence():
    a, b, c = (RNG.choice(NOUNS) for _ in range(3))
    return f"{RNG.choice(['The', 'My', 'Our', 'A'])} {a} near the {b} was {RNG.choice(['quiet', 'noisy', 'old', 'bright', 'clean'])} and we {RNG.choice(['liked', 'missed', 'found', 'photographed'])} the {c} in the {RNG.choice(['evening', 'morning', 'rain'])}."


def honest(n=12):
    return " ".join(sentence() for _ in range(n))


def links(n):
    return " ".join(f"http://deal-{RNG.randrange(99)}.example/x/{RNG.randrange(9999)}" for _ in range(n))


def tags(n):
    return " ".join("#" + RNG.choice(NOUNS) for _ in range(n))


def stuffed(n):
    return " / ".join(RNG.choice(["cheap rooms Riverport", "Riverport hotel deals", "best offer Riverport"]) for _ in range(n))


def goods(n):
    return ", ".join(RNG.choice(NOUNS) + "-" + RNG.choice("abc") + f" {RNG.randrange(90)} pcs" for _ in range(n))


def corpus():
    good = [honest(RNG.randrange(2, 30)) for _ in range(150)] + [honest(10) + " " + links(12) for _ in range(10)] + [honest(10) + " " + tags(15) for _ in range(10)] + [honest(4) + " " + "a1b2" * 400]
    bad = [links(40) for _ in range(10)] + [tags(40) for _ in range(10)] + [stuffed(40) for _ in range(10)] + [goods(40) for _ in range(10)] + [honest(1) + " " + stuffed(60) for _ in range(5)] + [
        " ".join(f'<a href="x-{k}.example/y">cheap rooms</a>' for k in range(40)) for _ in range(3)]
    return good, bad


def frame(spark, texts):
    return spark.createDataFrame([(k, f"host{k % 3}" if k % 7 else None, t, 0.0) for k, t in enumerate(texts)], "doc_id long, host string, text string, score double")


def test_spam_is_found(spark):
    good, bad = corpus()
    odd = [None, "", "   ", "n/a", "x" * 200_000]
    texts = good + bad + odd + bad[:2]
    got = {r["doc_id"]: r["score"] for r in pagespam.score_pages(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    flagged = {k for k, s in got.items() if s > 0.5}
    want = set(range(len(good), len(good) + len(bad))) | {len(texts) - 2, len(texts) - 1}
    assert flagged == want


def test_labels_of_links_belong_to_the_links(spark):
    text = " | ".join(f"oferta de habitación y spa: http://deal-{k}.example/x" for k in range(30)) + " " + sentence()
    x = pagespam._measure([pagespam._words(text), pagespam._words("We saw http://a.b/c on the way. It was nice. See http://a.b/d for more.")], pagespam._Lexicon())
    assert x[0][1] > 0.8 and x[1][1] < 0.2


def test_without_labels_and_without_rows(spark):
    assert pagespam.score_pages(frame(spark, [])).count() == 0
    only = pagespam.score_pages(frame(spark, [honest()] * 3))
    assert {r["score"] > 0.5 for r in only.collect()} == {False}
    assert {r["score"] > 0.5 for r in pagespam.score_pages(frame(spark, [links(30)] * 3)).collect()} == {True}


@pytest.mark.parametrize("text,feature,low,high", [("", "n", 0, 0), ("http://a.b/c www.d.e/f", "links", 1, 1), ("#a #b word", "tags", 0.6, 0.7), ("the cat sat on the mat.", "function_rate", 0.4, 0.6)])
def test_features(text, feature, low, high):
    x = pagespam._measure([pagespam._words(text), []], pagespam._Lexicon(frozenset(("the", "on"))))
    assert low <= x[0][pagespam.FEATURES.index(feature)] <= high and not x[1].any()


def test_trees_on_held_out_rows():
    rng = np.random.default_rng(1)
    x = rng.random((1200, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    bag = pagespam.fit_bag(x[:800], y[:800])
    p = np.mean([t.predict(x[800:]) for t in bag], axis=0)
    assert ((p > 0.5) == y[800:]).mean() > 0.95


def test_hosts_move_unsure_pages_only():
    assert 0 < pagespam.HOST_WEIGHT < 0.5


def mixed(parts, n=60):
    """A page of n words or so, of which each kind has its share; the rest is sentences."""
    make = {"links": links, "tags": tags, "goods": lambda k: "\n".join(RNG.choice(NOUNS) + "-" + RNG.choice("abc") for _ in range(k)), "stuffed": lambda k: " ".join(["the cheap rooms in Riverport"] * (k // 5))}
    blocks = [make[kind](int(share * n)) for kind, share in parts.items()]
    rest, words = [], 0
    while words < (1 - sum(parts.values())) * n:
        rest.append(sentence())
        words += len(rest[-1].split())
    return "\n".join([" ".join(rest), *blocks])


def test_no_single_feature_decides(spark):
    """Borderline pages: spam made of two kinds in small parts, honest pages with a large part of one.

    So small a corpus leaves few clear labels, so the texts are fixed.
    """
    RNG.seed(3)
    good, bad = corpus()
    spam = [mixed({a: 0.36, b: 0.36}, 120) for a in ("links", "tags", "stuffed") for b in ("links", "tags", "goods", "stuffed") if a != b for _ in range(3)] + [mixed({"stuffed": 0.75}, 120) for _ in range(4)]
    fine = [mixed({a: 0.34}, 120) for a in ("links", "tags", "goods", "stuffed") for _ in range(5)]
    # the corpus the trees learn from holds such pages as well
    kinds = ("links", "tags", "goods", "stuffed")
    learn = [mixed({a: x, b: 0.88 - x}, 120) for a in kinds for b in kinds if a != b for x in (0.2, 0.44, 0.6) for _ in range(3)] + [mixed({a: x}, 120) for a in kinds for x in (0.15, 0.25) for _ in range(12)] + [mixed({"stuffed": 0.85}, 120) for _ in range(12)]
    # half of the honest pages run their sentences together, so that end marks don't tell either
    run_on = lambda pages: [t.replace(". ", " and ") if k % 2 else t for k, t in enumerate(pages)]
    good, fine = run_on(good), run_on(fine)
    texts = good + bad + learn + spam + fine
    got = pagespam.score_pages(frame(spark, texts)).toPandas().set_index("doc_id")["score"]
    feats = pagespam.label_pages(frame(spark, texts)).toPandas().set_index("doc_id")
    at = len(good) + len(bad) + len(learn)
    edge = list(range(at, len(texts)))
    truth = np.array([k < at + len(spam) for k in edge])
    flagged = (got.loc[edge] > 0.5).to_numpy()
    assert (flagged == truth).mean() >= 0.8
    for x in pagespam.FEATURES:
        v = feats.loc[edge, x].to_numpy()
        for cut in np.unique(v):
            assert ((v >= cut) != flagged).any() and ((v < cut) != flagged).any(), x


def test_a_host_moves_pages(spark):
    good, bad = corpus()
    edge = [mixed({"links": k / 100}) for k in range(20, 60, 4)]
    rows = [(t, "fine" if k % 2 else "other") for k, t in enumerate(good * 3)] + [(t, "spam") for t in bad] + [(t, h) for t in edge for h in ("fine", "spam")]
    df = spark.createDataFrame([(k, h, t) for k, (t, h) in enumerate(rows)], "doc_id long, host string, text string")
    r = pagespam.score_pages(df).toPandas().sort_values("doc_id").tail(2 * len(edge))
    a, b = r[r["host"] == "fine"], r[r["host"] == "spam"]
    assert (a["page_score"].to_numpy() == b["page_score"].to_numpy()).all()
    assert (b["score"].to_numpy() >= a["score"].to_numpy()).all() and (b["host_rate"].min() > 0.6 > 0.2 > a["host_rate"].max())
    moved = (b["score"].to_numpy() > 0.5) & (b["page_score"].to_numpy() <= 0.5) | (a["score"].to_numpy() <= 0.5) & (a["page_score"].to_numpy() > 0.5)
    assert moved.any()


def test_joining_words_of_any_language(spark):
    """Words of an invented language: joining words are found by their places, so its sentences are no lists."""
    small, large = ["ve", "ko", "zu", "mir"], ["talo" + x for x in "bdfghklmnprst"]
    said = lambda: " ".join(f"{RNG.choice(small)} {RNG.choice(large)}" for _ in range(6)) + "."
    texts = [" ".join(said() for _ in range(RNG.randrange(2, 9))) for _ in range(80)]
    df = frame(spark, texts + [links(40)] * 4)
    assert set(small) <= pagespam.joining_words(df) and not set(large) & pagespam.joining_words(df)
    got = {r["doc_id"] for r in pagespam.score_pages(df).filter("score > 0.5").collect()}
    assert got == set(range(80, 84))


def test_votes_are_trusted_by_agreement():
    """A signal that contradicts three others that agree is trusted less; an abstention says nothing."""
    rng = np.random.default_rng(5)
    spam = rng.random(4000) < 0.2
    votes = np.stack([np.where(rng.random(4000) < right, spam, ~spam) for right in (0.95, 0.9, 0.9, 0.5)], 1).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = pagespam.trust_votes(patterns, n.astype(float))[back.ravel()]
    assert ((post > 0.5) == spam).mean() > 0.95
    assert len(pagespam.trust_votes(np.zeros((0, 4), int), np.zeros(0))) == 0
