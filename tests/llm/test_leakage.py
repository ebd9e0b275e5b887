import random

import pytest

from harbormill.llm import leakage

RNG = random.Random(9)
VOC = [a + b + c for a in ("ka", "mo", "ri", "su", "te") for b in ("la", "ne", "po", "vi", "zu") for c in ("m", "r", "s", "th", "x")]


def sentence(n=9):
    return " ".join(RNG.choice(VOC) for _ in range(n)).capitalize() + "."


ITEMS = [(k, " ".join(sentence() for _ in range(6))) for k in range(12)]
SLOGAN = "Prices shown are per night and may change without notice to our readers."


def frames(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(k, t, 5) for k, t in enumerate(docs)], "doc_id long, text string, item_id int")
    return d, spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")


def pairs(df):
    return sorted((r["doc_id"], r["item_id"]) for r in df.collect())


def filler(n=20):
    return " ".join(sentence() for _ in range(n))


def test_copies_in_disguise_are_found_and_quotes_are_not(spark):
    s = [t.split(". ") for _, t in ITEMS]
    edited = ITEMS[4][1].split()
    for k in range(7, len(edited), 13):
        edited[k] = "changed"
    docs = [
        filler() + " " + ITEMS[0][1] + " " + filler(),
        "".join(c + "​" if RNG.random() < 0.2 else c for c in ITEMS[1][1]).replace(" ", " ", 9),
        ITEMS[2][1].lower().replace(".", ""),
        "<p>" + ITEMS[3][1].replace(" ", " <b>x</b> ", 0).replace(" ", "&nbsp;", 6) + "</p>",
        " ".join(edited),
        s[5][5] + " " + filler(3) + " " + s[5][1] + ". " + filler(2) + s[5][3] + ". " + s[5][0],
        filler() + " " + s[6][2] + ". " + filler(),
        filler(),
        ITEMS[7][1].upper(),
        None,
        "",
        "   ",
        "x" * 300_000,
        ITEMS[0][1],
        ITEMS[0][1] + " " + ITEMS[1][1],
    ]
    d, i = frames(spark, docs)
    want = [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (8, 7), (13, 0), (14, 0), (14, 1)]
    assert pairs(leakage.find_leaks(d, i)) == want
    # in several passes, each with a part of the items
    assert pairs(leakage.find_leaks(d, i, items_per_pass=5)) == want


def test_sentences_from_everywhere_do_not_count(spark):
    items = [(1, SLOGAN + " " + SLOGAN + " " + sentence()), (2, ITEMS[0][1] + " " + SLOGAN)]
    docs = [filler(2) + " " + SLOGAN + " " + SLOGAN for _ in range(30)] + [items[0][1]]
    d, i = frames(spark, docs, items)
    assert pairs(leakage.find_leaks(d, i, everywhere=0.05)) == [(30, 1)]


def test_null_ids_leave_large_ones_exact(spark):
    big = 9_007_199_254_740_993
    d = spark.createDataFrame([(big, ITEMS[0][1]), (None, ITEMS[0][1])], "doc_id long, text string").coalesce(1)
    _, i = frames(spark, [])
    assert sorted((r["doc_id"] or 0) for r in leakage.find_leaks(d, i).collect()) == [0, big]


def test_an_item_that_many_documents_copy_is_no_text_from_everywhere(spark):
    d, i = frames(spark, [ITEMS[2][1] + " " + filler(1) for _ in range(40)])
    assert pairs(leakage.find_leaks(d, i)) == [(k, 2) for k in range(40)]


def test_repeated_and_overlapping_items_that_many_documents_copy_are_found(spark):
    a, b, c, e, g = (ITEMS[k][1] for k in (0, 1, 2, 3, 4))
    items = [
        (1, a), (2, a.upper()),  # repeated
        (3, b + " " + sentence()), (4, sentence() + " " + b),  # largely overlapping
        (5, c), (6, c + " " + " ".join(sentence() for _ in range(30))),  # one stands inside the other
        (7, e), (8, e[: len(e) // 2] + " " + filler(6)), (9, filler(6) + " " + e[len(e) // 2 :]),  # its halves stand in others
        (10, g),
    ]
    docs = [t + " " + filler(1) for t in (a, b, c, e) for _ in range(10)] + [filler(3) for _ in range(80)]
    want = sorted([(k, i) for k in range(10) for i in (1, 2)] + [(k, i) for k in range(10, 20) for i in (3, 4)] + [(k, 5) for k in range(20, 30)] + [(k, 7) for k in range(30, 40)])
    d, i = frames(spark, docs, items)
    assert pairs(leakage.find_leaks(d, i)) == want
    assert pairs(leakage.find_leaks(d, i, items_per_pass=4)) == want


def test_sentences_from_everywhere_do_not_count_in_any_pass(spark):
    items = [(1, SLOGAN + " " + SLOGAN + " " + sentence()), (2, ITEMS[0][1] + " " + SLOGAN), *((k, ITEMS[k][1]) for k in range(3, 8))]
    d, i = frames(spark, [filler(2) + " " + SLOGAN + " " + SLOGAN for _ in range(30)] + [items[0][1]], items)
    for k in (100, 4, 2):
        assert pairs(leakage.find_leaks(d, i, everywhere=0.05, items_per_pass=k)) == [(30, 1)]


def test_empty_tables_nulls_and_short_items(spark):
    d, i = frames(spark, [filler()], [(1, None), (2, ""), (3, "one two")])
    assert leakage.find_leaks(d, i).count() == 0
    assert leakage.find_leaks(d.limit(0), i).count() == 0
    d, i = frames(spark, [filler()])
    assert leakage.find_leaks(d, i.limit(0)).count() == 0


def test_removal(spark):
    keep = filler(4)
    d, i = frames(spark, [keep + " " + ITEMS[3][1] + " " + keep, keep, None])
    leaks = leakage.find_leaks(d, i)
    assert leakage.remove_leaks(d, i, leaks).count() == 2
    left = {r["doc_id"]: r["text"] for r in leakage.remove_leaks(d, i, leaks, "spans").collect()}
    assert left[1] == keep and left[2] is None and left[0].split() == (keep + " " + keep).split()


def test_removal_without_sentence_marks_and_of_short_sentences(spark):
    bare = lambda t: t.lower().replace(".", "")
    before, after, item = bare(filler(8)), bare(filler(8)), bare(ITEMS[3][1])
    words = item.split()
    short = ". ".join(" ".join(words[k : k + 3]) for k in range(0, len(words), 3)) + "."
    texts = {
        0: f"{before} {item} {after}",
        1: f"{before}. {short} {after}",
        2: f"{before} <p>{item.replace(' ', '&nbsp;')}</p> {after}",
        3: f"{before}\xa0{item}\xa0{after}".replace(" ", "\xa0"),
        4: f"{before},{item},{after}".replace(" ", ","),
    }
    d, i = frames(spark, list(texts.values()))
    leaks = leakage.find_leaks(d, i)
    assert pairs(leaks) == [(k, 3) for k in texts]
    clean = leakage.remove_leaks(d, i, leaks, "spans")
    assert leakage.find_leaks(clean, i).count() == 0
    for r in clean.collect():
        assert leakage.normal_words(r["text"]) == (before + " " + after).split(), r["doc_id"]


@pytest.mark.parametrize("a,b", [("Café—Élan", "cafe elan"), ("CafÃ© ﬁn", "cafe fin"), ("<b>Big</b> day", "big day"), ("so​ft", "soft"), ("Straße", "strasse"), ("саfe", "cafe")])
def test_normal_words(a, b):
    assert leakage.normal_words(a) == b.split()


def test_short_items_and_scripts_without_blanks(spark):
    """Items of fewer than five words match documents of just these words; each character of a script without blanks is a word."""
    chinese = "这家酒店的早餐非常丰富服务员也很热情房间干净明亮窗外可以看到整个港口的夜景我们下次还会再来住几天"
    items = [(1, "Which harbour town?"), (2, chinese), (3, ITEMS[0][1])]
    docs = ["which HARBOUR — town", "which harbour town is that", "前言\n" + chinese + "\n后记", chinese[:10] + "别的内容在这里完全不同的一段文字", filler(2), ITEMS[0][1]]
    d, i = frames(spark, docs, items)
    for k in (100, 1):
        assert pairs(leakage.find_leaks(d, i, items_per_pass=k)) == [(0, 1), (2, 2), (5, 3)]
    left = {r["doc_id"]: r["text"] for r in leakage.remove_leaks(d, i, leakage.find_leaks(d, i), "spans").collect()}
    assert not leakage.normal_words(left[0]) and left[1] == docs[1] and left[3] == docs[3] and not leakage.normal_words(left[5])
    assert "港口" not in left[2] and left[2].startswith("前言")


def test_spans_of_other_items_stay_and_passes_make_no_difference(spark):
    """A document keeps a sentence of an item that it does not leak; items come in passes."""
    quote = ITEMS[6][1].split(". ")[2] + "."
    keep = filler(3)
    text = keep + " " + ITEMS[5][1] + " " + quote + " " + ITEMS[7][1] + " " + keep
    d, i = frames(spark, [text, keep])
    leaks = leakage.find_leaks(d, i)
    assert pairs(leaks) == [(0, 5), (0, 7)]
    for k in (100, 2, 1):
        left = {r["doc_id"]: r["text"] for r in leakage.remove_leaks(d, i, leaks, "spans", items_per_pass=k).collect()}
        assert left[1] == keep and left[0].split() == (keep + " " + quote + " " + keep).split()
