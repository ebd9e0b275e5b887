import pytest

from harbormill.llm import linkage

A = "ta_hotel_id string, ta_name string, hotel_name string, ta_city string, ta_lat double, ta_lon double, ta_postcode string, id string"
B = "id long, hotel_name string, chain_name string, city string, latitude double, longitude double, postcode string, star_rating double, ta_name string"


def images(spark, rows):
    return spark.createDataFrame([(f"/Hotel_Review-g1-d{k}-Reviews-{n.replace(' ', '_')}-{t.replace(' ', '_')}.html", n, None, t, la, lo, pc, "x") for k, (n, t, la, lo, pc) in enumerate(rows)], A)


def registry(spark, rows):
    return spark.createDataFrame([(k, n, None, t, la, lo, pc, 3.0, "x") for k, n, t, la, lo, pc in rows], B)


def found(df):
    return sorted((int(r["ta_hotel_id"].split("-d")[1].split("-")[0]), r["hotel_info_id"]) for r in df.collect())


def test_links(spark):
    a = [
        ("The Amber Wharf Hotel", "Draolville Bay", 10.001, 20.001, "AB12 345C"),
        ("Casteldan Hotel Draolville Bay North", "Draolville Bay", None, None, None),
        ("Silver Pond Inn", "Draolville Bay", 10.05, 20.05, None),
        ("Silver Pond Inn", "Torelville", None, None, None),
        ("Lonely Hut", "Torelville", None, None, None),
    ]
    b = [
        (501, "AMBER WHRAF HTL", "draolville bay", 10.0015, 20.0012, "ab12-345c"),
        (502, "Wharf Amber Hotel, The", None, None, None, "AB12345C"),
        (503, "Casteldan Hotel North", "Draolvile Bay", None, None, None),
        (504, "Casteldan Hotel South", "Draolville Bay", None, None, None),
        (505, "Silver Pond Inn by Norvale", "Draolville Bay", 10.0502, 20.0501, None),
        (506, "Silver Pond", "Torelville", None, None, None),
        (507, None, None, None, None, None),
        (507, "Nobody Knows", "Elsewhere", 0.0, 0.0, ""),
        (505, "Silver Pond Inn by Norvale", "Draolville Bay", 10.0502, 20.0501, None),
    ]
    got = linkage.match_hotels(images(spark, a), registry(spark, b))
    assert found(got) == [(0, 501), (0, 502), (1, 503), (2, 505), (3, 506)]
    assert all(0.5 < r["confidence"] <= 1 for r in got.collect())


def test_town_is_read_from_the_place(spark):
    a = [("Quiet Lamp Lodge", "Torelville", None, None, None), ("Stone Hill", "Torelville", 5.01, 6.01, None)]
    b = [(1, "Quiet Lamp Lodge", None, 5.012, 6.012, None), (2, "Stone Hill", "Torelville", 5.0101, 6.0101, None)]
    assert found(linkage.match_hotels(images(spark, a), registry(spark, b))) == [(0, 1), (1, 2)]


def test_large_blocks_lose_no_match(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 50)
    words = ["amber", "birch", "cedar", "delta", "eagle", "frost", "grove", "haven", "ivory", "jade"]
    a = [(f"Saffron {x} {y}", "Torelville", None, None, None) for x in words for y in words if x < y]
    b = [(k, f"{n} Hotel", "Torelville", None, None, None) for k, (n, *_) in enumerate(a)]
    assert found(linkage.match_hotels(images(spark, a), registry(spark, b))) == [(k, k) for k in range(len(a))]


def test_empty_sides_and_long_names(spark):
    a, b = images(spark, [("X " * 2000, "Torelville", None, None, None)]), registry(spark, [(1, "Y " * 2000, "Torelville", None, None, None)])
    assert linkage.match_hotels(a, b).count() == 0
    assert linkage.match_hotels(a.limit(0), b).count() == 0 and linkage.match_hotels(a, b.limit(0)).count() == 0


@pytest.mark.parametrize("a,b,same", [("wharf", "whraf", True), ("resort", "rseort", True), ("pond", "bond", True), ("elm", "ash", False), ("lagoon", "brook", False), ("barathaven", "barathavne", True)])
def test_near(a, b, same):
    assert linkage.near(a, b) is same


def test_neighbours_and_rivals_decide(spark):
    """Pairs too weak by themselves are found through a record that is alike and matches, and equal names in two towns are told apart
    by the better rival; without rounds both go wrong."""
    words = ["amber", "birch", "cedar", "delta", "eagle", "frost"]
    a = [(f"{x} wharf hotel", "Torelville", 10.0 + k, 20.0 + k, None) for k, x in enumerate(words)]
    b = [(k, f"{x} wharf hotel", "Torelville", 10.001 + k, 20.001 + k, f"AB{k}2 345C") for k, x in enumerate(words)]
    b += [(100 + k, f"{x} lodge", "Torelville", None, None, f"AB{k}2345C") for k, x in enumerate(words)]
    want = sorted([(k, k) for k in range(6)] + [(k, 100 + k) for k in range(6)])
    rounds = found(linkage.match_hotels(images(spark, a), registry(spark, b)))
    none = found(linkage.match_hotels(images(spark, a), registry(spark, b), rounds=0))
    assert rounds == want and set(none) < set(want)
    a = [("silver pond", "Torelville", 10.0, 20.0, None), ("silver pond brook", "Torelville", None, None, None)]
    b = [(1, "silver pond", "Torelville", 10.0, 20.0, None), (2, "silver pond brook", "Torelville", None, None, None)]
    assert found(linkage.match_hotels(images(spark, a), registry(spark, b))) == [(0, 1), (1, 2)]
    assert (1, 1) in found(linkage.match_hotels(images(spark, a), registry(spark, b), rounds=0))


def test_divided_blocks_keep_pairs_with_a_single_attribute(spark, monkeypatch):
    """Every record shares the same two words; towns have slips or are missing, and no other attribute links."""
    monkeypatch.setattr(linkage, "BLOCK", 20)
    towns = ["torelville", "barmouthby", "caskenholm", "draolstede", "elmerwick", "fenstoke", "garlington", "holtenham"]
    a = [("saffron lantern", t, None, None, None) for t in towns]
    b = [(k, "saffron lantern", t[:4] + t[5] + t[4] + t[6:], None, None, None) for k, t in enumerate(towns)]
    assert found(linkage.match_hotels(images(spark, a), registry(spark, b))) == [(k, k) for k in range(len(towns))]


@pytest.mark.parametrize("a,b", [("torelville", "torelvlile"), ("wharf", "warf"), ("barathaven", "brathavem"), ("elmerwick", "elmerwick")])
def test_town_keys_meet_where_towns_are_near(a, b):
    assert linkage.near(a, b) and set(linkage.town_keys([a])) & set(linkage.town_keys([b]))


def test_confidence_follows_the_labels():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=5000) * 4
    y = (rng.random(5000) < 1 / (1 + np.exp(-(0.7 * x - 1)))).astype(float)
    slope, shift = linkage.fit_confidence(x, y)
    assert abs(slope - 0.7) < 0.08 and abs(shift + 1) < 0.15
    slope, shift = linkage.fit_confidence(np.zeros(0), np.zeros(0))
    assert abs(slope - 1) < 1e-3 and abs(shift) < 1e-6


def test_towns_that_cannot_agree_never_meet(spark, monkeypatch):
    """Thirty towns share a second word and hold hotels of one name; only each town's own pair is compared."""
    compared, scored = [], linkage._scored
    monkeypatch.setattr(linkage, "_scored", lambda edges, a, b: compared.append(edges.count()) or scored(edges, a, b))
    firsts = [x + y for x in ("torel", "barmo", "casken", "draol", "elmer", "fensto") for y in ("ville", "bythorp", "holm", "wickham", "garth")]
    a = [("saffron lantern", f"{t} heights", None, None, None) for t in firsts]
    b = [(k, "saffron lantern", f"{t} heights", None, None, None) for k, t in enumerate(firsts)]
    assert found(linkage.match_hotels(images(spark, a), registry(spark, b))) == [(k, k) for k in range(30)]
    assert compared[0] == 30


def test_agreeing_towns_are_all_that_the_comparison_accepts(spark):
    import random

    rng = random.Random(7)
    words = ["torelville", "torelvile", "torel", "heights", "hieghts", "beach", "baech", "port", "porth", "bay", "barathaven", "brathavem", "alta"]
    towns = [list(dict.fromkeys(rng.choice(words) for _ in range(rng.randint(1, 4)))) for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in {tuple(t) for t in towns}], "town array<string>")
    rows = rows.selectExpr("town", "case when size(filter(town, w -> length(w) > 3)) > 0 then xxhash64(array_join(filter(town, w -> length(w) > 3), ' ')) end th")
    hashes = {tuple(r["town"]): r["th"] for r in rows.collect() if r["th"] is not None}
    got = {r["th"]: set(r["towns"]) for r in linkage._agreeing_towns(rows, rows).collect()}
    plain = {"names": [], "code": "", "lat": None, "lon": None}
    for s, hs in hashes.items():
        for t, ht in hashes.items():
            rejected = linkage.compare(plain | {"town": list(s)}, plain | {"town": list(t)})[0] == -9.0
            assert rejected or ht in got.get(hs, set()), (s, t)


@pytest.mark.parametrize("lat,lon", [(10.0, 20.0), (10.0049, -0.0001), (-0.0051, 19.998)])
def test_neighbouring_map_cells_meet(lat, lon):
    own = set(linkage.attributes([], [], "", lat, lon, False))
    for di in (-0.0049, 0, 0.0049):
        for dj in (-0.0049, 0, 0.0049):
            assert own & set(linkage.attributes([], [], "", lat + di, lon + dj, True))


def test_lean_steps_leave_no_shuffle_files(spark):
    import time

    from harbormill.session import discard, written

    def files():
        all_files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {all_files.apply(k).getName() for k in range(all_files.size())}

    before = files()
    df = written(spark.range(1000).selectExpr("id % 7 k").groupBy("k").count(), "lean", lean=True)
    for _ in range(50):
        if not {f for f in files() - before if f.startswith("shuffle_")}:
            break
        time.sleep(0.2)
    assert not {f for f in files() - before if f.startswith("shuffle_")}
    assert df.count() == 7
    discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(*df.inputFiles()).count()


def test_spellings_of_two_words_do_not_multiply(spark, monkeypatch):
    """Forty spellings of each of two words agree in every way, and no step makes a row for each pair of spellings."""
    written, most = linkage.written, []

    def counted(df, name, lean=False):
        out = written(df, name, lean)
        most.append(out.count())
        return out

    monkeypatch.setattr(linkage, "written", counted)
    firsts = ["torelville"[:k] + c + "torelville"[k + 1 :] for k in range(2, 10) for c in "zqxkj"]
    seconds = ["heights"[:k] + c + "heights"[k + 1 :] for k in range(7) for c in "zqxkjw"][:40]
    towns = [["orimwold", x, y] for x, y in zip(firsts, seconds)]
    far = [["pellorgate", y, x] for x, y in zip(firsts, seconds)]
    frame = lambda t: spark.createDataFrame([(k, x) for k, x in enumerate(t)], "th long, town array<string>")
    got = {r["th"]: set(r["towns"]) for r in linkage._agreeing_towns(frame(towns), frame(far)).collect()}
    agree = lambda s, t: linkage._match(s, t) >= 2
    assert got == {j: w for j, s in enumerate(towns) if (w := {k for k, t in enumerate(far) if agree(s, t)})}
    assert most and max(most) <= 40 * 40 * 2


def test_pieces_hold_few_rows():
    import pandas as pd

    got = list(linkage._pieces(iter([pd.DataFrame({"k": range(2500)}), pd.DataFrame({"k": range(3)})])))
    assert [len(f) for f in got] == [1000, 1000, 500, 3] and [k for f in got for k in f["k"]] == [*range(2500), *range(3)]
