from datetime import datetime, timezone

import pytest

from harbormill.operators.timestamps import format_mixture, normalise_times, read_time


def ms(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)


NY, PARIS, SYDNEY = "America/New_York", "Europe/Paris", "Australia/Sydney"
CASES = [
    ("2021-03-30 19:35:16", NY, False, ms(2021, 3, 30, 23, 35, 16)),
    ("2021-03-30T19:35", NY, False, ms(2021, 3, 30, 23, 35)),
    (" \t2021-03-30 ", PARIS, True, ms(2021, 3, 29, 22)),
    ("2017-05-25T19:32:43+02:00", NY, False, ms(2017, 5, 25, 17, 32, 43)),
    ("2017-05-25T19:32:43.123987+00:00", NY, False, ms(2017, 5, 25, 19, 32, 43) + 123),
    ("2017-05-25T19:32:43z", NY, False, ms(2017, 5, 25, 19, 32, 43)),
    ("2016-07-28T12:59:03+02:00[Europe/Paris]", NY, False, ms(2016, 7, 28, 10, 59, 3)),
    ("2016-07-23 20:00:11 Europe/Paris", NY, False, ms(2016, 7, 23, 18, 0, 11)),
    ("2015-01-19 01:06:15 America/Los_Angeles", NY, False, ms(2015, 1, 19, 9, 6, 15)),
    ("06/07/2020 03:46", NY, False, ms(2020, 6, 7, 7, 46)),
    ("06/07/2020 03:46", PARIS, True, ms(2020, 7, 6, 1, 46)),
    ("7/6/2020 12:05 AM", NY, False, ms(2020, 7, 6, 4, 5)),
    ("06/21/2020 03:46", PARIS, True, None),
    ("10.01.2012 21:27:34", PARIS, True, ms(2012, 1, 10, 20, 27, 34)),
    ("Fri, 07 Sep 2018 12:10:32 GMT", NY, False, ms(2018, 9, 7, 12, 10, 32)),
    ("Sat, 19 Nov 2016 02:09:53 -0800", NY, False, ms(2016, 11, 19, 10, 9, 53)),
    ("Fri Aug 24 18:13:43 2018", "UTC", False, ms(2018, 8, 24, 18, 13, 43)),
    ("16 Aug 2023", "UTC", False, ms(2023, 8, 16)),
    ("October 22, 2017 4:28 pm", "UTC", False, ms(2017, 10, 22, 16, 28)),
    ("23. August 2017, 19:46 Uhr", "Europe/Berlin", True, ms(2017, 8, 23, 17, 46)),
    ("21. März 2018, 03:57 Uhr", "UTC", True, ms(2018, 3, 21, 3, 57)),
    ("10 août 2018 à 16h14", PARIS, True, ms(2018, 8, 10, 14, 14)),
    ("20120831T061917Z", NY, False, ms(2012, 8, 31, 6, 19, 17)),
    ("20140707193358", "UTC", False, ms(2014, 7, 7, 19, 33, 58)),
    ("1609589072", NY, False, 1609589072000),
    ("1554417268.129", NY, False, 1554417268129),
    ("1429606093314", NY, False, 1429606093314),
    ("1656904169222688", NY, False, 1656904169222),
    ("/Date(1431837753989-0700)/", NY, False, 1431837753989),
    # the clocks skip this hour, and this one comes twice
    ("2021-03-14 02:30:00", NY, False, None),
    ("2021-11-07 01:30:00", NY, False, ms(2021, 11, 7, 5, 30)),
    ("2021-11-07 01:30:00 EST", NY, False, ms(2021, 11, 7, 6, 30)),
    ("2021-11-07 01:30:00 EDT", NY, False, ms(2021, 11, 7, 5, 30)),
    ("2023-09-24 22:51:02 IST", "Asia/Kolkata", True, ms(2023, 9, 24, 17, 21, 2)),
    ("2017-03-11 21:46:42 AEDT", SYDNEY, True, ms(2017, 3, 11, 10, 46, 42)),
    ("2015-02-30 11:20:00", NY, False, None),
    ("2017-06-30T25:10:00Z", NY, False, None),
    ("0000-00-00 00:00:00", NY, False, None),
    ("last summer", NY, False, None),
    ("NaT", NY, False, None),
    ("", NY, False, None),
    (None, NY, False, None),
    ("x" * 100_000, NY, False, None),
]


@pytest.mark.parametrize("text,zone,first,want", CASES)
def test_forms(text, zone, first, want):
    assert read_time(text, zone, first)[0] == want


def test_unknown_source_keeps_only_absolute_times():
    assert read_time("2021-03-30 19:35:16", None, None)[:2] == (None, "no_zone")
    assert read_time("2021-03-30T19:35:16Z", None, None)[1] == "ok"


def clock(spark):
    return spark.createDataFrame([("us", NY, False), ("fr", PARIS, True), ("learns", "UTC", None)], "source_name string, tz_name string, day_first boolean")


def test_mixture_learns_the_order_of_a_source(spark):
    t = [("learns", f"{d}/03/2020") for d in range(13, 29)] + [("learns", "05/06/2020")] * 4 + [("us", "05/06/2020"), (None, "05/06/2020")]
    df = spark.createDataFrame(t, "s string, t string")
    w = {r["source"]: r["w_dmy"] for r in format_mixture(df, "s", "t", clock(spark)).collect()}
    assert w["learns"] > 0.95 and w["us"] == 0.0 and w[""] == 0.5


def test_normalise_times(spark, rows):
    data = [(1, "05/06/2020", "us"), (2, "05/06/2020", "fr"), (3, "05/06/2020", "learns"), (4, "05/06/2020", None), (5, None, "us"), (6, "1609589072", None), (1, "05/06/2020", "us")]
    df = spark.createDataFrame([(*x, "clash") for x in data], "row_id long, t string, s string, status string")
    got = rows(normalise_times(df, "row_id", "t", "s", clock(spark)), "row_id", "epoch_ms", "status")
    assert got == sorted([(1, ms(2020, 5, 6, 4), "ok")] * 2 + [(2, ms(2020, 6, 4, 22), "ok"), (3, None, "ambiguous"), (4, None, "ambiguous"), (5, None, "missing"), (6, 1609589072000, "ok")], key=str)
    assert normalise_times(df.limit(0), "row_id", "t", "s", clock(spark)).count() == 0


def test_all_formats_of_a_source_share_its_order(spark):
    """Slashes teach what the same source's dashes, short years and eight digits mean; a source without evidence stays ambiguous."""
    sure = [f"{d}/03/2020" for d in range(13, 29)]
    open_ = ["05-06-2020", "05/06/20", "05062020"]
    rows_ = [(k, t, "learns") for k, t in enumerate(sure + open_)] + [(100 + k, t, "nothing") for k, t in enumerate(open_)]
    df = spark.createDataFrame(rows_, "id long, t string, s string")
    zones = spark.createDataFrame([("learns", "UTC", None), ("nothing", "UTC", None)], "source_name string, tz_name string, day_first boolean")
    got = {r["id"]: (r["epoch_ms"], r["status"]) for r in normalise_times(df, "id", "t", "s", zones).collect()}
    want = ms(2020, 6, 5)
    assert got[16] == (want, "ok") and got[18] == (want, "ok")
    # a short year may also come first
    assert got[17] in ((want, "ok"), (None, "ambiguous"))
    assert [got[100 + k][1] for k in range(3)] == ["ambiguous"] * 3


def test_letters_of_another_zone(spark):
    assert read_time("2020-01-01 10:00 PST", PARIS, True)[:2] == (None, "foreign_zone")
    assert read_time("2020-01-01 10:00 CET", PARIS, True)[0] == ms(2020, 1, 1, 9)


def test_both_orders_alike(spark):
    for first in (True, False, None):
        assert read_time("05/05/2020", "UTC", first)[0] == ms(2020, 5, 5)


def test_a_source_with_two_habits_has_none(spark):
    two = spark.createDataFrame([("x", "UTC", True), ("x", "UTC", False)], "source_name string, tz_name string, day_first boolean")
    df = spark.createDataFrame([(1, "05/06/2020", "x")], "id long, t string, s string")
    assert [r["status"] for r in normalise_times(df, "id", "t", "s", two).collect()] == ["ambiguous"]
