import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harbormill.operators.records import Reader, judge, parse_lines, parse_texts

GOOD = "1,22,https://a.b/c.jpg,src,2020-01-01"
CASES = [
    (GOOD, None),
    ("﻿" + GOOD + "\r", None),
    ('"1"," 22 ","https://a.b/c?x=1,2","the ""x"" set",', None),
    ("1,22.0,HTTPS://a.b:8080/x,,", None),
    ('1,22,https://a".b/c,src,t', "quoting"),
    ('1,22,https://a.b/c,"src,t', "quoting"),
    ('1,22,https://a.b/c,"src" set",t', "quoting"),
    ('1, "22",https://a.b/c,src,t', "quoting"),
    ("1,22,https://a.b/c,src", "column_count"),
    ("1;22;https://a.b/c;src;t", "column_count"),
    ("", "column_count"),
    (None, "column_count"),
    ("1,0,https://a.b/c,s,t", "hotel_id"),
    ("1,-5,https://a.b/c,s,t", "hotel_id"),
    ("1,22.5,https://a.b/c,s,t", "hotel_id"),
    ("1,٣,https://a.b/c,s,t", "hotel_id"),
    ("1,,https:///c,s,t", "hotel_id"),
    ("1,22,https:///c,s,t", "image_url"),
    ("1,22,https://:80/c,s,t", "image_url"),
    ("1,22,ftp://a.b/c,s,t", "image_url"),
    ("1,22,https://a.b/c d,s,t", "image_url"),
    ("1,22,https://a.b/c d,s,t", "image_url"),
]


@pytest.mark.parametrize("line,reason", CASES)
def test_reasons(line, reason):
    from harbormill.operators.records import _bare_line

    fields, bad = Reader(_bare_line(line or ""), True).record()
    assert judge(fields, bad)[0] == reason


def test_parse_lines(spark):
    df = spark.createDataFrame([(i, line, "x") for i, (line, _) in enumerate(CASES)] * 2, "line_id long, line string, reason string")
    got = parse_lines(df, "line_id", "line").toPandas()
    assert len(got) == 2 * len(CASES)
    for r in got.itertuples():
        want = CASES[r.line_id][1]
        assert (r.reason or None) == want or (want is None and r.reason is None)
        assert (r.hotel_id is not None) == (want is None)
    assert parse_lines(df.limit(0), "line_id", "line").count() == 0


def test_reading_resumes_behind_a_broken_quote(spark):
    text = "\n".join([GOOD, '2,33,https://a.b/c,"open,t', "junk without number", "3,44,https://a.b/d,s,t", '4,55,https://a.b/e,"two\nlines",t'])
    got = parse_texts(spark.createDataFrame([("f", text), ("n", None), ("e", "")], "id string, t string"), "id", "t").toPandas()
    assert list(got["reason"].fillna("")) == ["", "quoting", "", ""]
    assert list(got["hotel_id"].fillna("")) == ["22", "", "44", "55"]
    assert list(got["record_no"]) == [0, 1, 2, 3]


def test_null_ids_leave_large_ones_exact(spark):
    big = 9_007_199_254_740_993
    df = spark.createDataFrame([(big, "bad"), (None, "bad")], "line_id long, line string").coalesce(1)
    assert sorted((r["line_id"] or 0) for r in parse_lines(df, "line_id", "line").collect()) == [0, big]


def test_very_long_line(spark):
    line = "1,22,https://a.b/" + "x" * 1_000_000 + ",s,t"
    assert parse_lines(spark.createDataFrame([(1, line)], "line_id long, line string"), "line_id", "line").first()["reason"] is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n é', max_size=8), min_size=5, max_size=5))
def test_round_trip_of_written_fields(fields):
    line = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
    assert Reader(line, True).record() == (fields, None)


def test_recovery_resumes_at_validated_records_only(spark, rows):
    """A stray quote must not take sound records along, whatever comes after it, and lines that are no records belong to the error."""
    good = ["1,11,http://a.b/1,x,t", '2,12,"http://a.b/2",x,t', "3,13,http://a.b/3,x,t"]
    text = "\r\n".join([good[0], '4,"14,http://a.b/4,x,t', "5,half a record", good[1], '6,16",http://a.b/6,x,t', good[2], "7,1", "", '8,18,"http://a.b/', '8",x,t', "9,19,http://a.b/9,x,t"])
    df = spark.createDataFrame([("f", "﻿" + text + "\n")], "id string, text string")
    got = [(r["line_no"], r["n_lines"], r["reason"], r["image_id"]) for r in parse_texts(df, "id", "text").orderBy("record_no").collect()]
    assert got == [
        (1, 1, None, 1), (2, 2, "quoting", None), (4, 1, None, 2), (5, 1, "quoting", None), (6, 1, None, 3),
        (7, 1, "column_count", None), (9, 2, "image_url", None), (11, 1, None, 9),
    ]


def test_a_quote_that_closes_behind_a_sound_record_is_broken(spark):
    text = '1,"11,http://a.b/1,x,t\n2,12,http://a.b/2,x,t\n3,13",http://a.b/3,x,t'
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert [(r["line_no"], r["reason"]) for r in parse_texts(df, "id", "text").orderBy("record_no").collect()] == [(1, "quoting"), (2, None), (3, "quoting")]


def test_carriage_returns_inside_a_record_stay(spark):
    df = spark.createDataFrame([(1, "1,11,http://a.b/1,x\ry,t\r\n2,12,http://a.b/2,x,t\r")], "id long, text string")
    got = parse_texts(df, "id", "text").orderBy("record_no").collect()
    assert [(r["image_id"], r["image_source"], r["upload_timestamp"]) for r in got] == [(1, "x\ry", "t"), (2, "x", "t")]
