import json

import pytest

from harbormill.operators import drift

SCHEMA = "feed_id string, file_no int, file_name string, line_no int, line string"


def dumps(spark, files):
    rows = []
    for feed, no, name, lines in files:
        rows += [(feed, no, name, i + 1, x) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


def obj(**k):
    return json.dumps(k)


def test_changes(spark, rows):
    files = [
        ("f", 1, "a.json", [obj(user_id="m-123456", stars=4, old="x"), obj(user_id="m-2", stars=5, old="y"), "{broken", None, "[1]"]),
        ("f", 2, "b.json", [obj(userId="m-123456", stars=4.0, new=True), obj(userId="m-7", stars=None, new=False), obj(userId="m-8", stars=4.5, new=False)]),
        ("f", 3, "c.csv", ['"userId",stars,new,verified', "1234567,4,true,", "1234568,5,false,", "1,2", "1234569,3.5,true,"]),
        ("f", 5, "d.json", [obj(a=1)]),
        ("g", 1, "e.json", [obj(a=1)]),
    ]
    got = rows(drift.schema_changes(dumps(spark, files)), "file_no", "field", "change")
    assert got == sorted(
        [
            (2, "user_id", "renamed"), (2, "rating", "retyped"), (2, "old", "removed"), (2, "new", "added"),
            (3, "user_id", "retyped"), (3, "rating", "retyped"), (3, "verified", "added"),
        ], key=str)


def test_rare_keys_are_no_fields(spark, rows):
    lines = [obj(a=1)] * 9 + [obj(a=1, stray=1)]
    fields = drift.file_fields(drift.infer_paths(dumps(spark, [("f", 1, "a.json", lines)])))
    assert rows(fields, "field", "type") == [("a", "integer")]
    lines = [obj(a=1)] * 4 + [obj(a=1, fifth=1)]
    fields = drift.file_fields(drift.infer_paths(dumps(spark, [("f", 1, "a.json", lines)])))
    assert rows(fields, "field") == [("a",), ("fifth",)]


def test_unknown_name_is_read_by_its_values(spark, rows):
    a = [obj(user_id=f"m-{100000 + i}") for i in range(10)]
    b = [obj(traveller_no=f"m-{100000 + i}") for i in range(10)]
    got = rows(drift.schema_changes(dumps(spark, [("f", 1, "a.json", a), ("f", 2, "b.json", b)])), "field", "change")
    assert got == [("user_id", "renamed")]


@pytest.mark.parametrize("line,tag", [('{"x": 4}', "integer"), ('{"x": 4.0}', "decimal"), ('{"x": 1e3}', "decimal"), ('{"x": "4"}', "string"), ('{"x": true}', "boolean"), ('{"x": {}}', "object"), ('{"x": []}', "array"), ('{"x": null}', None)])
def test_json_tags(line, tag):
    assert drift.tag_json(drift.parse_object(line)["x"]) == tag


def test_nonsense_lines():
    for x in ("", None, "NaN", '{"x": NaN}', "[]", '{"x": 1} tail', "{" * 100_000):
        assert drift.parse_object(x) is None


def test_alternatives_and_unified(spark, rows):
    d = dumps(spark, [("f", 1, "a.json", [obj(user="m-111111", item=7, overall="5 stars", reply={"by": "x"}), obj(user="m-1", item=8, overall=4)]), ("f", 2, "b.csv", ["author,hotel,stars", "1234567,9,3.5", "bad"])])
    alt = rows(drift.alternatives(d), "path", "tag", "first_file")
    assert ("overall", "string", 1) in alt and ("overall", "integer", 1) in alt and ("reply.by", "string", 1) in alt
    u = drift.unified(d).orderBy("file_no", "line_no").collect()
    assert [(r["user_id"], r["hotel_id"], r["rating_value"]) for r in u] == [("m-111111", "7", 5.0), ("m-1", "8", 4.0), ("1234567", "9", 3.5)]
    assert [tuple(r["rating_union"]) for r in u] == [(None, None, "5 stars"), (4, None, None), (None, 3.5, None)]
    assert json.loads(u[0]["extras"]["reply"]) == {"by": "x"} and u[0]["tags"] == {"reply": "object"}


def test_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert drift.schema_changes(e).count() == 0 and drift.unified(e).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None), ("f", 1, None, 1, "a,b")], SCHEMA)
    assert drift.schema_changes(nulls).count() == 0


def test_no_line_is_lost(spark):
    """Repeated header names, lines of another width, files without header and broken objects all leave a trace."""
    files = [
        ("f", 1, "a.csv", ["user,stars,note,note", "u1,4,x,y", "u2,5,z,", "u3,1", None]),
        ("f", 2, "b.jsonl", [obj(user="u4", stars=3, photos=[{"url": "a", "tags": [1]}, {"url": 2}]), "{broken", "[1]"]),
        ("f", 3, "c.csv", [None, "u5,1,2,3"]),
    ]
    d = dumps(spark, files)
    read = drift.read_dumps(d)
    loaded = {(r["file_no"], r["line_no"]): r for r in drift.unified(d, read).collect()}
    out = {(r["file_no"], r["line_no"]): r["fault"] for r in drift.left_out(read).collect()}
    assert out == {(1, 4): "column_count", (1, 5): "column_count", (2, 2): "not_an_object", (2, 3): "not_an_object", (3, 2): "no_header"}
    assert set(loaded) == {(1, 2), (1, 3), (2, 1)}
    assert loaded[1, 2]["extras"] == {"note": "x", "note#2": "y"} and loaded[1, 2]["user_id"] == "u1"
    assert tuple(loaded[2, 1]["rating_union"]) == (3, None, None) and tuple(loaded[2, 1]["user_id_union"]) == (None, None, "u4")
    paths = {(r["path"], r["tag"]) for r in drift.alternatives(d).collect()}
    assert {("photos[].url", "string"), ("photos[].url", "integer"), ("photos[].tags[]", "integer")} <= paths


def test_names_are_learned_by_complement(spark, rows):
    """A name that no list has stands for a field if it comes where the field's other names do not; a field beside it does not."""
    known = lambda k: [obj(user=f"m-{100000 + i}", stars=i % 5, tip="a" * (i % 3)) for i in range(10)]
    other = lambda k: [obj(user=f"m-{100000 + i}", verdictmark=i % 5, tip="a" * (i % 3)) for i in range(10)]
    files = [(f"f{k}", no, "a.json", known(k) if no == 1 else other(k)) for k in range(4) for no in (1, 2)]
    got = rows(drift.schema_changes(dumps(spark, files)), "file_no", "field", "change")
    assert got == [(2, "rating", "renamed")] * 4
