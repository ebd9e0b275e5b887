"""Schemas that drift between files: tagged-union inference.

Each line contributes the tagged types of its paths; schemas of lines fuse by adding
counts (an associative sum, so partial schemas are fused before the shuffle), which
retains every alternative type a path ever had.  A path with several tags is a union
that is split into typed branches next to one canonical conversion.  Files of a feed
are compared with the file before them by a keyed join, never by walking a feed.
"""

from __future__ import annotations

import csv
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harbormill.session import ship, written
from harbormill.sources.readers import ALIASES as READER_ALIASES

#: The spellings of the five standard fields, compared in lower case without marks between words; others are learned.
ALIASES = {role: tuple(dict.fromkeys(re.sub("[^a-z0-9]", "", x.lower()) for x in names)) for role, names in READER_ALIASES.items()}
STANDARD = tuple(ALIASES)
TAGS = ("string", "integer", "decimal", "boolean", "object", "array")
#: A name stands for a standard field if in this share of its files no other name does.
COMPLEMENT = 0.8
#: A .json file has a field if this share of its parsable lines holds the key.
PRESENT = 0.2

#: Shapes that only a standard field's values have; plain numbers fit too many fields to tell.
_SHAPES = {
    "hotel_id": re.compile(r"/Hotel_Review-\S+"),
    "user_id": re.compile(r"[A-Za-z]{1,6}[-_][0-9]{5,9}"),
    "timestamp": re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:.*"),
    "review_text": re.compile(r"\S+(?: \S+){5,}", re.S),
}
#: Shapes that tell fields apart without naming one.
_KINDS = {"small": re.compile(r"[0-9]{1,2}(?:\.[0-9]+)?(?:\s*/\s*[0-9]+|\s+[a-z]+)?"), "clock": re.compile(r"[0-9]{10}(?:[0-9]{3}){0,2}|.*[0-9]{1,2}[:/.-][0-9]{2}.*"), "number": re.compile(r"[0-9]+(?:\.[0-9]+)?")}
_INT, _DEC = re.compile(r"[0-9]+"), re.compile(r"[0-9]+\.[0-9]+")


class _Number(str):
    """A JSON number as written."""


def _reject(name: str):
    raise ValueError(name)


def parse_object(line: str | None) -> dict | None:
    """The line's object with numbers as written, or None if it doesn't parse or is something else."""
    try:
        o = json.loads(line, parse_int=_Number, parse_float=_Number, parse_constant=_reject)
    except (ValueError, TypeError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def tag_json(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, _Number):
        return "decimal" if any(c in ".eE" for c in v) else "integer"
    return "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "array"


def tag_text(v: str) -> str | None:
    if v == "":
        return None
    return "integer" if _INT.fullmatch(v) else "decimal" if _DEC.fullmatch(v) else "boolean" if v in ("true", "false") else "string"


def split_csv(line: str) -> list[str]:
    try:
        return next(csv.reader([line]), [])
    except csv.Error:
        return []


def _shape(v) -> str:
    """The standard field that a value looks like, or else its kind, for names that no list knows."""
    if isinstance(v, str):
        for role, form in (_SHAPES if not isinstance(v, _Number) else {}).items():
            if form.fullmatch(v):
                return role
        for kind, form in _KINDS.items():
            if form.fullmatch(v):
                return kind
    return ""


def _paths(prefix: str, v, out: list) -> None:
    out.append((prefix, tag_json(v) or "null", _shape(v) if "." not in prefix else ""))
    if isinstance(v, dict):
        for k, x in v.items():
            _paths(f"{prefix}.{k}", x, out)
    elif isinstance(v, list):
        for x in v:
            _paths(f"{prefix}[]", x, out)


def _is_json(name: Column) -> Column:
    return F.lower(F.coalesce(name, F.lit(""))).rlike(r"\.(json|jsonl|ndjson)$")


def infer_paths(dumps: DataFrame) -> DataFrame:
    """(feed_id, file_no, path, top, tag, looks, n, lines): how often each path had each tag, with the file's parsable lines.

    One pass over the lines, fused inside each batch.  Values of .csv files are counted by position and
    number of values, and get their names from the header afterwards, so raw lines are never joined.
    """

    ship(dumps.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for feed, no, js, ln, line in zip(b["feed_id"], b["file_no"], b["js"], b["line_no"], b["line"]):
                if not isinstance(line, str):
                    continue
                if js:
                    o = parse_object(line)
                    if o is None:
                        continue
                    seen[feed, no, "line", "", "", "", 0, 0] += 1
                    found: list = []
                    for k, v in o.items():
                        before = len(found)
                        _paths(k, v, found)
                        _, tag, looks = found[before]
                        seen[feed, no, "top", k, tag, looks, 0, 0] += 1
                        for p, t, _ in set(found[before + 1 :]):
                            seen[feed, no, "deep", p, t, "", 0, 0] += 1
                elif ln == 1:
                    seen[feed, no, "header", line.lstrip("﻿").rstrip("\r"), "", "", 0, 0] += 1
                else:
                    values = split_csv(line.rstrip("\r"))
                    seen[feed, no, "row", "", "", "", len(values), 0] += 1
                    for i, v in enumerate(values):
                        seen[feed, no, "value", "", tag_text(v) or "null", _shape(v), len(values), i] += 1
            if seen:
                f = pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["feed_id", "file_no", "kind", "path", "tag", "looks", "width", "pos", "n"])
                yield f

    slim = dumps.select("feed_id", "file_no", "line_no", "line", _is_json(F.col("file_name")).alias("js"))
    parts = slim.filter(F.col("feed_id").isNotNull() & F.col("file_no").isNotNull()).mapInPandas(
        run, "feed_id string, file_no int, kind string, path string, tag string, looks string, width int, pos int, n long"
    )
    fused = parts.groupBy("feed_id", "file_no", "kind", "path", "tag", "looks", "width", "pos").agg(F.sum("n").alias("n"))
    # several branches below read it; written once, the lines are parsed once
    fused = written(fused, "paths")

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for feed, no, line in zip(b["feed_id"], b["file_no"], b["path"]):
                names = split_csv(line)
                seen: set[str] = set()
                for i, x in enumerate(names):
                    if x not in seen:
                        out.append((feed, no, x, i, len(names)))
                    seen.add(x)
            if out:
                yield pd.DataFrame(out, columns=["feed_id", "file_no", "path", "pos", "width"])

    key = ["feed_id", "file_no"]
    heads = fused.filter("kind = 'header'").select(*key, "path").mapInPandas(name, "feed_id string, file_no int, path string, pos int, width int")
    # the header stands for one null-tagged row, so that a column without values is still a field
    values = fused.filter("kind = 'value'").select(*key, "width", "pos", "tag", "looks", "n")
    named = values.join(heads, [*key, "width", "pos"]).select(*key, "path", F.lit(True).alias("top"), "tag", "looks", "n")
    empty = heads.select(*key, "path", F.lit(True).alias("top"), F.lit("null").alias("tag"), F.lit("").alias("looks"), F.lit(1).cast("long").alias("n"))
    lines = fused.filter("kind = 'line'").groupBy(*key).agg(F.sum("n").alias("lines"))
    objects = fused.filter("kind in ('top', 'deep')").select(*key, "path", (F.col("kind") == "top").alias("top"), "tag", "looks", "n")
    csvs = named.unionByName(empty).withColumn("lines", F.lit(0).cast("long"))
    return objects.join(lines, key).unionByName(csvs)


def _alias_role(name: Column) -> Column:
    squeezed = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    out = F.lit(None).cast("string")
    for role, names in ALIASES.items():
        out = F.when(squeezed.isin(*names), role).otherwise(out)
    return out


def file_fields(paths: DataFrame) -> DataFrame:
    """(feed_id, file_no, field, name, type): the top-level fields that each file has.

    ``field`` is the standard field a name stands for: by its spelling, or else by four fifths of its values having the standard
    field's shape, or else by complement: over all files, the name stands where no other name stands for the
    field, in at least ``COMPLEMENT`` of its files.  Any other field keeps its name.  If two names of a file stand for one standard field, the one with
    more values counts.  ``type`` is the tag of most non-null values (ties: the first of TAGS), null without any.
    """
    key = ["feed_id", "file_no", "name"]
    top = paths.filter("top").withColumnRenamed("path", "name")
    by_tag = top.groupBy(*key, "tag").agg(F.sum("n").alias("n"), F.max("lines").alias("lines"))
    rank = F.element_at(F.create_map(*[x for i, t in enumerate(TAGS) for x in (F.lit(t), F.lit(-i))]), F.col("tag"))
    types = by_tag.groupBy(*key).agg(
        F.sum("n").alias("held"),
        F.max("lines").alias("lines"),
        F.max_by("tag", F.when(F.col("tag") != "null", F.struct("n", rank))).alias("type"),
    )
    looks = top.filter("tag != 'null'").groupBy(*key, "looks").agg(F.sum("n").alias("n"))
    looks = looks.groupBy(*key).agg(F.sum("n").alias("values"), F.max_by("looks", F.struct("n", "looks")).alias("looks"), F.max("n").alias("most"))
    fields = types.filter((F.col("lines") == 0) | (F.col("held") >= PRESENT * F.col("lines"))).join(looks, key, "left")
    fields = fields.withColumn("spelt", _alias_role(F.col("name")))
    shaped = F.when(F.col("looks").isin(*STANDARD) & (F.col("most") >= 0.8 * F.col("values")), F.col("looks"))
    in_file = W.partitionBy("feed_id", "file_no")
    fields = fields.withColumn("have", F.collect_set("spelt").over(in_file)).withColumn("shaped", shaped)
    # a name whose values look like a field that other files have beside it is no name of that field
    fields = written(fields, "fields")
    beside = fields.filter("spelt is null and shaped is not null").groupBy("name", "shaped").agg(F.avg(F.when(F.array_contains("have", F.col("shaped")), 1.0).otherwise(0.0)).alias("beside"))
    fields = fields.join(beside, ["name", "shaped"], "left")
    fields = fields.withColumn("role", F.coalesce("spelt", F.when((F.col("beside") <= 1 - COMPLEMENT) & ~F.array_contains("have", F.col("shaped")), F.col("shaped"))))
    fields = written(fields.withColumn("filled", F.collect_set("role").over(in_file)), "fields")
    open_ = F.array_except(F.array(*[F.lit(r) for r in STANDARD]), F.col("filled"))
    unknown = fields.filter("role is null").select("name", "type", "looks", open_.alias("open"))
    n_files = unknown.groupBy("name").agg(F.count(F.lit(1)).alias("n_files"))
    # how usual a type and kind are for a standard field parts two fields that always miss together
    usual = fields.filter("role is not null").groupBy("role", "type", "looks").agg(F.count(F.lit(1)).alias("t"))
    usual = usual.withColumn("usual", F.col("t") / F.sum("t").over(W.partitionBy("role"))).select("role", "type", "looks", "usual")
    votes = unknown.select("name", "type", "looks", F.explode("open").alias("role")).join(usual, ["role", "type", "looks"], "left").groupBy("name", "role").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("usual", F.lit(0.0))).alias("usual"))
    # only a field whose known names hold such values somewhere
    fitting = votes.join(n_files, "name").filter((F.col("n") >= COMPLEMENT * F.col("n_files")) & (F.col("usual") > 0))
    learned = fitting.groupBy("name").agg(F.max_by("role", F.struct(F.round("usual", 3), "n", "role")).alias("learned"))
    fields = fields.join(learned, "name", "left").withColumn("role", F.coalesce("role", F.when(~F.array_contains("filled", F.col("learned")), F.col("learned"))))
    best = F.row_number().over(W.partitionBy("feed_id", "file_no", "role").orderBy(F.desc("held"), "name"))
    fields = fields.withColumn("best", best)
    role = F.when(F.col("role").isNotNull() & (F.col("best") == 1), F.col("role"))
    return fields.select("feed_id", "file_no", F.coalesce(role, F.col("name")).alias("field"), "name", "type")


def schema_changes(dumps: DataFrame) -> DataFrame:
    """(feed_id, file_no, field, change): each file against the file before it in its feed.

    A feed's file without a predecessor (file_no - 1) has no changes.  A file of which no line parses
    has no fields.  Null lines, and lines that do not parse, are passed over; repeated lines count as often as they stand.
    """
    fields = file_fields(infer_paths(dumps))
    # the name must be unique inside a file, also where an extra field carries a standard one's name
    fields = fields.groupBy("feed_id", "file_no", "field").agg(F.min_by(F.struct("name", "type"), F.col("name")).alias("s")).select("feed_id", "file_no", "field", "s.*")
    files = dumps.select("feed_id", "file_no").filter("feed_id is not null and file_no is not null").distinct()
    later = files.select("feed_id", (F.col("file_no") + 1).alias("file_no")).join(files, ["feed_id", "file_no"])
    now = fields.join(later, ["feed_id", "file_no"], "left_semi").withColumn("is_now", F.lit(True))
    # a file's own predecessor under the file's number
    before = fields.withColumn("file_no", F.col("file_no") + 1).join(later, ["feed_id", "file_no"], "left_semi").withColumn("is_now", F.lit(False))
    both = now.unionByName(before).groupBy("feed_id", "file_no", "field").agg(
        F.max(F.when(F.col("is_now"), F.struct("name", "type"))).alias("now"), F.max(F.when(~F.col("is_now"), F.struct("name", "type"))).alias("was")
    )
    n, w = F.col("now"), F.col("was")
    standard = F.col("field").isin(*STANDARD)
    changes = F.array_compact(
        F.array(
            F.when(w.isNull(), "added"),
            F.when(n.isNull(), "removed"),
            F.when(standard & n.isNotNull() & w.isNotNull() & (n["name"] != w["name"]), "renamed"),
            F.when(n.isNotNull() & w.isNotNull() & (n["type"] != w["type"]), "retyped"),
        )
    )
    return both.select("feed_id", "file_no", "field", F.explode(changes).alias("change"))


def alternatives(dumps: DataFrame) -> DataFrame:
    """(feed_id, path, tag, first_file, n): the union type of every path of a feed, with the file where each alternative first appears."""
    return infer_paths(dumps).filter("tag != 'null'").groupBy("feed_id", "path", "tag").agg(F.min("file_no").alias("first_file"), F.sum("n").alias("n"))


def _placed(names: list[str]) -> list[str]:
    """Header names, each once: a repeated one gets its number behind it."""
    out: list[str] = []
    for x in names:
        k, y = 1, x
        while y in out:
            k += 1
            y = f"{x}#{k}"
        out.append(y)
    return out


def read_dumps(dumps: DataFrame) -> DataFrame:
    """(feed_id, file_no, line_no, line, names, vals, kinds, fault): every line but headers, read once and written.

    ``fault`` is null for a loadable line, else not_an_object (of a .json file), column_count (another number of values than the header's
    columns) or no_header.  Values are named by their position, so a header that repeats a name loses none.
    """
    ship(dumps.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for feed, no, js, ln, line in zip(b["feed_id"], b["file_no"], b["js"], b["line_no"], b["line"]):
                text = line if isinstance(line, str) else ""
                if js:
                    o = parse_object(line)
                    live = {k: v for k, v in (o or {}).items() if v is not None}
                    vals = [str(v) if isinstance(v, str) else json.dumps(v) for v in live.values()]
                    out.append((feed, no, ln, line, list(live), vals, [tag_json(v) for v in live.values()], -1, "not_an_object" if o is None else None))
                elif ln != 1:
                    v = split_csv(text.rstrip("\r"))
                    out.append((feed, no, ln, line, None, v, [tag_text(x) for x in v], len(v), None))
            if out:
                yield pd.DataFrame(out, columns=["feed_id", "file_no", "line_no", "line", "names", "vals", "kinds", "width", "fault"])

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["head"] = [_placed(split_csv(x.lstrip("\ufeff").rstrip("\r"))) for x in b["line"]]
            yield b[["feed_id", "file_no", "head"]]

    key = ["feed_id", "file_no"]
    slim = dumps.select(*key, "line_no", "line", _is_json(F.col("file_name")).alias("js"))
    rows = slim.mapInPandas(run, "feed_id string, file_no int, line_no int, line string, names array<string>, vals array<string>, kinds array<string>, width int, fault string")
    heads = slim.filter("not js and line_no = 1 and line is not null").select(*key, "line").mapInPandas(name, "feed_id string, file_no int, head array<string>")
    # a file has one header, the smallest if it was delivered twice; Spark chooses the join by the real sizes and AQE splits a hot file
    heads = heads.groupBy(*key).agg(F.min("head").alias("head"))
    j = rows.join(heads, key, "left")
    csv_fault = F.when(F.col("head").isNull(), "no_header").when(F.size("head") != F.col("width"), "column_count")
    j = j.withColumn("fault", F.when(F.col("width") >= 0, csv_fault).otherwise(F.col("fault")))
    j = j.withColumn("names", F.when(F.col("fault").isNull(), F.coalesce("names", "head"))).withColumn("vals", F.transform("vals", lambda v: F.when(v != "", v)))
    return written(j.select(*key, "line_no", "line", "names", "vals", "kinds", "fault"), "dumps")


def left_out(read: DataFrame) -> DataFrame:
    """(feed_id, file_no, line_no, fault, line): the lines of ``read_dumps`` that cannot be loaded, with the reason."""
    return read.filter("fault is not null").select("feed_id", "file_no", "line_no", "fault", "line")


def unified(dumps: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """One table of all dumps: feed_id, file_no, line_no, the five standard columns as text, each of them also as a union of typed
    branches, ``rating`` as a canonical number too, ``extras`` as a map with the tag of each value in ``tags``.  Lines that can't be loaded are in ``left_out``."""
    key = ["feed_id", "file_no"]
    read = read_dumps(dumps) if read is None else read
    fields = file_fields(infer_paths(dumps))
    roles = fields.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.when(F.col("field").isin(*STANDARD), F.struct("field", "name")))).alias("roles"))
    j = read.filter("fault is null").join(roles, key, "left")
    m = F.map_from_arrays("names", "vals")
    t = F.map_from_arrays("names", "kinds")

    def std(role: str) -> Column:
        return F.try_element_at(m, F.try_element_at("roles", F.lit(role)))

    def union(role: str) -> Column:
        v, kind = std(role), F.try_element_at(t, F.try_element_at("roles", F.lit(role)))
        return F.struct(
            F.when(kind == "integer", v.try_cast("bigint")).alias("as_integer"),
            F.when(kind == "decimal", v.try_cast("double")).alias("as_decimal"),
            # a number too large for its branch stays as text
            F.when(~kind.isin("integer", "decimal") | ((kind == "integer") & v.try_cast("bigint").isNull()), v).alias("as_string"),
        ).alias(f"{role}_union")

    taken = F.coalesce(F.map_values("roles"), F.array().cast("array<string>"))
    return j.select(
        *key,
        "line_no",
        *[std(r).alias(r) for r in STANDARD],
        *[union(r) for r in STANDARD],
        F.regexp_extract(std("rating"), r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double").alias("rating_value"),
        F.map_filter(m, lambda k, v: ~F.array_contains(taken, k) & v.isNotNull()).alias("extras"),
        F.map_filter(t, lambda k, v: ~F.array_contains(taken, k) & v.isNotNull()).alias("tags"),
    )
