"""Rows that fail to parse: an error-recovering recursive-descent reader of comma-separated records.

    text    = record { newline record }
    record  = field { "," field }
    field   = quoted | bare
    quoted  = '"' { any char but '"' | '""' } '"'     then "," or the record's end
    bare    = { any char but '"' and "," }

After a broken quote inside a text of many records the reader resumes at the next validated record-start anchor: a
line start from which a whole record of all fields reads without a fault, its first field an unsigned integer.  A
quoted field that runs over such an anchor is a broken quote as well, so a stray quote never takes sound records
along.  Each error keeps its place in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from harbormill.session import over_keys

REASONS = ("quoting", "column_count", "hotel_id", "image_url")
FIELDS = ("image_id", "hotel_id", "image_url", "image_source", "upload_timestamp")

_ANCHOR = re.compile('\ufeff?(?:"[0-9]+"|[ ]*[0-9]+[ ]*),')
_STOP, _LINE_STOP = re.compile('[,"]'), re.compile('[,"\n]')
_ID = re.compile(r"([0-9]+)(?:\.0)?")
_URL = re.compile(r"https?://([^/?#]*)", re.I)


class Reader:
    """Recursive descent over one text.  ``single`` reads the whole text as one record, so that a
    line break is an ordinary character."""

    def __init__(self, text: str, single: bool, at: int = 0):
        self.s, self.i, self.single = text, at, single

    def _ends(self) -> bool:
        """Whether a record may end here: at the text's end or, among many records, at a line's end."""
        rest = self.s[self.i : self.i + 2]
        return not rest or (not self.single and (rest[0] == "\n" or rest in ("\r\n", "\r")))

    def record(self) -> tuple[list[str], int | None]:
        """The fields, and the place of the first quoting error or None.  ``i`` is left at the record's end or at the error."""
        fields = []
        while True:
            value, bad = self.field()
            if bad is not None:
                return fields, bad
            fields.append(value)
            if self.i < len(self.s) and self.s[self.i] == ",":
                self.i += 1
                continue
            return fields, None

    def field(self) -> tuple[str, int | None]:
        return self.quoted() if self.s[self.i : self.i + 1] == '"' else self.bare()

    def quoted(self) -> tuple[str, int | None]:
        start, parts = self.i, []
        self.i += 1
        while True:
            q = self.s.find('"', self.i)
            if q < 0:
                return "", start
            parts.append(self.s[self.i : q])
            if self.s[q + 1 : q + 2] == '"':
                parts.append('"')
                self.i = q + 2
                continue
            self.i = q + 1
            if not self.single and self._swallows(start, q):
                return "", start
            if self._ends() or self.s[self.i] == ",":
                return "".join(parts), None
            return "", q

    def bare(self) -> tuple[str, int | None]:
        start, m = self.i, (_STOP if self.single else _LINE_STOP).search(self.s, self.i)
        self.i = m.start() if m else len(self.s)
        if m and m[0] == '"':
            return "", self.i
        if not self.single and (m is None or m[0] == "\n") and self.s[start : self.i].endswith("\r"):
            self.i -= 1
        return self.s[start : self.i], None

    def _anchored(self, at: int) -> bool:
        """Whether a whole record starts at the line start ``at``."""
        if not _ANCHOR.match(self.s, at):
            return False
        end = self.s.find("\n", at)
        line = Reader(_bare_line(self.s[at : end if end >= 0 else len(self.s)]), True)
        fields, bad = line.record()
        return bad is None and len(fields) == len(FIELDS)

    def _swallows(self, start: int, end: int) -> bool:
        nl = self.s.find("\n", start, end)
        while nl >= 0:
            if self._anchored(nl + 1):
                return True
            nl = self.s.find("\n", nl + 1, end)
        return False

    def recover(self, start: int) -> None:
        """Moves to the first validated anchor behind ``start``, or to the end."""
        at = start
        while (nl := self.s.find("\n", at)) >= 0:
            if self._anchored(nl + 1):
                self.i = nl + 1
                return
            at = nl + 1
        self.i = len(self.s)


def _bare_line(line: str) -> str:
    line = line[1:] if line[:1] == "﻿" else line
    return line[:-1] if line[-1:] == "\r" else line


def judge(fields: list[str], bad: int | None) -> tuple[str | None, int | None]:
    """The first reason in the fixed order, and the number of the field or character it lies in."""
    if bad is not None:
        return "quoting", bad
    if len(fields) != len(FIELDS):
        return "column_count", len(fields)
    m = _ID.fullmatch(fields[1].strip(" "))
    if not m or not m[1].strip("0"):
        return "hotel_id", 1
    url = fields[2].strip(" ")
    m = _URL.match(url)
    if not m or not m[1].rpartition("@")[2].partition(":")[0] or any(c.isspace() for c in url):
        return "image_url", 2
    return None, None


def _row(fields: list[str], reason: str | None) -> list:
    if reason:
        return [None] * len(FIELDS)
    image, hotel, url, source, at = fields
    image = image.strip(" ")
    hotel = _ID.fullmatch(hotel.strip(" "))[1].lstrip("0")
    # an id beyond 18 digits does not fit a long and stays null; no reason covers it
    return [int(image) if image.isascii() and image.isdigit() and len(image) <= 18 else None, hotel, url.strip(" "), source or None, at or None]


_OUT = "image_id bigint, hotel_id string, image_url string, image_source string, upload_timestamp string, reason string, error_at int"


def parse_lines(df: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """One row per line: the typed record, or the reason it can't be loaded with its place.

    A byte-order mark before and a carriage return after a line don't belong to it.  A null line
    reads as an empty one (``column_count``).  Repeated lines stay repeated; other columns are dropped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for line in b["line"]:
                text = _bare_line(line) if isinstance(line, str) else ""
                fields, bad = (text.split(","), None) if '"' not in text else Reader(text, True).record()
                reason, at = judge(fields, bad)
                out.append([*_row(fields, reason), reason, at])
            f = pd.DataFrame(out, columns=[*FIELDS, "reason", "error_at"])
            for c in ("image_id", "error_at"):
                f[c] = f[c].astype("Int64")
            f.insert(0, "id", b["id"].to_numpy())
            yield f

    slim = df.select(df[id_col].alias("id"), df[line_col].alias("line"))
    return over_keys(slim, "id", run, _OUT).withColumnRenamed("id", id_col)


def parse_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts that hold many records, such as whole files: one row per record with its number in the text, the line it starts
    at, the lines it takes, and the place of its error in the text.

    After a broken quote reading resumes at the next anchor; lines up to there belong to the error.  A byte-order mark
    before and a carriage return after a line don't belong to it; blank lines between records are passed over.  A null or empty text gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, out = [], []
            for key, text in zip(b["id"], b["text"]):
                if not isinstance(text, str):
                    continue
                r, n, line = Reader(text, False), 0, 1
                while r.i < len(r.s):
                    if r.s[r.i] == "\n":
                        r.i, line = r.i + 1, line + 1
                        continue
                    if r.s[r.i] == "\ufeff" or r._ends():
                        r.i += 1
                        continue
                    start = r.i
                    fields, bad = r.record()
                    if bad is not None:
                        r.recover(start)
                    reason, at = judge(fields, bad)
                    taken = r.s.count("\n", start, r.i)
                    # a recovered reader stands behind the last line's end
                    lines = taken + (bad is None or r.i == len(r.s) and not r.s.endswith("\n"))
                    ids.append(key)
                    out.append([n, line, lines, *_row(fields, reason), reason, at])
                    n, line = n + 1, line + taken
            if not out:
                continue
            f = pd.DataFrame(out, columns=["record_no", "line_no", "n_lines", *FIELDS, "reason", "error_at"])
            for c in ("record_no", "line_no", "n_lines", "image_id", "error_at"):
                f[c] = f[c].astype("Int64")
            f.insert(0, "id", ids)
            yield f

    slim = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return over_keys(slim, "id", run, f"record_no int, line_no int, n_lines int, {_OUT}").withColumnRenamed("id", id_col)
