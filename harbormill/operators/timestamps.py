"""Mixed timestamp formats and zones: one instant for each text, or a stated reason why there is none.

A text is read once under every format that fits it.  The formats of a source are a mixture: each text contributes
to the formats under which it is a valid time, expectation-maximisation learns the weights of the formats per
source from the counts of these sets, and the posterior of the mixture chooses a text's reading; where none is
likely enough the text is marked ``ambiguous``.  Formats that write day and month in one order share their
evidence, so slashes teach how a source means its dashes.  A source's known habit (``day_first`` of the clock
table) is a prior that leaves no other order.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from datetime import date, datetime, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbormill.session import over_keys, ship, written

#: Words for a missing time.
MISSING = frozenset(("", "-", "--", "?", "n/a", "na", "nan", "nat", "none", "null", "nil", "unknown", "missing", "undefined"))

#: Month names in English, French, German and Spanish, without accents.
MONTHS = {
    1: "january jan janvier janv januar enero ene",
    2: "february feb fevrier fevr fev februar febrero",
    3: "march mar mars marz maerz mrz marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juin juni junio",
    7: "july jul juillet juil juli julio",
    8: "august aug aout agosto ago",
    9: "september sep sept septembre septiembre set",
    10: "october oct octobre oktober okt octubre",
    11: "november nov novembre noviembre",
    12: "december dec decembre dezember dez diciembre dic",
}
_MONTH = {name: n for n, names in MONTHS.items() for name in names.split()}

_TAIL = r"(?:\s*(?P<tail>Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{1,5}|[A-Za-z_]+(?:/[A-Za-z_+-]+)+)(?:\[(?P<bracket>[^\]]+)\])?)?"
#: What comes behind a date: a time of day with its zone, or nothing.
_CLOCK = r"(?P<H>\d{1,2})[:h](?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\b\.?)?(?:\s*Uhr)?" + _TAIL
_AT = r"(?:(?:T|,?\s+(?:à|a las|um|at)?\s*)" + _CLOCK + ")?"
_FORMS = [
    ("iso", re.compile(r"(?P<y>\d{4})(?P<sep>[-/.])(?P<mo>\d{1,2})(?P=sep)(?P<d>\d{1,2})" + _AT)),
    ("numeric", re.compile(r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4})" + _AT)),
    ("short", re.compile(r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<c>\d{2})" + _AT)),
    ("basic", re.compile(r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})(?:[T ]?(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})(?:[.,](?P<f>\d+))?" + _TAIL + ")?")),
    ("day_name_month", re.compile(r"(?:[^\W\d_]+\.?,?\s+)?(?P<d>\d{1,2})(?:st|nd|rd|th)?\.?[\s-]+(?:de\s+)?(?P<mon>[^\W\d_]+)\.?,?[\s-]+(?:de\s+)?(?P<y>\d{4})" + _AT)),
    ("month_day", re.compile(r"(?:[^\W\d_]+\.?,?\s+)?(?P<mon>[^\W\d_]+)\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})" + _AT)),
    ("ctime", re.compile(r"[^\W\d_]+\.?,?\s+(?P<mon>[^\W\d_]+)\.?\s+(?P<d>\d{1,2})\s+(?P<H>\d{1,2}):(?P<M>\d{2}):(?P<S>\d{2})(?:\.(?P<f>\d+))?(?:\s+(?P<tail>[A-Za-z]{1,5}|[+-]\d{2}:?\d{2}))?\s+(?P<y>\d{4})")),
]
_EPOCH = re.compile(r"(?:\d{10}(?:\.\d+)?|\d{13}|\d{16})")
_TICKS = re.compile(r"/Date\((-?\d+)(?:[+-]\d{4})?\)/")
_DAY0 = date(1970, 1, 1).toordinal()
_QUICK = re.compile(r"(\d{4})-(\d\d)-(\d\d)[ T](\d\d):(\d\d):(\d\d)")


@lru_cache(maxsize=4096)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except Exception:
        return None


@lru_cache(maxsize=4096)
def _letters(name: str) -> dict[str, int]:
    """What the zone's own letters stand for, in seconds east."""
    tz, out = _zone(name), {}
    for y in range(1990, 2038):
        for m in (1, 4, 7, 10):
            t = datetime(y, m, 1, tzinfo=tz)
            out.setdefault(t.tzname().upper(), int(t.utcoffset().total_seconds()))
    return out


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


#: In place of an offset: the letters behind the time are none of the source's zone.
FOREIGN = 1 << 30


@lru_cache(maxsize=200_000)
def _local_offset(zone: str, minute: int, letters: str) -> int | None:
    """Seconds east of UTC of a local time, given in minutes since 1970; None for one that the clocks skip."""
    tz = _zone(zone)
    day, rest = divmod(minute, 1440)
    d = date.fromordinal(day + _DAY0)
    first = datetime(d.year, d.month, d.day, rest // 60, rest % 60, tzinfo=tz)
    a = first.utcoffset()
    second = first.replace(fold=1)
    b = second.utcoffset()
    if a != b and first.astimezone(timezone.utc).astimezone(tz).replace(tzinfo=None) != first.replace(tzinfo=None):
        return None
    if letters:
        for t in (first, second):
            if t.tzname().upper() == letters:
                return int(t.utcoffset().total_seconds())
        return _letters(zone).get(letters, FOREIGN)
    return int(a.total_seconds())


def _instant(g: dict, y: int, mo: int, d: int, zone: str | None) -> tuple[int | None, str]:
    """Milliseconds since 1970, and a status."""
    try:
        days = date(y, mo, d).toordinal() - _DAY0
    except ValueError:
        return None, "invalid"
    h, m, s = int(g.get("H") or 0), int(g.get("M") or 0), int(g.get("S") or 0)
    if ap := g.get("ap"):
        if not 1 <= h <= 12:
            return None, "invalid"
        h = h % 12 + 12 * (ap in "Pp")
    if h > 23 or m > 59 or s > 59:
        return None, "invalid"
    ms = int(((g.get("f") or "") + "000")[:3])
    minute = days * 1440 + h * 60 + m
    tail, off = g.get("tail"), None
    if tail:
        if tail[0] in "+-":
            hh, mm = int(tail[1:3]), int(tail[-2:]) if len(tail) > 3 else 0
            if hh > 15 or mm > 59:
                return None, "invalid"
            off = (hh * 3600 + mm * 60) * (-1 if tail[0] == "-" else 1)
        elif tail.upper() in ("Z", "GMT", "UTC", "UT"):
            off = 0
        elif "/" in tail:
            if _zone(tail) is None:
                return None, "invalid"
            zone, tail = tail, ""
    if off is None:
        if g.get("bracket") and _zone(g["bracket"]):
            zone = g["bracket"]
        if _zone(zone) is None:
            return None, "no_zone"
        off = _local_offset(zone, minute, (tail or "").upper())
        if off is None:
            return None, "skipped"
        if off == FOREIGN:
            return None, "foreign_zone"
    return (minute * 60 + s - off) * 1000 + ms, "ok"


#: Readings of all-number dates that say the same about the order of day and month.
DAY_FIRST, MONTH_FIRST = ("dmy", "dmy2", "dmy8"), ("mdy", "mdy2", "mdy8")


def readings(text: str | None, zone: str | None) -> list[tuple[str, int | None, str]]:
    """(reading, epoch milliseconds or None, status) of every format under which the text is a time; formats that agree on
    the instant are one.  If there is none, one entry says why."""
    if not isinstance(text, str):
        return [("none", None, "missing")]
    t = text.strip().strip("\u200b\ufeff\"'").strip()
    if m := _QUICK.fullmatch(t):
        y, mo, d, h, mi, s = m.groups()
        return [("iso", *_instant({"H": h, "M": mi, "S": s}, int(y), int(mo), int(d), zone))]
    if t.lower() in MISSING:
        return [("none", None, "missing")]
    if _EPOCH.fullmatch(t):
        whole, _, frac = t.partition(".")
        n = int(whole)
        return [("epoch", n * 1000 + int((frac + "000")[:3]) if len(whole) == 10 else n if len(whole) == 13 else n // 1000, "ok")]
    if m := _TICKS.fullmatch(t):
        return [("epoch", int(m[1]), "ok")]
    for name, form in _FORMS:
        m = form.fullmatch(t)
        if not m:
            continue
        g = m.groupdict()
        if name == "numeric":
            a, b, y = int(g["a"]), int(g["b"]), int(g["y"])
            if g["sep"] == ".":
                return [("dotted", *_instant(g, y, b, a, zone))]
            return _valid([("dmy", *_instant(g, y, b, a, zone)), ("mdy", *_instant(g, y, a, b, zone))], a == b)
        if name == "short":
            a, b, c = int(g["a"]), int(g["b"]), int(g["c"])
            if g["sep"] == ".":
                return [("dotted2", *_instant(g, _year(c), b, a, zone))]
            return _valid([("dmy2", *_instant(g, _year(c), b, a, zone)), ("mdy2", *_instant(g, _year(c), a, b, zone)), ("ymd2", *_instant(g, _year(a), b, c, zone))], a == b == c)
        y = int(g["y"])
        if "mon" in g:
            mo = _MONTH.get(_plain(g["mon"]))
            if not mo:
                continue
            return [(name, *_instant(g, y, mo, int(g["d"]), zone))]
        if name == "basic" and not g["H"] and not 1970 <= y < 2070:
            # eight digits that are no year first: day or month first
            a, b, y = int(t[:2]), int(t[2:4]), int(t[4:8])
            if 1970 <= y < 2070:
                return _valid([("dmy8", *_instant(g, y, b, a, zone)), ("mdy8", *_instant(g, y, a, b, zone))], a == b)
            return [(name, None, "invalid")]
        return [(name, *_instant(g, y, int(g["mo"]), int(g["d"]), zone))]
    return [("none", None, "unreadable")]


def _year(two: int) -> int:
    return two + (2000 if two < 70 else 1900)


def _valid(found: list[tuple[str, int | None, str]], alike: bool) -> list[tuple[str, int | None, str]]:
    """The readings that exist in the calendar, as "same" if all agree (``alike``: day and month are equal); the first of the others if none does."""
    live = [x for x in found if x[2] != "invalid"]
    if len(live) > 1 and len({x[1:] for x in live}) == 1 and (alike or live[0][1] is not None):
        return [("same", *live[0][1:])]
    return live or found[:1]


def read_time(text: str | None, zone: str | None, day_first: bool | None) -> tuple[int | None, str, str]:
    """(epoch milliseconds or None, status, format) of one text.  ``day_first`` None: a date with two readings is ambiguous."""
    found = readings(text, zone)
    if day_first is not None:
        never = MONTH_FIRST if day_first else DAY_FIRST
        left = [x for x in found if x[0] not in never]
        if not left:
            return None, "invalid", found[0][0]
        found = left
    r, ms, status = found[0]
    return (None, "ambiguous", r) if len(found) > 1 else (ms, status, r)


def format_mixture(times: DataFrame, source_col: str, text_col: str, clock: DataFrame | None = None, rounds: int = 50) -> DataFrame:
    """``mixture`` of a table of texts."""
    read = read_all(times.withColumn("__id", F.lit("")), "__id", text_col, source_col, clock)
    return mixture(read.groupBy("source", "sig").agg(F.count(F.lit(1)).alias("n")), clock, rounds)


def mixture(counts: DataFrame, clock: DataFrame | None = None, rounds: int = 50) -> DataFrame:
    """(source, weights, w_dmy, w_mdy, n_open): the weight of each reading in each source, by expectation-maximisation.

    ``counts`` has (source, sig, n): how many texts of a source admit exactly the readings of ``sig``, joined by "|"; a few
    dozen rows a source, whatever its size.  The weight of a reading is that of its layout times that of its order of day and
    month, which all layouts share; w_dmy and w_mdy are the weights of the orders and n_open counts texts with several readings.
    """
    if clock is not None:
        # of several rows for a source with different habits none counts
        known = clock.groupBy(F.col("source_name").alias("csource")).agg(F.min("day_first").alias("lo"), F.max("day_first").alias("hi"))
        known = known.select("csource", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("day_first"))
        counts = counts.join(known, F.col("source") == F.col("csource"), "left").drop("csource")
    else:
        counts = counts.withColumn("day_first", F.lit(None).cast("boolean"))

    def order_of(r: str) -> int:
        return 0 if r in DAY_FIRST else 1 if r in MONTH_FIRST else 2

    def em(g: pd.DataFrame) -> pd.DataFrame:
        known = g["day_first"].dropna()
        sets = [s.split("|") for s in g["sig"]]
        n = g["n"].to_numpy(float)
        layout = {r: 1.0 for s in sets for r in s}
        order = np.array([0.5, 0.5, 1.0])
        if len(known):
            order[:2] = (1.0, 0.0) if bool(known.iloc[0]) else (0.0, 1.0)
        for _ in range(rounds):
            mass, orders = dict.fromkeys(layout, 0.0), np.array([0.5, 0.5])
            for s, c in zip(sets, n):
                p = np.array([layout[r] * order[order_of(r)] for r in s])
                if p.sum() <= 0:
                    continue
                for r, x in zip(s, c * p / p.sum()):
                    mass[r] += x
                    if order_of(r) < 2:
                        orders[order_of(r)] += x
            # layouts that differ in nothing but the order share one weight
            shared = {"".join(x for x in r if x.isdigit()): 0.0 for r in mass if order_of(r) < 2}
            for r, x in mass.items():
                if order_of(r) < 2:
                    shared["".join(y for y in r if y.isdigit())] += x
            layout = {r: (shared["".join(y for y in r if y.isdigit())] if order_of(r) < 2 else x) + 0.5 for r, x in mass.items()}
            if not len(known):
                order[:2] = orders / orders.sum()
        weights = {r: float(w * order[order_of(r)]) for r, w in layout.items()}
        several = float(sum(c for s, c in zip(sets, n) if len(s) > 1))
        return pd.DataFrame({"source": [g["source"].iloc[0]], "weights": [weights], "w_dmy": [order[0]], "w_mdy": [order[1]], "n_open": [int(several)]})

    ship(counts.sparkSession)
    return counts.groupBy("source").applyInPandas(em, "source string, weights map<string,double>, w_dmy double, w_mdy double, n_open long")


def read_all(df: DataFrame, id_col: str, text_col: str, source_col: str, clock: DataFrame | None) -> DataFrame:
    """(id, source, sig, instants, statuses): every row with all its readings; written, so texts are read once."""
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    # one row a source; of several rows the smallest zone counts
    if clock is None:
        rows = slim.withColumn("tz", F.lit(None).cast("string"))
    else:
        zones = clock.groupBy(F.col("source_name").alias("zsource")).agg(F.min("tz_name").alias("tz"))
        rows = slim.join(zones, F.col("source") == F.col("zsource"), "left").select("id", "text", "source", "tz")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sigs, instants, statuses = [], [], []
            for text, tz in zip(b["text"], b["tz"]):
                found = readings(text, tz if isinstance(tz, str) else None)
                sigs.append("|".join([r for r, _, _ in found]))
                instants.append([x for _, x, _ in found])
                statuses.append([x for _, _, x in found])
            yield pd.DataFrame({"id": b["id"].to_numpy(), "source": b["source"].to_numpy(), "sig": sigs, "instants": instants, "statuses": statuses})

    return written(over_keys(rows, "id", run, "source string, sig string, instants array<bigint>, statuses array<string>"), "readings")


def choose_readings(read: DataFrame, learned: DataFrame, sure: float = 0.95, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, epoch_ms, status, format, confidence) and the columns to ``keep``: the reading with the largest posterior, if this reaches ``sure``."""
    ways = learned.select(F.col("source").alias("wsource"), "weights")
    # one row a source; the join strategy is left to the measured sizes
    rows = read.join(ways, F.col("source") == F.col("wsource"), "left").withColumn("names", F.split("sig", r"\|"))
    rows = rows.withColumn("mass", F.transform("names", lambda r: F.coalesce(F.try_element_at("weights", r), F.lit(0.0))))
    total = F.aggregate("mass", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("best", F.array_position("mass", F.array_max("mass")).cast("int")).withColumn("share", F.try_divide(F.array_max("mass"), total))
    # the only reading of a text counts by itself, unless its source never has that order
    alone = F.size("names") == 1
    never = alone & (F.col("share").isNull())
    sure_enough = alone | (F.coalesce(F.col("share"), F.lit(0.0)) >= sure)
    status = F.when(never, "invalid").when(sure_enough, F.col("statuses")[F.col("best") - 1]).otherwise("ambiguous")
    ok = status == "ok"
    return rows.select(*keep, "id", F.when(ok, F.col("instants")[F.col("best") - 1]).alias("epoch_ms"), status.alias("status"), F.col("names")[F.col("best") - 1].alias("format"), F.when(ok, F.col("share")).otherwise(0.0).alias("confidence"))


def normalise_times(df: DataFrame, id_col: str, text_col: str, source_col: str, clock: DataFrame, sure: float = 0.95) -> DataFrame:
    """(id, epoch_ms, status, format, confidence) for each row.

    status: ok, missing, invalid (no such day or time; a second of 60 is none), skipped (by the clocks), ambiguous (no
    reading reaches the posterior ``sure``), no_zone (local time of an unknown source), foreign_zone (letters that are none of
    the source's zone), unreadable.  A null id, text or source is kept; repeated rows stay repeated; other columns are
    dropped.  ``clock`` has source_name, tz_name, day_first; a source with several zones takes the smallest, one with two habits has none.
    """
    read = read_all(df, id_col, text_col, source_col, clock)
    learned = mixture(read.groupBy("source", "sig").agg(F.count(F.lit(1)).alias("n")), clock)
    return choose_readings(read, learned, sure).withColumnRenamed("id", id_col)
