"""Names, slugs and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Filler words that a core name leaves out.
FILLERS = ("hotel", "motel", "resort", "suites", "suite", "inn", "by", "the", "of", "at", "llc", "inc", "lodge")


def core_name(c: Column, fillers: tuple[str, ...] = FILLERS, min_tokens: int = 0) -> Column:
    """Lower-case core of a hotel name; anything but a-z, 0-9 separates words, null gives ''.

    Words of one letter are dropped, single digits stay.  With fewer than ``min_tokens`` words the result is ''.
    """
    t = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    t = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit(" and ")), F.lit("st."), F.lit("saint")), F.lit("/"), F.lit(" "))
    words = F.split(F.regexp_replace(t, r"[^a-z0-9\s]", " "), r"\s+")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*fillers) & ((F.length(w) > 1) | w.rlike("^[0-9]$")))
    return F.when(F.size(kept) >= min_tokens, F.array_join(kept, " ")).otherwise("")


def parse_slug(url: Column) -> Column:
    """struct(name, loc) of the part behind ``-Reviews-``; both '' without the marker, loc '' without a second part."""
    tail = F.split(F.coalesce(url, F.lit("")), "-Reviews-", 2)
    has = F.size(tail) > 1
    parts = F.split(F.regexp_replace(F.element_at(tail, -1), r"\.html?$", ""), "-")
    name = F.when(has, F.replace(parts[0], F.lit("_"), F.lit(" "))).otherwise("")
    loc = F.when(has & (F.size(parts) > 1), F.replace(F.element_at(parts, -1), F.lit("_"), F.lit(" "))).otherwise("")
    return F.struct(name.alias("name"), loc.alias("loc"))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def clean_text(c: Column) -> Column:
    """Trimmed, null as ''."""
    return F.trim(F.coalesce(c, F.lit("")))


def slug(c: Column) -> Column:
    return F.translate(F.lower(c), " -", "__")
