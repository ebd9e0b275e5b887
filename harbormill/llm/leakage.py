"""Evaluation texts leaking into training text.

The normalised n-grams of the evaluation items are a broadcast hash set; every training
document is scanned once, window by window.  Hits are checked word by word, n-grams
that a notable share of all documents contains are counted over the whole corpus and do
not count as copying unless most of these documents copy one of their items as a whole or
enough of each, and a document leaks an item if the rest of its hits covers half of the
item's remaining words.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbormill.session import over_keys, ship, written

N = 5
#: The share of an item's words that a leak covers.
COVER = 0.5
#: n-grams in more than this share of all documents stand everywhere.
EVERYWHERE = 0.002
#: An item is copied as a whole even if this share of its words stands in no popular copy.
REST = 0.1
#: Items per pass; their n-grams are broadcast, so a larger set takes several passes over the corpus.
ITEMS_PER_PASS = 20_000

_HIDDEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_TAG = re.compile(r"<[^<>]{0,300}>")
#: A word, or one character of a script that is written without blanks.
_BARE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_BARE}]|[^\W_{_BARE}]+")
#: UTF-8 read as cp1252 and written again.
_DAMAGE = re.compile("[ÂÃ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")
#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("авеёікмнорстухѕјαβεηικμνορτυχ", "abeeikmhopctyxsjabenikmvoptux")


def _mend(m: re.Match) -> str:
    raw = b""
    for c in m[0]:
        try:
            raw += c.encode("cp1252")
        except UnicodeEncodeError:
            raw += c.encode("latin-1")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def normal_words(text: str) -> list[str]:
    """Words in one spelling whatever markup, case, accents, invisible characters or damaged encoding they came in."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
        if "Ã" in text or "Â" in text:
            text = _DAMAGE.sub(_mend, text)
        text = unicodedata.normalize("NFKD", text.casefold())
        text = "".join(c for c in text if not unicodedata.combining(c))
        text = text.translate(_LOOKALIKES).replace("œ", "oe").replace("æ", "ae")
    else:
        text = text.lower()
    return _WORD.findall(text)


#: Pieces of a text that have the same words alone as in it; the first of these that does is used.
_PIECES = [re.compile(p) for p in (r"[^\s,.:;!?()\[\]\"/|_–—…«»“”-]+", r"[^ \t\r\n\f\v,.:;!?()\[\]\"/|_-]+", r"\S+")]


def _placed_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """``normal_words`` of the text and the pieces of it that they stand in; the whole text if no cut into pieces keeps the words."""
    words = normal_words(text)
    blank = _TAG.sub(lambda m: " " * len(m[0]), text)
    for piece in _PIECES:
        found, spans = [], []
        for m in piece.finditer(blank):
            w = normal_words(m[0])
            found += w
            spans += [m.span()] * len(w)
        if found == words:
            return words, spans
    return words, [(0, len(text))] * len(words)


def _without(text: str, spans: list[tuple[int, int]], covered: np.ndarray) -> str:
    """The text without the pieces that hold a covered word."""
    left, end = [], 0
    for a, b in sorted({spans[k] for k in np.flatnonzero(covered)}):
        left.append(text[end:a].strip())
        end = b
    left.append(text[end:].strip())
    return " ".join(x for x in left if x)


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every window of n word ids."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for k in range(n):
        h += ids[k : len(ids) - n + 1 + k].astype(np.uint64) * _MULTIPLIERS[k]
    return h ^ (h >> np.uint64(29))


class ItemIndex:
    """The items' vocabulary and n-grams; small, and broadcast."""

    def __init__(self, items: list[tuple[int, str]], n: int = N):
        self.n, self.vocabulary, self.items, self.size = n, {}, [], []
        grams: list[np.ndarray] = []
        place: list[tuple[int, int]] = []
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in normal_words(text or "")], dtype=np.int64)
            g = _grams(ids, n)
            grams += [np.stack([ids[k : len(ids) - n + 1 + k] for k in range(n)], 1)] if len(g) else []
            place += [(len(self.items), k) for k in range(len(g))]
            self.items.append(item_id)
            self.size.append(len(ids))
        words = np.concatenate(grams) if grams else np.zeros((0, n), np.int64)
        # equal n-grams share one number
        self.words, back = np.unique(words, axis=0, return_inverse=True) if len(words) else (words, np.zeros(0, np.int64))
        hashes = np.zeros(len(self.words), dtype=np.uint64)
        for k in range(n):
            hashes += self.words[:, k].astype(np.uint64) * _MULTIPLIERS[k]
        hashes ^= hashes >> np.uint64(29)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.mask = np.zeros(1 << 20, dtype=bool)
        self.mask[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(len(self.words))]
        for g, p in zip(back.ravel(), place):
            self.at[g].append(p)
        # items too short for an n-gram count as one of their own, which only a whole text can hold
        self.short: dict[tuple, int] = {}
        for i, (item_id, text) in enumerate(items):
            if 0 < self.size[i] < n:
                key = tuple(self.vocabulary[w] for w in normal_words(text))
                if key not in self.short:
                    self.short[key] = len(self.at)
                    self.at.append([])
                self.at[self.short[key]].append((i, 0))

    def text_of(self, g: int) -> str:
        """The words of an n-gram."""
        if not hasattr(self, "_spelt"):
            self._spelt = {k: w for w, k in self.vocabulary.items()}
            self._whole = {g: k for k, g in self.short.items()}
        ids = self.words[g] if g < len(self.words) else self._whole[g]
        return " ".join(self._spelt[k] for k in ids)

    def covers(self, i: int, p: int) -> range:
        """Words of item i that an n-gram at p covers."""
        return range(p, min(p + self.n, self.size[i]))

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window starts in ``ids`` and the numbers of the n-grams that stand there, checked word by word."""
        if len(ids) < self.n or not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = _grams(ids, self.n)
        w = np.flatnonzero(self.mask[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.sorted, h[w])
        at[at == len(self.sorted)] = 0
        ok = self.sorted[at] == h[w]
        w, g = w[ok], self.order[at[ok]]
        same = np.ones(len(w), dtype=bool)
        for k in range(self.n):
            same &= ids[w + k] == self.words[g, k]
        return w[same], g[same]


def _scan(docs: DataFrame, index) -> DataFrame:
    """(doc_id, grams): the distinct item n-grams of every document that has any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        get = ix.vocabulary.get

        def block(keys: list, parts: list) -> pd.DataFrame:
            words = np.concatenate(parts)
            ends = np.cumsum([len(p) for p in parts])
            at, g = ix.hits(words)
            doc = np.searchsorted(ends, at, side="right")
            if ix.short:
                whole = [(d, ix.short[tuple(p[: len(p) - ix.n].tolist())]) for d, p in enumerate(parts) if len(p) < 2 * ix.n and tuple(p[: len(p) - ix.n].tolist()) in ix.short]
                doc, g = np.concatenate([doc, [d for d, _ in whole]]).astype(np.int64), np.concatenate([g, [x for _, x in whole]]).astype(np.int64)
            pairs = np.unique(np.stack([doc, g], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
            who, first = np.unique(pairs[:, 0], return_index=True)
            if not len(who):
                return pd.DataFrame({"doc_id": [], "grams": []}, dtype=object)
            return pd.DataFrame({"doc_id": [keys[i] for i in who], "grams": [x.astype(np.int32) for x in np.split(pairs[:, 1], first[1:])]})

        for b in batches:
            keys, parts, held = [], [], 0
            for key, text in zip(b["doc_id"], b["text"]):
                if not isinstance(text, str) or not text:
                    continue
                words = normal_words(text)
                ids = np.zeros(len(words) + ix.n, dtype=np.int64)  # zeros behind a document keep windows inside it
                ids[: len(words)] = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
                keys.append(key)
                parts.append(ids)
                held += len(ids)
                if held > 2_000_000:
                    yield block(keys, parts)
                    keys, parts, held = [], [], 0
            if keys:
                yield block(keys, parts)

    return over_keys(docs.select("doc_id", "text"), "doc_id", run, "grams array<int>")


def _copies(hits: DataFrame, sent, often: set[int], cover: float) -> DataFrame:
    """(g, whole, either): for n-grams of ``often``, the documents that hold one of its items as a whole, and those that
    do so or else hold enough of every item it belongs to."""
    asked = hits.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix, often_known = sent.value, asked.value
        # the words of these items that no n-gram of ``often`` covers
        within: dict[int, set] = {}
        for g in often_known:
            for i, p in ix.at[g]:
                within.setdefault(i, set()).update(ix.covers(i, p))
        rest = {i: set(range(ix.size[i])) - s for i, s in within.items()}
        owners = {g: {i for i, _ in ix.at[g]} for g in often_known}
        n_whole, n_either = dict.fromkeys(often_known, 0), dict.fromkeys(often_known, 0)
        for b in batches:
            for grams in b["grams"]:
                asked_here = [g for g in grams.tolist() if g in often_known]
                if not asked_here:
                    continue
                seen: dict[int, set] = {}
                for g in grams:
                    for i, p in ix.at[g]:
                        seen.setdefault(i, set()).update(ix.covers(i, p))
                enough = {i for i, s in seen.items() if len(s) >= cover * ix.size[i]}
                whole = {i for i in enough if i in rest and (len(rest[i]) <= REST * ix.size[i] or len(rest[i] & seen[i]) >= cover * len(rest[i]))}
                for g in asked_here:
                    one = not owners[g].isdisjoint(whole)
                    n_whole[g] += one
                    n_either[g] += one or owners[g] <= enough
        if n_either:
            yield pd.DataFrame({"g": list(n_either), "whole": list(n_whole.values()), "either": list(n_either.values())})

    counts = hits.select("grams").mapInPandas(run, "g int, whole long, either long")
    return counts.groupBy("g").agg(F.sum("whole").alias("whole"), F.sum("either").alias("either"))


def _pass(docs: DataFrame, items: list[tuple[int, str]], limit: float, n: int, cover: float):
    """(hits, index, often) of one pass; ``often`` has (text, df, whole, either) by number of the n-grams in more than ``limit`` documents."""
    spark = docs.sparkSession
    index = ItemIndex(items, n)
    sent = spark.sparkContext.broadcast(index)
    hits = written(_scan(docs, sent), "hits")
    # at most as many rows as the items of this pass have n-grams
    df = hits.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > limit)
    df = {r["g"]: r["df"] for r in df.collect()}
    if not df:
        return hits, sent, {}
    copies = {r["g"]: r for r in _copies(hits, sent, set(df), cover).collect()}
    return hits, sent, {g: (index.text_of(g), df[g], copies[g]["whole"], copies[g]["either"]) for g in df}


def _blocks(items: DataFrame, items_per_pass: int) -> Iterator[list[tuple[int, str]]]:
    """(item_id, text) lists of about ``items_per_pass`` items at most, dealt by hash; a first list, if empty, for a table without items."""
    n = items.count()
    parts = 1 if n <= items_per_pass else math.ceil(n / max(1, items_per_pass // 2))
    for k in range(parts):
        block = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield sorted((r["item_id"], r["text"]) for r in block.toLocalIterator())


def _judged(hits: DataFrame, sent, common: set[int], cover: float) -> DataFrame:
    usual = hits.sparkSession.sparkContext.broadcast(common)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix, everywhere_known = sent.value, usual.value
        # words that only n-grams from everywhere cover don't belong to an item's own text
        own = [np.zeros(s, dtype=bool) for s in ix.size]
        for g, places in enumerate(ix.at):
            if g not in everywhere_known:
                for i, p in places:
                    own[i][p : p + ix.n] = True
        total = [int(x.sum()) for x in own]
        for b in batches:
            out = []
            for key, grams in zip(b["doc_id"], b["grams"]):
                seen: dict[int, set] = {}
                for g in grams:
                    if g not in everywhere_known:
                        for i, p in ix.at[g]:
                            seen.setdefault(i, set()).update(ix.covers(i, p))
                out += [(key, ix.items[i], len(s) / total[i], len(s)) for i, s in seen.items() if len(s) >= cover * total[i] and len(s) >= cover * 0.5 * ix.size[i]]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "covered", "n_words"])

    return over_keys(hits, "doc_id", judge, "item_id bigint, covered double, n_words int")


def find_leaks(docs: DataFrame, items: DataFrame, n: int = N, cover: float = COVER, everywhere: float = EVERYWHERE, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """(doc_id, item_id, covered, n_words): every document with every item it leaks.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are not read.  Null, empty and
    blank texts leak nothing, items of fewer than ``n`` words are leaked by documents of just these words, characters of scripts
    without blanks are words, repeated documents and items are reported each.  Items come to the driver ``items_per_pass`` at a time, ordered by item_id; each pass scans all documents.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    items = items.select("item_id", "text").filter("text is not null")
    n_docs, passes, found = docs.count(), [], None
    for rows in _blocks(items, items_per_pass):
        passes.append(_pass(docs, rows, max(2.0, everywhere * n_docs), n, cover))
    # an item that many documents copy as a whole is no text from everywhere; an n-gram may stand in items of several passes
    whole: dict[str, int] = {}
    either: dict[str, int] = {}
    for _, _, often in passes:
        for text, _, w, e in often.values():
            whole[text], either[text] = max(w, whole.get(text, 0)), min(e, either.get(text, e))
    for hits, sent, often in passes:
        common = {g for g, (text, df, _, _) in often.items() if max(whole[text], either[text]) < 0.5 * df}
        part = _judged(hits, sent, common, cover)
        found = part if found is None else found.unionByName(part)
    return found


def remove_leaks(docs: DataFrame, items: DataFrame, leaks: DataFrame, mode: str = "documents", n: int = N, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """``docs`` without the leaking documents, or (``mode`` "spans") without the words that n-grams of the items they leak cover,
    over sentence ends too, and without sentences that these items cover by half.

    Only leaked items are sent to the documents, ``items_per_pass`` at a time.
    """
    if mode == "documents":
        return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
    ship(docs.sparkSession)
    # of a document's items only, at most as many as it leaks
    bad = leaks.groupBy("doc_id").agg(F.collect_set(F.col("item_id").cast("string")).alias("__leaks"))
    flagged = docs.join(bad, "doc_id", "left")
    clean, cutting = flagged.filter("__leaks is null").drop("__leaks"), flagged.filter("__leaks is not null")
    leaked = items.select("item_id", "text").filter("text is not null").join(leaks.select("item_id").distinct(), "item_id", "left_semi")
    for rows in _blocks(leaked, items_per_pass):
        cutting = cutting.withColumn("text", _cutter(docs.sparkSession.sparkContext.broadcast(ItemIndex(rows, n)))("text", "__leaks"))
    return clean.unionByName(cutting.drop("__leaks"))


def _cutter(index):
    """A function of (text, leaked item ids) that leaves out what the leaked items of this index cover."""

    def cut(texts: pd.Series, leaked: pd.Series) -> pd.Series:
        ix = index.value
        named = [str(i) for i in ix.items]

        def mark(ids: np.ndarray, mine: set) -> np.ndarray:
            covered = np.zeros(len(ids), dtype=bool)
            for a, g in zip(*ix.hits(ids)):
                if any(named[i] in mine for i, _ in ix.at[g]):
                    covered[a : a + ix.n] = True
            whole = ix.short.get(tuple(ids.tolist()))
            if whole is not None and any(named[i] in mine for i, _ in ix.at[whole]):
                covered[:] = True
            return covered

        def one(text: str | None, mine: set) -> str | None:
            if not isinstance(text, str):
                return None
            sentences = re.split(r"(?<=[.!?;])\s+|\n+", text)
            placed = [_placed_words(s) for s in sentences]
            ids = [np.array([ix.vocabulary.get(w, 0) for w in words], dtype=np.int64) for words, _ in placed]
            own = np.split(mark(np.concatenate(ids), mine), np.cumsum([len(x) for x in ids])[:-1])
            keep = []
            for s, (_, spans), x, covered in zip(sentences, placed, ids, own):
                if len(x) and mark(x, mine).mean() >= 0.5:
                    continue
                left = _without(s, spans, covered) if covered.any() else s
                if left == s or _WORD.search(left):
                    keep.append(left)
            return " ".join(keep)

        return pd.Series([one(t, set(m)) for t, m in zip(texts, leaked)], index=texts.index, dtype=object)

    return F.pandas_udf(cut, "string")
