"""Matching entities across sources without keys: collective graph linkage.

1. Every record becomes a set of attributes: postcode, map cells, pairs of town and name
   words.  Which towns of the two sources can agree, slips included, is found once for all towns.  Records that share
   attributes and whose towns can agree are linked; the rarer the shared attributes there, the heavier the link.
   Pairs whose towns cannot agree never meet, since the comparison rejects them whatever else they share.
2. Meta-blocking drops links much lighter than the best ones of their records.
3. Each remaining pair is compared in full (names word by word with misspellings,
   quarter, chain, town, postcode, distance); the weight of its link adds to the score.
4. Scores are refined until stable: a pair loses to rivals that explain the same record
   better and gains from its neighbours, pairs of the same left record with right records that are alike.
5. Confidence is fitted on a bounded sample of pairs whose postcodes tell whether they are one, from scores without the postcode.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harbormill.session import discard, ship, written

#: Short forms in names.
SHORT = {
    "htl": "hotel", "hotels": "hotel", "apts": "apartments", "apt": "apartments", "apartment": "apartments", "stes": "suites", "ste": "suites", "suite": "suites",
    "rsrt": "resort", "btq": "boutique", "gst": "guest", "hse": "house", "st": "saint", "sint": "saint", "res": "residence", "ldg": "lodge", "mtl": "motel",
    "stn": "station", "sta": "station", "rail": "railway", "univ": "university", "intl": "international", "ctr": "center", "centre": "center", "dtn": "downtown", "dwtn": "downtown", "dwntn": "downtown", "dwntwn": "downtown", "n": "north", "s": "south", "e": "east", "w": "west",
    "conv": "convention", "arpt": "airport", "rly": "railway", "twn": "town", "harbor": "harbour", "mt": "mount", "bnb": "b",
}
#: Words that many names have and that tell hotels apart badly.
GENERIC = frozenset(
    "the a an and of at by in de la le el hotel inn suites resort house guest boutique lodge apartments motel residence spa b express rooms collection palace club hostel llc ltd inc gmbh sa".split()
)
#: Parts of a town.
QUARTERS = frozenset("north south east west airport downtown university riverside harbour old town convention center railway station central beachfront midtown uptown lakeside".split())
#: Edges of a record that meta-blocking keeps at least, and the share of its heaviest edge that others need.
KEEP_EDGES, KEEP_SHARE = 6, 0.35
#: Formerly the pairs from which on a block was divided by towns.  Every block is now, whatever its size, and nothing reads this but the tests.
BLOCK = 400
ROUNDS, SETTLED = 6, 1e-3
#: What a link twice as heavy (by a factor of e) as usual adds to a score.
RARITY = 0.25
#: Pairs that the confidence is fitted on, at most, in the order of a hash.
SAMPLE = 20_000

_WORD = re.compile(r"[a-z0-9]+")


def fold(text: str | None) -> str:
    if not isinstance(text, str):
        return ""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def name_words(text: str | None, town: list[str]) -> list[str]:
    """Words of a name in long forms, without a trailing or leading "by Brand" and without the town's words."""
    text = fold(text).replace("&", " and ").replace("'", "")
    words = [SHORT.get(w, w) for w in _WORD.findall(text)]
    for i, w in enumerate(words):
        if w == "by" and i + 1 < len(words) and len(words) > 3:
            words = words[:i] + words[i + 2 :]
            break
    # a town of several words is taken out word by word; single letters and short words only as written
    gone = [t for t in town if len(t) > 3]
    out = []
    for w in words:
        if w in town or any(near(w, t) for t in gone):
            continue
        out.append(w)
    return out


@lru_cache(maxsize=100_000)
def near(a: str, b: str) -> bool:
    """Equal but for a slip: one or (in long words) two changed, missing, added or swapped letters."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    allowed = 0 if min(la, lb) < 4 else 1 if min(la, lb) < 9 else 2
    if abs(la - lb) > allowed or not allowed:
        return False
    before, row = [], list(range(lb + 1))
    for i in range(1, la + 1):
        new = [i] + [0] * lb
        for j in range(1, lb + 1):
            same = a[i - 1] == b[j - 1]
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (not same))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                new[j] = min(new[j], before[j - 2] + 1)
        if min(new) > allowed:
            return False
        before, row = row, new
    return row[lb] <= allowed


def plain_code(code: str | None) -> str:
    return re.sub("[^A-Z0-9]", "", fold(code).upper())


def split_words(words: list[str], brands: frozenset = frozenset()) -> tuple[list[str], list[str]]:
    """(telling words, quarter words)."""
    telling, quarter = [], []
    for w in dict.fromkeys(words):
        if w in QUARTERS or (len(w) > 4 and any(near(w, q) for q in QUARTERS if len(q) > 4)):
            quarter.append(next((q for q in QUARTERS if q == w), None) or next(q for q in QUARTERS if len(q) > 4 and near(w, q)))
        elif w not in GENERIC and not (len(w) > 4 and any(near(w, g) for g in GENERIC if len(g) > 4)):
            telling.append(w)
    return telling, quarter


def town_words(*texts: str | None) -> list[str]:
    out: dict[str, None] = {}
    for t in texts:
        out |= dict.fromkeys(_WORD.findall(fold(t)))
    return list(out)


def attributes(town: list[str], names: list[list[str]], code: str, lat, lon, spread: bool) -> list[str]:
    """Blocking attributes of a record.  ``spread`` gives all map cells of a doubled side that touch the neighbourhood, for one side only."""
    out: dict[str, None] = {}
    if len(code) >= 5:
        out["p|" + code] = None
    if lat is not None and lon is not None and lat == lat and lon == lon:
        i, j = math.floor(lat / 0.005), math.floor(lon / 0.005)
        for di in (-1, 1) if spread else (0,):
            for dj in (-1, 1) if spread else (0,):
                out[f"g|{(i + di) // 2}|{(j + dj) // 2}"] = None
    places = [t for t in town if len(t) > 4] + ([code[:4]] if len(code) >= 5 else [])
    for words in names:
        telling, quarter = split_words(words)
        for w in telling:
            for t in places:
                out[f"t|{t}|{w}"] = None
        if not telling:
            for w in quarter:
                for t in places:
                    out[f"q|{t}|{w}"] = None
        for i, a in enumerate(sorted(telling)):
            for b in sorted(telling)[i + 1 :]:
                out[f"n|{a}|{b}"] = None
        for a in telling:
            for q in quarter:
                out[f"c|{a}|{q}|{town[0] if town else ''}"] = None
                if town:  # one slip in the town leaves its beginning or its end
                    out[f"b|{a}|{q}|{town[0][:4]}"] = out[f"e|{a}|{q}|{town[0][-4:]}"] = None
    return list(out)


def _match(a: list[str], b: list[str]) -> int:
    left, n = list(b), 0
    for w in a:
        hit = next((x for x in left if x == w), None) or next((x for x in left if near(w, x)), None)
        if hit is not None:
            left.remove(hit)
            n += 1
    return n


def town_keys(town: list[str]) -> list[str]:
    """Keys that two lists of town words share if a word of one equals one of the other but for a slip, as ``near`` has it."""
    out: dict[str, None] = {}
    for w in town:
        if len(w) < 4:
            continue
        layer = {w}
        for _ in range(1 if len(w) < 9 else 2):
            layer |= {x[:k] + x[k + 1 :] for x in layer for k in range(len(x))}
        out |= dict.fromkeys(sorted(layer))
    return list(out)


def compare(a: dict, b: dict) -> tuple[float, float]:
    """Similarity of two records in log-odds, and what of it the postcodes give; a and b have town, names (lists of words), code, lat, lon."""
    score, by_code = -3.0, 0.0
    # towns
    ta, tb = [t for t in a["town"] if len(t) > 3], [t for t in b["town"] if len(t) > 3]
    if ta and tb:
        m = _match(ta, tb)
        # at least the first, proper word of the town has to agree
        if m == 0 or not (near(ta[0], tb[0]) or (m >= 2)):
            return -9.0, 0.0
        score += 1.0 if m >= min(len(ta), len(tb)) else 0.0
    elif ta or tb:
        # the side without a town may carry the other's town in its name
        known, bare = (ta, b) if ta else (tb, a)
        spelt = [[w for w in words if not any(near(w, t) for t in known)] for words in bare["names"]]
        if any(len(x) < len(y) for x, y in zip(spelt, bare["names"])):
            score += 1.0
            bare = dict(bare, names=[x for x in spelt if x])
            a, b = (a, bare) if ta else (bare, b)
    # places
    if len(a["code"]) >= 5 and len(b["code"]) >= 5:
        if a["code"] == b["code"]:
            by_code = 5.0
        elif a["code"][:4] != b["code"][:4]:
            return -9.0, 0.0
        else:
            by_code = -4.0
    near_by = None
    if None not in (a["lat"], a["lon"], b["lat"], b["lon"]) and all(x == x for x in (a["lat"], a["lon"], b["lat"], b["lon"])):
        d = math.hypot(a["lat"] - b["lat"], (a["lon"] - b["lon"]))
        near_by = d < 0.006
        score += 3.0 if d < 0.0045 else 1.0 if near_by else -2.0 if d < 0.012 else -6.0
    # names: the best pair of spellings
    best = -5.0
    for wa in a["names"]:
        na, qa = split_words(wa)
        for wb in b["names"]:
            nb, qb = split_words(wb)
            m, ma, mb = _match(na, nb), len(na), len(nb)
            s = 0.0
            if ma and mb:
                s += 2.2 * m - 1.6 * (min(ma, mb) - m) - 0.7 * (max(ma, mb) - min(ma, mb))
                if m == 0:
                    s -= 2.0
            q = _match(qa, qb)
            if qa and qb:
                s += 1.5 * q if q == min(len(qa), len(qb)) else -6.0
            elif qa or qb:
                s -= 1.0
            if wa == wb:
                s += 0.5
            best = max(best, s)
    return score + by_code + best, by_code


def _prepare(df: DataFrame, key: str, names: list[str], town: list[str], code: str, lat: str, lon: str) -> DataFrame:
    """(key, town, names, code, lat, lon, th): one row per distinct key, with all spellings that its rows carry; ``th`` is the hash of
    the words that ``compare`` holds towns against, null without any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                places = town_words(*r.towns)
                spelt = []
                for t in dict.fromkeys(x for x in r.names if isinstance(x, str) and x.strip()):
                    w = name_words(t, places)
                    if w and w not in spelt:
                        spelt.append(w)
                own = plain_code(r.code)
                la = None if r.lat is None or r.lat != r.lat else float(r.lat)
                lo = None if r.lon is None or r.lon != r.lon else float(r.lon)
                if la is None or lo is None or (la == 0 and lo == 0):  # no place at all
                    la = lo = None
                out.append((r.key, places, [" ".join(w) for w in spelt], own, la, lo))
            yield pd.DataFrame(out, columns=["key", "town", "names", "code", "lat", "lon"])

    def first(c: str):
        return F.max(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) if c in (lat, lon) else F.col(c))

    slim = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array(*names)))))).alias("names"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_compact(F.array(*town)))))).alias("towns"),
        first(code).alias("code"),
        first(lat).alias("lat"),
        first(lon).alias("lon"),
    )
    kind = slim.schema["key"].dataType.simpleString()
    ship(df.sparkSession)
    records = slim.mapInPandas(run, f"key {kind}, town array<string>, names array<string>, code string, lat double, lon double")
    place = F.filter("town", lambda w: F.length(w) > 3)
    return records.withColumn("th", F.when(F.size(place) > 0, F.xxhash64(F.array_join(place, " "))))


def _pieces(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """The batches in pieces, for functions that make many values of a row, so that few of these are held at once."""
    for f in batches:
        for lo in range(0, len(f), rows):
            yield f.iloc[lo : lo + rows]


def _attributes(records: DataFrame, spread: bool) -> DataFrame:
    """(rid, th, attrs)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _pieces(batches):
            rows = zip(f["town"], f["names"], f["code"], f["lat"], f["lon"])
            yield pd.DataFrame({"rid": f["rid"], "th": f["th"], "attrs": [attributes(list(t), [n.split() for n in names], code, la, lo, spread) for t, names, code, la, lo in rows]})

    slim = records.select("rid", F.col("th").cast("string"), *_RECORD)
    kind = records.schema["rid"].dataType.simpleString()
    return slim.mapInPandas(run, f"rid {kind}, th string, attrs array<string>").withColumn("th", F.col("th").cast("long"))


def _near_words(a: DataFrame, b: DataFrame) -> DataFrame:
    """(w, v): words of a and of b that are equal but for a slip; both sides have w."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _pieces(batches):
            yield pd.DataFrame([(w, k) for w in f["w"] for k in town_keys([w])], columns=["w", "k"])

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield f[np.array([near(w, v) for w, v in zip(f["w"], f["v"])], dtype=bool)]

    ka, kb = [x.distinct().mapInPandas(keys, "w string, k string").select("w", F.xxhash64("k").alias("k")) for x in (a, b)]
    return ka.join(kb.withColumnRenamed("w", "v"), "k").select("w", "v").distinct().mapInPandas(same, "w string, v string")


def _agreeing_towns(a: DataFrame, b: DataFrame) -> DataFrame:
    """(th, towns): for each town of a those of b that ``compare`` does not reject: the first words are near, or two words are.

    Two words are looked up from that word of b's town which fewer word pairs of a come near to, and then the other one is held
    against what is found; spellings of one word never multiply with those of the other."""
    place = F.filter("town", lambda w: F.length(w) > 3)
    ta, tb = [x.filter("th is not null").groupBy("th").agg(F.first("town").alias("town")).select("th", place.alias("place")) for x in (a, b)]
    near_words = written(_near_words(*[x.select(F.explode("place").alias("w")) for x in (ta, tb)]), "words", lean=True)
    firsts = ta.select("th", F.col("place")[0].alias("w")).join(near_words, "w").join(tb.select(F.col("th").alias("tb"), F.col("place")[0].alias("v")), "v").select("th", "tb")

    def ordered(t: DataFrame, first: str, second: str) -> DataFrame:
        words = t.select("th", "place", F.posexplode("place").alias("k1", first))
        return words.select("th", first, "k1", F.posexplode("place").alias("k2", second)).filter("k1 <> k2").drop("k1", "k2")

    # both orders of every two words of a; of b the order that begins with the word of the smaller reach
    pa = written(ordered(ta, "w", "x"), "pairs_a", lean=True)
    known = pa.select("w", "x").distinct()
    reach = known.groupBy("w").agg(F.count(F.lit(1)).alias("n")).join(near_words, "w").groupBy("v").agg(F.sum("n").alias("n"))
    both = ordered(tb, "v", "y").join(reach.withColumnRenamed("n", "n_v"), "v").join(reach.select(F.col("v").alias("y"), F.col("n").alias("n_y")), "y")
    pb = written(both.filter("n_v < n_y or (n_v = n_y and v < y)").select(F.col("th").alias("tb"), "v", "y"), "pairs_b", lean=True)
    met = known.join(near_words, "w").join(pb.select("v", "y").distinct(), "v").join(near_words.select(F.col("w").alias("x"), F.col("v").alias("y")), ["x", "y"])
    seconds = met.join(pa, ["w", "x"]).select("th", "v", "y").distinct().join(pb, ["v", "y"]).select("th", "tb")
    found = written(firsts.unionByName(seconds).groupBy("th").agg(F.collect_set("tb").alias("towns")), "towns", lean=True)
    for t in (near_words, pa, pb):
        discard(t)
    return found


#: Stand for a town that a record of b lacks, and for that of any record of b.
NO_TOWN, ANY_TOWN = 0, 1


def _candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, weight): pairs that share attributes and whose towns can agree, weighted by the attributes' rarity there, after meta-blocking."""
    agreeing = _agreeing_towns(a, b)
    # a record of a meets each attribute once for every town of b that agrees; records of b without a town meet all, as do those of a
    bare_a, bare_b = [not x.filter("th is null").isEmpty() for x in (a, b)]
    none = F.array().cast("array<bigint>")
    lone = F.array(F.lit(NO_TOWN).cast("long")) if bare_b else none
    pa = _attributes(a, False).withColumn("at", F.coalesce("th", "rid")).join(agreeing.withColumnRenamed("th", "at"), "at", "left")
    pa = pa.withColumn("towns", F.when(F.col("th").isNull(), F.array(F.lit(ANY_TOWN).cast("long"))).otherwise(F.concat(F.coalesce("towns", none), lone)))
    own = F.array(F.coalesce("th", F.lit(NO_TOWN).cast("long")))
    pb = _attributes(b, True).withColumn("towns", F.concat(own, F.array(F.lit(ANY_TOWN).cast("long"))) if bare_a else own)

    def keyed(p: DataFrame, name: str) -> DataFrame:
        rows = p.select(F.col("rid").alias(name), F.explode("attrs").alias("attr"), "towns").select(name, "attr", F.explode("towns").alias("town"))
        bare = F.when(F.col("town") == NO_TOWN, "b").when(F.col("town") == ANY_TOWN, "a")
        return rows.select(name, F.xxhash64("attr", "town").alias("key"), *[bare.alias("bare")] * (name == "a")).withColumn(f"n{name}", F.count(F.lit(1)).over(W.partitionBy("key")))

    links = keyed(pa, "a").join(keyed(pb, "b"), "key").select("a", "b", "bare", (F.lit(8.0) / F.log(F.lit(2.0) + F.col("na") * F.col("nb"))).alias("w"))
    edges = written(links.groupBy("a", "b").agg(F.sum("w").alias("weight"), F.first("bare").alias("bare")), "edges", lean=True)
    discard(agreeing)
    # weighted node pruning: an edge stays if it is among the heaviest of either end; where one end has no town and so
    # links to all towns, it is among that end's
    kept = edges
    for k in ("a", "b"):
        w = W.partitionBy(k)
        kept = kept.withColumn(f"max_{k}", F.max("weight").over(w)).withColumn(f"rk_{k}", F.rank().over(w.orderBy(F.desc("weight"))))
    keep = [(F.col("weight") >= KEEP_SHARE * F.col(f"max_{k}")) | (F.col(f"rk_{k}") <= KEEP_EDGES) for k in ("a", "b")]
    chosen = F.when(F.col("bare") == "a", keep[0]).when(F.col("bare") == "b", keep[1]).otherwise(keep[0] | keep[1])
    return kept.filter(chosen).select("a", "b", "weight")


_RECORD = ("town", "names", "code", "lat", "lon")


def _scored(edges: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, weight, own, blind, same_code, half, turn): compared pairs; ``blind`` leaves the postcodes out and ``same_code`` says whether they are
    equal, null where one is missing; ``half`` and ``turn`` are hashes of the records' own keys."""
    left = a.select(F.col("rid").alias("a"), F.col("key").alias("key_a"), *[F.col(c).alias(f"{c}_a") for c in _RECORD])
    right = b.select(F.col("rid").alias("b"), F.col("key").alias("key_b"), *[F.col(c).alias(f"{c}_b") for c in _RECORD])
    full = edges.join(right, "b").join(left, "a").withColumns({"half": F.xxhash64("key_a", "key_b"), "turn": F.xxhash64("key_b", "key_a")}).drop("key_a", "key_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def none(x):
            return None if x is None or x != x else x

        for f in batches:
            own, blind, same = [], [], []
            for r in f.itertuples(index=False):
                x = {"town": list(r.town_a), "names": [n.split() for n in r.names_a], "code": r.code_a, "lat": none(r.lat_a), "lon": none(r.lon_a)}
                y = {"town": list(r.town_b), "names": [n.split() for n in r.names_b], "code": r.code_b, "lat": none(r.lat_b), "lon": none(r.lon_b)}
                score, by_code = compare(x, y)
                own.append(score)
                blind.append(score - by_code)
                both = len(x["code"]) >= 5 and len(y["code"]) >= 5
                same.append(x["code"] == y["code"] if both else None)
            yield pd.DataFrame({"a": f["a"], "b": f["b"], "weight": f["weight"], "own": own, "blind": blind, "same_code": pd.array(same, dtype="boolean"), "half": f["half"], "turn": f["turn"]})

    ship(edges.sparkSession)
    ka, kb = edges.schema["a"].dataType.simpleString(), edges.schema["b"].dataType.simpleString()
    return full.mapInPandas(run, f"a {ka}, b {kb}, weight double, own double, blind double, same_code boolean, half long, turn long")


def _alike(pairs: DataFrame, b: DataFrame) -> DataFrame:
    """(t1, t2, likeness): right records that compete for one left record and are alike themselves, both ways."""
    rivals = pairs.select("a", F.col("b").alias("t1")).join(pairs.select("a", F.col("b").alias("t2")), "a").filter("t1 < t2").select(F.col("t1").alias("a"), F.col("t2").alias("b")).distinct()
    scored = _scored(rivals.withColumn("weight", F.lit(1.0)), b, b).filter("own > 0")
    likeness = 1 / (1 + F.exp(-F.col("own")))
    return scored.select(F.col("a").alias("t1"), F.col("b").alias("t2"), likeness.alias("likeness")).unionByName(scored.select(F.col("b").alias("t1"), F.col("a").alias("t2"), likeness.alias("likeness")))


def fit_confidence(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, shift) of a logistic curve of the scores by Newton's method; ten pseudo-pairs along the plain curve steady it."""
    z = np.linspace(-4, 4, 10)
    p0 = 1 / (1 + np.exp(-z))
    x, y, n = np.concatenate([x, z, z]), np.concatenate([y, np.ones(10), np.zeros(10)]), np.concatenate([np.ones(len(x)), p0, 1 - p0])
    w = np.array([1.0, 0.0])
    m = np.stack([x, np.ones(len(x))], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        h = (m * (n * p * (1 - p))[:, None]).T @ m + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, m.T @ (n * (y - p)))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def link(a: DataFrame, b: DataFrame, rounds: int = ROUNDS, sample: int = SAMPLE) -> DataFrame:
    """(a, b, own, blind, same_code, score, held_out, confidence, blind_confidence) for every compared pair of prepared records (``_prepare``).

    Each round takes from a pair what the best rival for the same ``b`` has ahead of it, and lends it part of
    what its neighbours have, as far as they are alike; it ends when no score moves by more than ``SETTLED``.
    """
    pairs = written(_scored(_candidates(a, b), a, b).filter("own > -4"), "pairs", lean=True)
    usual = pairs.agg(F.avg(F.log("weight")).alias("usual"))
    base = pairs.crossJoin(F.broadcast(usual)).withColumn("base", F.col("own") + F.least(F.lit(1.0), F.greatest(F.lit(-1.0), RARITY * (F.log("weight") - F.col("usual")))))
    keep = ["a", "b", "own", "blind", "same_code", "half", "turn", "base"]
    state = table = written(base.select(*keep).withColumn("score", F.col("base")), "scores", lean=True)
    alike = written(_alike(pairs, b), "alike", lean=True) if rounds else None
    for _ in range(rounds):
        rivals = W.partitionBy("b").orderBy(F.desc("score"), "a")
        best = W.partitionBy("b")
        step = state.withColumn("top", F.max("score").over(best)).withColumn("rk", F.row_number().over(rivals))
        second = F.max(F.when(F.col("rk") == 2, F.col("score"))).over(best)
        step = step.withColumn("rival", F.when(F.col("rk") == 1, second).otherwise(F.col("top")))
        lent = (
            alike.join(state.select(F.col("b").alias("t2"), F.col("a").alias("ta"), F.col("score").alias("ts")), "t2")
            .groupBy(F.col("t1").alias("tb"), "ta")
            .agg(F.max(F.col("likeness") * F.col("ts")).alias("lent"))
        )
        step = step.join(lent, (F.col("b") == F.col("tb")) & (F.col("a") == F.col("ta")), "left")
        ahead = F.greatest(F.lit(0.0), F.coalesce(F.col("rival") - F.col("score"), F.lit(0.0)))
        gain = F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.coalesce(F.col("lent"), F.lit(0.0))) * 0.4)
        new = F.col("base") + gain - F.least(F.lit(4.0), 1.5 * ahead)
        step = written(step.select(*keep, "score", new.alias("new")), "scores", lean=True)
        discard(table)
        table = step
        moved = step.agg(F.max(F.abs(F.col("new") - F.col("score")))).first()[0]
        state = step.select(*keep, F.col("new").alias("score"))
        if moved is None or moved <= SETTLED:
            break
    # what rivals and neighbours have changed counts in the fit as well; only the postcode is left out
    blind = F.col("score") - F.col("own") + F.col("blind")
    state = state.withColumn("held_out", F.pmod(F.col("half"), F.lit(2)) == 1)
    told = state.filter("same_code is not null and not held_out").select(blind.alias("x"), F.col("same_code").cast("int").alias("y"), F.col("turn").alias("h"))
    seen = told.orderBy("h", "x").limit(sample).toPandas()
    slope, shift = fit_confidence(seen["x"].to_numpy(float), seen["y"].to_numpy(float))
    curve = lambda x: 1 / (1 + F.exp(-(slope * x + shift)))
    state = state.withColumn("confidence", curve(F.col("score"))).withColumn("blind_confidence", curve(blind))
    for side, name in ((a, "a"), (b, "b")):
        state = state.withColumnRenamed(name, "rid").join(side.select("rid", F.col("key").alias(name)), "rid").drop("rid")
    return state.drop("half", "turn")


def calibration(scored: DataFrame) -> DataFrame:
    """(lowest, n, mean_confidence, share_same): pairs held out of the fit by tenths of the confidence they get without the postcode, and how many share it."""
    held = scored.filter("held_out and same_code is not null").withColumn("lowest", F.floor(F.least(F.col("blind_confidence"), F.lit(0.999)) * 10) / 10)
    return held.groupBy("lowest").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("blind_confidence"), 4).alias("mean_confidence"), F.round(F.avg(F.col("same_code").cast("int")), 4).alias("share_same"))


def _towns_by_place(rows: DataFrame) -> DataFrame:
    """(place, town): the town that most records of a map cell or postcode area name; rows have town, code, lat, lon."""
    cell = F.when((F.col("lat") != 0) | (F.col("lon") != 0), F.concat_ws("|", F.lit("g"), F.floor(F.col("lat") / 0.1), F.floor(F.col("lon") / 0.1)))
    area = F.when(F.length("code") >= 5, F.concat(F.lit("p|"), F.upper(F.substring(F.regexp_replace("code", "[^A-Za-z0-9]", ""), 1, 4))))
    places = F.array_compact(F.array(F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"), cell), area))
    return rows.select("*", places.alias("places"))


def _with_known_town(side: DataFrame, others: DataFrame) -> DataFrame:
    """``side`` with t9, the town that its place stands for, where it names none itself."""
    named = _towns_by_place(others.unionByName(side.select("town", "code", "lat", "lon"))).filter("town is not null")
    votes = named.select(F.explode("places").alias("place"), F.lower("town").alias("town")).groupBy("place", "town").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("place").agg(F.max_by("town", F.struct("n", "town")).alias("t9"))
    asking = _towns_by_place(side).withColumn("place", F.when(F.col("town").isNull(), F.element_at(F.concat("places", F.array(F.lit(None).cast("string"))), 1))).drop("places")
    known = asking.filter("place is null").drop("place").withColumn("t9", F.lit(None).cast("string"))
    return known.unionByName(asking.filter("place is not null").join(best, "place", "left").drop("place"))


def hotel_links(images: DataFrame, registry: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``link`` of image rows (a is ta_hotel_id) and registry records (b is id)."""
    slug = F.regexp_extract("ta_hotel_id", r"-Reviews-(.*)-[^-]*\.html?", 1)
    town = F.regexp_replace(F.regexp_extract("ta_hotel_id", r"-([^-]*)\.html?$", 1), "_", " ")
    left = images.select(
        "ta_hotel_id", F.regexp_replace(slug, "_", " ").alias("n1"), F.col("ta_name").alias("n2"), F.col("hotel_name").alias("n3"),
        F.when(town != "", town).alias("t1"), F.when(town == "", F.col("ta_city")).alias("t2"), F.col("ta_postcode").alias("code"), F.col("ta_lat").alias("lat"), F.col("ta_lon").alias("lon"),
    )
    # the long text keys of a are replaced by numbers until the end
    a = written(_prepare(left, "ta_hotel_id", ["n1", "n2", "n3"], ["t1", "t2"], "code", "lat", "lon").withColumn("rid", F.monotonically_increasing_id()), "left", lean=True)
    city = F.when(F.trim("city") != "", F.col("city"))
    right = registry.select(F.col("id").alias("hid"), F.col("hotel_name").alias("n1"), city.alias("town"), F.col("postcode").alias("code"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    right = _with_known_town(right, left.select(F.coalesce("t1", "t2").alias("town"), "code", "lat", "lon"))
    b = written(_prepare(right, "hid", ["n1"], ["town", "t9"], "code", "lat", "lon").withColumn("rid", F.monotonically_increasing_id()), "right", lean=True)
    return link(a, b, rounds)


def match_hotels(images: DataFrame, registry: DataFrame, sure: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """(ta_hotel_id, hotel_info_id, confidence): the pairs of records of one hotel.

    The town of an image row is also read from its ``ta_hotel_id``.  Rows delivered twice count once with all
    their spellings; null keys are left out; null or empty names and places only take away evidence; an empty
    side gives no pairs; extra columns are not read.
    """
    scored = hotel_links(images, registry, rounds)
    return scored.filter(F.col("confidence") > sure).select(F.col("a").alias("ta_hotel_id"), F.col("b").cast("long").alias("hotel_info_id"), "confidence")
