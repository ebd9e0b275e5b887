"""Keyword-stuffed and link-list pages: bagged decision trees on content and link features.

1. Words that join others (articles, prepositions ...) are learned from the corpus, in any language: they are
   frequent and hardly ever stand before a mark or a line's end.
2. Each text is read once into content and link features (shares of links, tags, repeated phrases and lists ...) and,
   apart from these, into five signals for weak labels: words in sentences, compressed size, phrases that come
   again, anchors a word, characters that are no letters.  The trees see none of the signals.
3. Each signal votes spam, honest or not at all.  Expectation-maximisation over the patterns of votes learns how far
   each vote is to be trusted; pages whose posterior is not clear have no label.
4. Bagged trees are fitted on a bounded sample of labelled pages and predict all pages.
5. Predictions are smoothed by the spam rate of the page's host, its own prediction left out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbormill.session import over_keys, written

#: Joining words have at least this share of all words (so there are at most its inverse), and at most this share of them stands before a mark.
JOIN_SHARE, JOIN_MARKED = 2e-4, 0.02
FEATURES = ("n", "links", "tags", "repeats", "bare", "function_rate", "ends_rate", "distinct_rate", "numbers_rate", "separators_rate", "mean_length")
SIGNALS = ("sentences", "squeezed", "again", "anchors", "marks")
#: From where on a signal votes spam, and from where on honest; between them it abstains.
VOTES = {"sentences": (0.3, 0.7), "squeezed": (0.7, 0.9), "again": (0.5, 0.1), "anchors": (0.4, 0.02), "marks": (0.16, 0.08)}
#: Texts of fewer words are too short to miss sentences in, or to count marks.
SHORT = 8
#: A page is labelled if the posterior of its votes is at least this far from even.
CLEAR = 0.95
#: Weakly labelled pages of each kind that the trees are fitted on, at most.
SAMPLE = 10_000
#: Weight of the host's log-odds against those of all pages, and pages by which a host's rate is drawn to that of all.
HOST_WEIGHT, HOST_PRIOR = 0.4, 20

_ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a\s*>|\[([^\]\[]{0,300})\]\([^)\s]*\)", re.S | re.I)
_TAG = re.compile(r"<[^<>]{0,300}>")
_URL = re.compile(r"^[\W_]*(?:(?:https?|hxxps?|ftp):/|www\.|(?:[\w-]+(?:\.|\[\.\]))+[a-z]{2,}/|[\w-]+\[\.\]|[a-z0-9-]*[0-9-][a-z0-9-]*\.[a-z]{3,}\W*$)", re.I)
_END = re.compile(r"[.!?…][\"')\]»]*$")
_NEAR, _GAP, _WIN, _LONG, _LABEL, _PHRASE = 60, 6, 12, 40, 9, 5
_WORD, _LINK, _HASH, _STRING, _MARK = range(5)
#: Words kept with their attributes before the memory is emptied.
_MEMORY = 400_000


class _Lexicon:
    """Attributes of words, read once per distinct word."""

    def __init__(self, joining: frozenset = frozenset()):
        self.joining = joining
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.core: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, 9), dtype=np.int64)

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > _MEMORY:
            self.clear()
        get = self.ids.get
        out = [get(w, -1) for w in words]
        if -1 in out:
            for i, x in enumerate(out):
                if x < 0:
                    out[i] = self.add(words[i])
        if len(self.table) < len(self.rows):
            self.table = np.array(self.rows, dtype=np.int64)
        return self.table[np.array(out, dtype=np.int64)]

    def add(self, w: str) -> int:
        if (known := self.ids.get(w)) is not None:
            return known
        core = w.strip(".,;:!?()[]{}\"'«»…|/*>•·-–—").casefold()
        if w == "\x01":
            kind = _LINK
        elif _URL.match(w):
            kind = _LINK
        elif w.startswith("#") and len(w) > 1:
            kind = _HASH
        elif len(core) > _LONG:
            kind = _STRING
        elif not core or w == "\x02":
            kind = _MARK
        else:
            kind = _WORD
        parts = re.split("['’]", core)
        row = (
            kind,
            self.core.setdefault(core, len(self.core)),
            any(p in self.joining for p in parts),
            bool(_END.search(w)) and kind == _WORD,
            any(c.isdigit() for c in core),
            w[-1] in ",;|/>•·*" and kind != _LINK,
            len(core),
            sum(not c.isalpha() for c in w) if kind == _WORD else 0,
            w == "\x02",
        )
        self.ids[w] = len(self.rows)
        self.rows.append(row)
        return self.ids[w]


def _words(text: str) -> list[str]:
    if "​" in text:
        text = text.replace("​", "")
    if "<a" in text or "<A" in text or "](" in text:
        text = _ANCHOR.sub(lambda m: " " + "\x01 " * max(1, len((m[1] or m[2] or "").split())), text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\n" in text:
        text = text.replace("\n", " \x02 ")
    if "&nbsp;" in text:
        text = text.replace("&nbsp;", " ")
    return text.split()


def _measure(docs: list[list[str]], lexicon: _Lexicon) -> np.ndarray:
    """Features and signals (but for the compressed size) of several documents at once; one row each."""
    size = np.array([len(d) for d in docs], dtype=np.int64)
    a = lexicon.of([w for d in docs for w in d])
    doc = np.repeat(np.arange(len(docs)), size)
    keep = a[:, 0] != _MARK  # bullets and dashes aren't words
    lines = a[:, 8] == 1
    marks = np.bincount(doc[~keep & ~lines], minlength=len(docs))
    # a line's end closes what stands before it
    closing = np.flatnonzero(lines)
    before_line = np.cumsum(keep)[closing] - 1
    a, doc = a[keep], doc[keep]
    n = len(a)
    line_end = np.zeros(n, dtype=bool)
    line_end[before_line[before_line >= 0]] = True
    kind, core = a[:, 0], a[:, 1]
    count = np.bincount(doc, minlength=len(docs)).astype(float)
    start = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    lo_all, hi_all = start[doc], start[doc + 1]
    pos = np.arange(n)
    word = kind == _WORD
    function, ends = a[:, 2] == 1, a[:, 3] == 1
    # pairs of neighbouring content words that come again within _NEAR words; function words between them don't part a pair
    content = np.flatnonzero(word & ~function)
    repeat = np.zeros(n, dtype=bool)
    if len(content) > 1:
        left, right = content[:-1], content[1:]
        pair = (doc[left] == doc[right]) & (right - left <= _GAP)
        left, right = left[pair], right[pair]
        code = (core[left] << 32) | core[right]
        order = np.argsort(code, kind="stable")
        p, q, c = left[order], right[order], code[order]
        near = np.flatnonzero((c[1:] == c[:-1]) & (doc[p[1:]] == doc[p[:-1]]) & (p[1:] - p[:-1] <= _NEAR))
        for x in (near, near + 1):
            repeat[p[x]] = True
            repeat[q[x]] = True
        # a function word goes with the content words on both of its sides
        before = np.maximum.accumulate(np.where(word & ~function, pos, -1))
        after = np.minimum.accumulate(np.where(word & ~function, pos, n)[::-1])[::-1]
        inner = function & word & (before >= 0) & (after < n)
        repeat[inner] = repeat[before[inner]] & repeat[after[inner]]
    lo, hi = np.maximum(lo_all, pos - _WIN), np.minimum(hi_all, pos + _WIN + 1)

    def around(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x)])
        return (c[hi] - c[lo]) / np.maximum(1, hi - lo)

    strings = kind == _STRING
    # words between two links close together, without a sentence's end, are the links' labels
    link = kind == _LINK
    anchor = link | (kind == _HASH)
    last = np.maximum.accumulate(np.where(link, pos, -1)) if n else pos
    following = np.minimum.accumulate(np.where(link, pos, n)[::-1])[::-1] if n else pos
    closed = np.concatenate([[0], np.cumsum(ends)])
    label = word & (last >= lo_all) & (following < hi_all) & (following - last <= _LABEL)
    label[label] = closed[following[label]] == closed[last[label]]
    link = link | label
    plain, word = word, word & ~label
    rep = word & (around(repeat) > 0.5)
    # fewer than five words are no list
    bare = word & ~rep & (hi - lo >= 5) & (around(function) < 0.08) & (around(ends) == 0) & (around(strings) == 0)
    per = lambda x: np.bincount(doc, weights=x, minlength=len(docs))
    total = np.maximum(1.0, count - per(strings))
    once = np.unique((doc.astype(np.int64) << 32) | core) >> 32 if n else np.zeros(0, np.int64)
    distinct = np.bincount(once, minlength=len(docs)) / np.maximum(1, count)
    twice = _twice(doc, core)
    return np.stack(
        [
            count,
            per(link) / total,
            per(kind == _HASH) / total,
            per(rep) / total,
            per(bare) / total,
            per(function) / total,
            per(ends) / total,
            distinct,
            per(a[:, 4] == 1) / total,
            (per(a[:, 5] == 1) + marks) / total,
            per(a[:, 6] * word) / np.maximum(1.0, per(word)),
            per(_sentences(doc, plain & ~twice, function, anchor, ends, line_end)) / total,
            per(twice) / np.maximum(1.0, count),
            per(anchor) / total,
            per(a[:, 7]) / np.maximum(1.0, per(a[:, 6] * plain) + per(a[:, 7])),
        ],
        1,
    )


def _sentences(doc, word, joining, anchor, ends, line_end) -> np.ndarray:
    """Which of the words stand in sentences: four words or more, joining words (more of them without an end mark), hardly any links or tags."""
    if not len(doc):
        return word
    stop = ends | line_end
    stop[:-1] |= doc[1:] != doc[:-1]
    stop[-1] = True
    close = np.flatnonzero(stop)
    part = np.concatenate([[0], np.cumsum(stop)[:-1]])
    held = np.bincount(part, minlength=len(close))
    joins = np.bincount(part, weights=joining) / held
    sound = (held >= 4) & (joins >= np.where(ends[close], 0.1, 0.35)) & (np.bincount(part, weights=anchor) <= 0.2 * held)
    return sound[part] & word


def _twice(doc, core) -> np.ndarray:
    """Which words stand in a phrase of ``_PHRASE`` words that their document has more than once."""
    twice = np.zeros(len(doc), dtype=bool)
    m = len(doc) - _PHRASE + 1
    if m < 1:
        return twice
    code = doc[:m] * 6_364_136_223_846_793_005
    for k in range(_PHRASE):
        code = (code + core[k : m + k]) * 1_442_695_040_888_963_407
    _, back, often = np.unique(code, return_inverse=True, return_counts=True)
    at = np.flatnonzero((often[back.ravel()] > 1) & (doc[:m] == doc[_PHRASE - 1 :]))
    for k in range(_PHRASE):
        twice[at + k] = True
    return twice


def joining_words(docs: DataFrame) -> frozenset:
    """Words that join others, from counts over all texts: at least ``JOIN_SHARE`` of all words and three times in all, and
    seldom before a mark.  At most 1 / ``JOIN_SHARE`` words fulfil this, whatever the corpus."""
    lines = F.regexp_replace(F.lower("text"), r"\s*[\r\n]+\s*", ", ")
    lines = F.regexp_replace(lines, r"\s+([^\p{L}\p{N}\s#]+)(?=\s|$)", "$1")  # a mark on its own belongs to the word before it
    words = docs.select(F.explode(F.split(lines, r"[\s\x{2019}']+")).alias("w"))
    core = F.regexp_extract("w", r"^[^\p{L}#]*(\p{L}{1,12})[^\p{L}\p{N}]*$", 1)
    counts = words.select(core.alias("core"), F.col("w").rlike(r"[^\p{L}]$").alias("marked")).filter("core != ''")
    counts = written(counts.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.count_if("marked").alias("before_mark")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    fit = counts.filter((F.col("n") >= max(3, JOIN_SHARE * total)) & (F.col("before_mark") <= JOIN_MARKED * F.col("n")))
    return frozenset(r["core"] for r in fit.select("core").collect())


_READ = FEATURES + ("sentences", "again", "anchors", "marks")


def page_features(docs: DataFrame, joining: frozenset = frozenset()) -> DataFrame:
    """(doc_id, host, features..., signals...) for every document; an unreadable or empty text has zeros.

    ``squeezed`` is still the plain ratio of the compressed size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = _Lexicon(joining)
        for b in batches:
            keys, hosts, group, sizes, held = [], [], [], [], 0

            def flush() -> pd.DataFrame:
                f = pd.DataFrame(_measure(group, lexicon), columns=list(_READ))
                f["squeezed"] = sizes
                f.insert(0, "host", hosts)
                f.insert(0, "doc_id", keys)
                return f[["doc_id", "host", *FEATURES, *SIGNALS]]

            for key, host, text in zip(b["doc_id"], b["host"], b["text"]):
                keys.append(key)
                hosts.append(host)
                text = text if isinstance(text, str) else ""
                group.append(_words(text))
                raw = text.casefold().encode("utf-8", "replace")
                sizes.append(len(zlib.compress(raw, 1)) / len(raw) if raw else 1.0)
                held += len(group[-1])
                if held > 500_000:
                    yield flush()
                    keys, hosts, group, sizes, held = [], [], [], [], 0
            if keys:
                yield flush()

    slim = docs.select("doc_id", F.coalesce(F.col("host"), F.lit("")).alias("host"), "text")
    return over_keys(slim, "doc_id", run, "host string, " + ", ".join(f"{x} double" for x in FEATURES + SIGNALS))


def with_votes(feats: DataFrame) -> DataFrame:
    """``feats`` with one vote a signal: 1 spam, 0 honest, -1 none.  The compressed size is set against the median of texts of like length."""
    length = F.floor(F.log2(F.greatest(F.lit(1.0), F.col("n")))).cast("int")
    usual = feats.filter("n > 0").groupBy(length.alias("l")).agg(F.percentile_approx("squeezed", F.lit(0.5), F.lit(1000)).alias("usual"))
    # one row for each doubling of the length
    rows = feats.join(F.broadcast(usual), length == F.col("l"), "left").withColumn("squeezed", F.coalesce(F.col("squeezed") / F.col("usual"), F.lit(1.0))).drop("l", "usual")
    votes = {}
    for x in SIGNALS:
        spam, honest = VOTES[x]
        c = F.col(x)
        c = F.when(F.col("n") >= SHORT, c) if x == "sentences" else F.when(F.col("n") * (1 - F.col("links") - F.col("tags")) >= SHORT, c) if x == "marks" else c
        votes["vote_" + x] = F.when(c <= spam, 1).when(c >= honest, 0).otherwise(-1) if spam < honest else F.when(c >= spam, 1).when(c <= honest, 0).otherwise(-1)
    return rows.withColumns(votes)


def trust_votes(patterns: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The posterior of spam for each pattern of votes (rows of 1, 0, -1), by expectation-maximisation over their counts.

    Votes are independent given the page's kind; an abstention says nothing.  Ten pseudo-pages of either kind keep small corpora
    near plain voting: a tenth of the votes on honest pages and half of those on spam pages, which rarely have all symptoms, are wrong.
    """
    if not len(patterns):
        return np.zeros(0)
    right = np.array([[0.9, 0.1], [0.5, 0.5]])  # votes honest, spam of honest pages, of spam pages
    hot = np.stack([patterns == v for v in (0, 1)], 2).astype(float)  # pattern, signal, vote
    prior, chance = np.array([0.75, 0.25]), np.repeat(right[:, None, :], patterns.shape[1], 1)
    for _ in range(rounds):
        logs = np.log(prior)[None, :] + np.einsum("psv,ksv->pk", hot, np.log(chance))
        post = np.exp(logs - logs.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        mass = post * n[:, None]
        prior = (mass.sum(0) + [7.5, 2.5]) / (n.sum() + 10)
        chance = np.einsum("pk,psv->ksv", mass, hot) + 10 * right[:, None, :]
        chance /= chance.sum(2, keepdims=True)
    return post[:, 1]


class Tree:
    """A classification tree split by Gini impurity; thresholds lie midway between neighbouring values."""

    def __init__(self, depth: int, least: int, rng: np.random.Generator, tried: int):
        self.depth, self.least, self.rng, self.tried, self.nodes = depth, least, rng, tried, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self._grow(x, y, 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, level: int) -> int:
        at = len(self.nodes)
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.nodes.append([-1, 0.0, -1, -1, p])
        if level == self.depth or len(y) < 2 * self.least or y.min() == y.max():
            return at
        best = (0.0, -1, 0.0)
        for j in self.rng.choice(x.shape[1], self.tried, replace=False):
            order = np.argsort(x[:, j], kind="stable")
            v, t = x[order, j], y[order]
            left = np.arange(1, len(t))
            ones = np.cumsum(t)[:-1]
            rest = len(t) - left
            pl, pr = ones / left, (t.sum() - ones) / rest
            gain = 2 * t.mean() * (1 - t.mean()) - (left * 2 * pl * (1 - pl) + rest * 2 * pr * (1 - pr)) / len(t)
            gain[(v[1:] == v[:-1]) | (left < self.least) | (rest < self.least)] = -1
            k = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[k] > best[0] + 1e-12:
                best = (gain[k], int(j), (v[k] + v[k + 1]) / 2)
        if best[1] < 0:
            return at
        go = x[:, best[1]] <= best[2]
        left, right = self._grow(x[go], y[go], level + 1), self._grow(x[~go], y[~go], level + 1)
        self.nodes[at][:4] = [best[1], best[2], left, right]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        nodes = np.array(self.nodes)
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            n = nodes[at]
            inner = n[:, 0] >= 0
            f = np.where(inner, n[:, 0], 0).astype(np.int64)
            left = x[np.arange(len(x)), f] <= n[:, 1]
            at = np.where(inner, np.where(left, n[:, 2], n[:, 3]), at).astype(np.int64)
        return nodes[at, 4]


def fit_bag(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 6, least: int = 5, seed: int = 7) -> list[Tree]:
    """Bagged trees; half of the features are tried at each split."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        out.append(Tree(depth, least, rng, max(1, x.shape[1] // 2)).fit(x[pick], y[pick]))
    return out


def label_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, host, features..., signals..., votes..., belief, label): every document with the posterior of its votes and, where this is clear, its weak label."""
    feats = written(page_features(docs, joining_words(docs)), "pages")
    voted = with_votes(feats)
    names = ["vote_" + x for x in SIGNALS]
    # at most 3 ** len(SIGNALS) rows
    counts = voted.filter("n > 0").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts["belief"] = trust_votes(counts[names].to_numpy(), counts["n"].to_numpy(float))
    known = docs.sparkSession.createDataFrame(counts[[*names, "belief"]].values.tolist() or [], ", ".join([*(f"{v} double" for v in names), "belief double"]))
    known = known.select(*[F.col(v).cast("int").alias(v) for v in names], "belief")
    joined = voted.join(F.broadcast(known), names, "left")
    belief = F.when(F.col("n") > 0, F.col("belief")).otherwise(0.0)
    label = F.when(F.col("n") == 0, F.lit(None)).when(belief >= CLEAR, 1).when(belief <= 1 - CLEAR, 0)
    return written(joined.withColumn("belief", belief).withColumn("label", label), "labels")


def score_pages(docs: DataFrame, sample: int = SAMPLE, host_weight: float = HOST_WEIGHT) -> DataFrame:
    """(doc_id, host, label, page_score, host_rate, score) for every document.

    ``docs`` needs doc_id, host and text.  Null and empty texts score 0; null hosts are one host; repeated
    rows stay repeated; without any weak label of one kind the votes alone decide.  ``sample`` bounds the
    labelled pages of each kind that the trees are fitted on, taken in the order of a hash of doc_id.
    """
    spark = docs.sparkSession
    pages = label_pages(docs)
    labelled = pages.filter("label is not null")
    by = [F.xxhash64("doc_id"), "doc_id", *FEATURES]
    pick = [labelled.filter(F.col("label") == y).orderBy(*by).limit(sample).select("label", *FEATURES) for y in (0, 1)]
    rows = pick[0].unionByName(pick[1]).toPandas()
    x, y = rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float)
    bag = spark.sparkContext.broadcast(fit_bag(x, y) if len(y) and 0 < y.mean() < 1 else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[list(FEATURES)].to_numpy(float)
            p = np.mean([t.predict(x) for t in bag.value], axis=0) if bag.value else b["belief"].to_numpy(float)
            # two words have no shares to speak of; their votes decide
            p = np.where(x[:, 0] < 3, b["belief"].to_numpy(float), p)
            yield pd.DataFrame({"doc_id": b["doc_id"], "host": b["host"], "label": b["label"], "page_score": p})

    slim = pages.select("doc_id", "host", F.col("label").cast("double").alias("label"), "belief", *FEATURES)
    scored = written(over_keys(slim, "doc_id", run, "host string, label double, page_score double"), "scores")
    rates = scored.groupBy("host").agg(F.sum("page_score").alias("s"), F.count(F.lit(1)).alias("m"))
    everywhere = rates.agg((F.sum("s") / F.sum("m")).alias("base"))
    hosts = rates.crossJoin(F.broadcast(everywhere)).withColumnRenamed("host", "h")

    def logit(c):
        p = F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
        return F.log(p / (1 - p))

    joined = scored.join(hosts, F.col("host") == F.col("h"))
    # the page's own score is left out, so that no page speaks for itself
    rate = (F.col("s") - F.col("page_score") + HOST_PRIOR * F.col("base")) / (F.col("m") - 1 + HOST_PRIOR)
    joined = joined.withColumn("host_rate", rate)
    odds = logit(F.col("page_score")) + host_weight * (logit(F.col("host_rate")) - logit(F.col("base")))
    score = F.when(F.col("page_score") == 0, 0.0).otherwise(1 / (1 + F.exp(-odds)))
    return joined.select("doc_id", "host", F.col("label").cast("int").alias("label"), "page_score", "host_rate", score.alias("score"))
