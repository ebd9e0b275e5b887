"""Filling fixed-capacity containers with texts: a grouping genetic algorithm on islands.

1. Texts are measured in tokens of a public tokenizer.  A text longer than a container is
   cut into full containers and a rest; nothing else is ever split.
2. Items are dealt by hash into blocks of a bounded number of items.  Every block is
   packed by several islands that evolve independently: a crossover injects whole well-filled
   bins of one parent into the other, bins that now hold an item twice are dissolved, and
   their other items first take the place of one or two smaller ones in a bin that this fills
   better, and then go where they fit best.
3. After each round the best packing of an island migrates to the next island of the block.
4. Items of the bins left open go into the blocks of the next, far smaller level, until one
   block is left.
"""

from __future__ import annotations

import base64
import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbormill.session import over_keys, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer cuts text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_ITEMS, ISLANDS, ROUNDS, POPULATION, GENERATIONS = 2_000, 2, 2, 5, 6
#: A bin filled less than this is opened again on the next level, but never more than half of a level's bins.
OPEN_BELOW = 0.999
_MEMORY = 500_000


class TokenCounter(dict):
    """Counts tokens word by word with a memory; a blank before a word never joins with what stands before it."""

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.encode(" " + word))
        return n

    def count(self, text: str | None) -> int:
        if not isinstance(text, str) or not text:
            return 0
        words = text.split(" ")
        if len(words) != len(text.split()):  # runs of blanks, line ends and the like
            return len(self.encode(text))
        if len(self) > _MEMORY:
            self.clear()
        return len(self.encode(words[0])) + sum(map(self.__getitem__, words[1:]))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens); the vocabulary file must lie at the same path on every machine.  Null and empty texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(vocabulary, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [counter.count(t) for t in b["text"]]})

    return over_keys(docs.select("doc_id", "text"), "doc_id", run, "n_tokens int")


class _Bins:
    """Bins under construction, found by their free room."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity, self.bins, self.free, self.room = sizes, capacity, [], [], []

    def open(self, items: list[int]) -> None:
        free = self.capacity - sum(self.sizes[i] for i in items)
        bisect.insort(self.room, (free, len(self.bins)))
        self.bins.append(items)
        self.free.append(free)

    def fit(self, items: list[int]) -> None:
        """Best fit, larger items first."""
        sizes, room, bins, free = self.sizes, self.room, self.bins, self.free
        for i in items:
            s = sizes[i]
            at = bisect.bisect_left(room, (s, -1))
            if at == len(room):
                self.open([i])
                continue
            f, b = room.pop(at)
            bins[b].append(i)
            free[b] = f - s
            bisect.insort(room, (f - s, b))


    def swap(self, displaced: list[int], rng: np.random.Generator, tries: int = 60) -> list[int]:
        """Lets displaced items take the place of one or two items of a bin where they leave less room; returns what is displaced now.

        Up to ``tries`` bins with room, in random order, are looked at; an exchange always fills its bin better, so this ends.
        """
        sizes = self.sizes
        open_ = [b for b, f in enumerate(self.free) if f]
        if not open_ or not displaced:
            return displaced
        out = sorted(displaced, key=lambda i: -sizes[i])
        for b in rng.permutation(open_)[:tries].tolist():
            items, free = self.bins[b], self.free[b]
            best = (0, -1, ())
            have: dict[int, int] = {}
            for at, i in enumerate(out):
                have.setdefault(sizes[i], at)
            wanted = sorted(have)
            # exchanges of one item or two for one displaced item that is larger by at most the bin's room
            for x in range(len(items)):
                for y in range(x, len(items)):
                    gone = sizes[items[x]] + (sizes[items[y]] if y > x else 0)
                    k = bisect.bisect_right(wanted, gone + free) - 1
                    if k >= 0 and wanted[k] - gone > best[0]:
                        best = (wanted[k] - gone, have[wanted[k]], (x, y) if y > x else (x,))
            if best[1] >= 0:
                back = [items[k] for k in best[2]]
                self.bins[b] = [i for k, i in enumerate(items) if k not in best[2]] + [out[best[1]]]
                self.room.pop(bisect.bisect_left(self.room, (free, b)))
                self.free[b] = free - best[0]
                bisect.insort(self.room, (self.free[b], b))
                out[best[1] : best[1] + 1] = back
        return out


def fitness(free: list[int], capacity: int) -> float:
    """Mean square of the fill: of two packings with equal bins the one with fuller ones wins."""
    if not free:
        return 0.0
    return float(np.mean((1 - np.array(free) / capacity) ** 2))


def _fresh(order: list[int], sizes: list[int], capacity: int) -> _Bins:
    b = _Bins(sizes, capacity)
    b.fit(order)
    return b


def cross(a: _Bins, b: _Bins, place: list[int], sizes: list[int], capacity: int, rng: np.random.Generator) -> _Bins:
    """A child of ``a`` that takes well-filled bins of ``b`` whole; ``place`` is each item's position in size order."""
    by_fill = sorted(range(len(b.bins)), key=b.free.__getitem__)
    better = by_fill[: max(1, len(by_fill) // 2)]
    take = rng.choice(len(better), max(1, int(len(better) * rng.uniform(0.1, 0.5))), replace=False)
    child, taken, displaced = _Bins(sizes, capacity), set(), []
    for t in take:
        items = b.bins[better[t]]
        child.open(list(items))
        taken.update(items)
    worst = max(a.free)
    for items, free in zip(a.bins, a.free):
        # bins that double an item are dissolved, and so is the emptiest one
        if free == worst or not taken.isdisjoint(items):
            displaced += [i for i in items if i not in taken]
        else:
            child.open(list(items))
    displaced = child.swap(displaced, rng)
    displaced.sort(key=place.__getitem__)
    child.fit(displaced)
    return child


def evolve(sizes: list[int], capacity: int, seed: int, population: int, generations: int, arrived: list[list[int]]) -> list[list[int]]:
    """Packings as bin numbers per item, best first."""
    rng = np.random.default_rng(seed)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    place = [0] * len(sizes)
    for p, i in enumerate(order):
        place[i] = p
    people = []
    for assigned in arrived:
        bins: dict[int, list[int]] = {}
        for i, x in enumerate(assigned):
            bins.setdefault(x, []).append(i)
        b = _Bins(sizes, capacity)
        for items in bins.values():
            b.open(items)
        people.append(b)
    arr = np.array(sizes, dtype=float)
    while len(people) < population:
        mixed = order if not people else np.argsort(-arr * rng.uniform(0.8, 1.25, len(arr)), kind="stable").tolist()
        people.append(_fresh(mixed, sizes, capacity))
    score = [fitness(b.free, capacity) for b in people]
    floor = math.ceil(sum(sizes) / capacity)
    for _ in range(generations * population):
        if min(len(b.bins) for b in people) <= floor and max(score) > 0.9999:
            break
        i, j = rng.choice(len(people), 2, replace=False) if len(people) > 1 else (0, 0)
        child = cross(people[i], people[j], place, sizes, capacity, rng)
        s = fitness(child.free, capacity)
        worst = min(range(len(people)), key=score.__getitem__)
        if s > score[worst]:
            people[worst], score[worst] = child, s
    out = []
    for k in sorted(range(len(people)), key=lambda k: -score[k]):
        assigned = [0] * len(sizes)
        for x, items in enumerate(people[k].bins):
            for i in items:
                assigned[i] = x
        out.append(assigned)
    return out


def _level(items: DataFrame, capacity: int, level: int, blocks: int, islands: int, rounds: int, population: int, generations: int) -> DataFrame:
    """(doc_id, piece, n_tokens, level, block, bin, fill) of one level's items."""
    doc_kind = items.schema["doc_id"].dataType.simpleString()
    keyed = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(blocks)).cast("int"))
    # a block has about BLOCK_ITEMS rows of a few numbers
    packed = keyed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "piece", "n_tokens"))).alias("items"))
    state = packed.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("people", F.lit(None).cast("array<array<int>>"))
    state = state.withColumn("guest", F.lit(None).cast("array<int>"))

    def one_round(no: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                people = []
                for sizes, own, guest, block, island in zip(b["sizes"], b["people"], b["guest"], b["block"], b["island"]):
                    # an island goes on from its own best and the neighbour's
                    arrived = ([list(own[0])] if own is not None and len(own) else []) + ([list(guest)] if guest is not None else [])
                    people.append(evolve([int(x) for x in sizes], capacity, hash((level, int(block), int(island), no)) & 0x7FFFFFFF, population, generations, arrived)[:1])
                yield pd.DataFrame({"block": b["block"], "island": b["island"], "people": people, "score": [_score(s, p[0], capacity) for s, p in zip(b["sizes"], people)]})

        return run

    evolved = None
    for no in range(rounds):
        flat = state.select("block", "island", F.transform("items", lambda x: x["n_tokens"]).alias("sizes"), "people", "guest")
        # islands are spread over all cores
        width = max(1, min(blocks * islands, 4 * items.sparkSession.sparkContext.defaultParallelism))
        evolved = written(flat.repartition(width, "block", "island").mapInPandas(one_round(no), "block int, island int, people array<array<int>>, score double"), "islands")
        if no + 1 < rounds:
            guests = evolved.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("people")[0].alias("guest"))
            state = packed.join(evolved.select("block", "island", "people"), "block").join(guests, ["block", "island"])
    best = evolved.groupBy("block").agg(F.max_by(F.col("people")[0], F.struct("score", -F.col("island"))).alias("bins"))
    rows = packed.join(best, "block").select("block", F.inline(F.arrays_zip("items", "bins"))).select("block", "items.*", F.col("bins").alias("bin"))
    fill = rows.groupBy("block", "bin").agg((F.sum("n_tokens") / capacity).alias("fill"))
    return rows.join(fill, ["block", "bin"]).withColumn("level", F.lit(level))


def _score(sizes, assigned: list[int], capacity: int) -> float:
    held = np.bincount(np.array(assigned, dtype=np.int64), weights=np.array(sizes, dtype=float)) if len(assigned) else np.zeros(0)
    return float(np.mean((held / capacity) ** 2)) if len(held) else 0.0


def pack(
    docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY, pattern: str = PATTERN, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, rounds: int = ROUNDS, population: int = POPULATION, generations: int = GENERATIONS
) -> DataFrame:
    """(bin_id, doc_id, piece, first_token, n_tokens) for every document.

    A document of at most ``capacity`` tokens is one row with piece 0; a longer one has full pieces in bins of their
    own and a rest.  Null and empty texts are items of 0 tokens; equal texts are packed each; an empty table gives no
    rows; extra columns are not read.  doc_id must be unique.
    """
    tokens = written(count_tokens(docs, vocabulary, pattern), "tokens")
    whole = F.when(F.col("n_tokens") > capacity, F.floor((F.col("n_tokens") - 1) / capacity)).otherwise(0).cast("int")
    cut = tokens.withColumn("whole", whole)
    full = cut.filter("whole > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece"), F.lit(capacity).alias("n_tokens"))
    items = cut.select("doc_id", F.col("whole").alias("piece"), (F.col("n_tokens") - F.col("whole") * capacity).cast("int").alias("n_tokens"))
    done, level, n = None, 0, items.count()
    while n:
        blocks = max(1, math.ceil(n / block_items))
        # the last level is one block; its genes get more time
        more = 1 if blocks > 1 else 4
        result = written(_level(items, capacity, level, blocks, islands, rounds, population, generations * more), "level")
        bar = OPEN_BELOW
        if blocks > 1:
            # at least the fuller half of the bins is closed, so that every level has at most about half of the items
            middle = result.groupBy("block", "bin").agg(F.first("fill").alias("fill")).agg(F.percentile_approx("fill", F.lit(0.5), F.lit(10_000))).first()[0]
            bar = min(bar, middle)
        closed = result if blocks == 1 else result.filter(F.col("fill") >= bar)
        closed = closed.select("level", "block", "bin", "doc_id", "piece", "n_tokens")
        done = closed if done is None else done.unionByName(closed)
        if blocks == 1:
            break
        items = result.filter(F.col("fill") < bar).select("doc_id", "piece", "n_tokens")
        n, level = items.count(), level + 1
    alone = full.select(F.xxhash64(F.lit("full"), "doc_id", "piece").alias("bin_id"), "doc_id", "piece", "n_tokens")
    if done is None:
        out = alone
    else:
        out = alone.unionByName(done.select(F.xxhash64(F.lit("bin"), "level", "block", "bin").alias("bin_id"), "doc_id", "piece", "n_tokens"))
    return out.select("bin_id", "doc_id", "piece", (F.col("piece") * capacity).cast("long").alias("first_token"), "n_tokens")
