"""Runs: maximal periodic stretches of words, found with suffix trees.

A run repeats its first ``q`` words (its smallest period) at least ``copies`` times, has at least ``least_words`` words and
can't be extended on either side. Every run holds a Lyndon root, the longest Lyndon word at its own start under one of the two
orders of the alphabet. So, for a text and its reversal:

* Ukkonen's algorithm builds the suffix tree; an Euler tour of it, cut down to the shallowest node between neighbouring leaves,
  answers lowest common ancestors, and with them longest common extensions, in constant time (sparse table of minima);
* the order of the leaves gives each suffix's next smaller one, which ends the longest Lyndon word at each start, under both orders;
* each root is extended to the right in the text's tree and to the left in the reversal's; roots that reach the required length are runs.

Trees are built only for stretches in which a run can lie: each word of a run occurs ``copies`` times in it, and each triple of
neighbouring words at least ``copies - 1`` times; what fails these counts is cut away until nothing changes, which loses no run.
One document is handled in one task, with memory in proportion to its words; there is no shuffle.

Defined cases: null, empty and blank texts have no words and no runs; a null id is handled like any other (as empty text where it is
hashed); repeated rows give repeated results; extra columns of the input are ignored by ``find_runs`` and kept by ``plant_repeats``.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import as_bytes, batch, map_arrow, slices


@dataclass(frozen=True)
class Runs:
    #: Least length in periods; at least 3, as the cuts count triples.
    copies: int = 4
    least_words: int = 6


# ---- suffix trees ----


class SuffixTree:
    """Ukkonen's tree of a sequence of whole numbers from 1 on; the end counts as 0, which occurs nowhere else."""

    def __init__(self, letters: list[int]):
        s = [*letters, 0]
        n, width = len(s), max(s) + 1
        start, end, link = array("q", [0]), array("q", [0]), array("q", [0])
        child: dict[int, int] = {}

        def node(a: int, b: int) -> int:
            start.append(a)
            end.append(b)
            link.append(0)
            return len(start) - 1

        at = edge = length = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = at * width + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = node(i, n)
                    branch = at
                else:
                    size = min(end[below], i + 1) - start[below]
                    if length >= size:
                        edge, length, at = edge + size, length - size, below
                        continue
                    if s[start[below] + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = at
                        break
                    branch = node(start[below], start[below] + length)
                    child[key] = branch
                    child[branch * width + c] = node(i, n)
                    start[below] += length
                    child[branch * width + s[start[below]]] = below
                if unlinked:
                    link[unlinked] = branch
                unlinked = branch
                waiting -= 1
                if not at and length:
                    length, edge = length - 1, i - waiting + 1
                else:
                    at = link[at]
        keys = np.fromiter(child.keys(), np.int64, len(child))
        self.below = np.fromiter(child.values(), np.int64, len(child))
        self.parent, self.letter = np.divmod(keys, width)
        self.sizes = np.asarray(end, np.int64) - np.asarray(start, np.int64)
        self.n = n

    def tour(self, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the suffixes in order of the leaves, and the depth of the shallowest node between each leaf and the one before.

        ``descending`` turns the order of the letters around; the end stays the smallest.
        """
        rank = np.where(self.letter == 0, 0, self.letter.max() + 1 - self.letter) if descending else self.letter
        order = np.lexsort((-rank, self.parent))
        kids = self.below[order].tolist()
        first = np.searchsorted(self.parent[order], np.arange(len(self.sizes) + 1)).tolist()
        sizes, n = self.sizes.tolist(), self.n
        leaves, lows, low = [], [], 0
        stack = [(0, 0, -1)]
        while stack:
            node, depth, turn = stack.pop()
            if turn >= 0:
                low = turn
            a, b = first[node], first[node + 1]
            if a == b:
                leaves.append(n - depth)
                lows.append(low)
                continue
            # The last of these is visited first, without a turn at this node.
            for k in range(a, b):
                stack.append((kids[k], depth + sizes[kids[k]], depth if k < b - 1 else -1))
        return np.array(leaves), np.array(lows)


class Extensions:
    """Longest common extension of two starts in constant time: least depth between two leaves of the tour."""

    def __init__(self, leaves: np.ndarray, lows: np.ndarray):
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.least = [lows.astype(np.int32)]
        step = 1
        while 2 * step <= len(lows):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For starts i and j, all different from each other; the start after the last letter shares nothing."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.least[k][lo[m]], self.least[k][hi[m] - (1 << int(k))])
        return out


def _lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """End of the longest Lyndon word at each start: the next smaller suffix."""
    ranks = rank.tolist()
    n = len(ranks) - 1
    ends, stack = [n] * n, [n]
    for i in range(n - 1, -1, -1):
        r = ranks[i]
        while ranks[stack[-1]] > r:
            stack.pop()
        ends[i] = stack[-1]
        stack.append(i)
    return np.array(ends)


def runs_of(letters: list[int], runs: Runs) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of whole numbers from 1 on, by start, then period."""
    n = len(letters)
    tree = SuffixTree(letters)
    ahead = Extensions(*tree.tour())
    other = np.empty(n + 1, np.int64)
    other[tree.tour(descending=True)[0]] = np.arange(n + 1)
    starts = np.arange(n)
    roots = np.unique(np.concatenate([np.stack([starts, _lyndon_ends(r)]) for r in (ahead.rank, other)], axis=1), axis=1)
    i, end = roots
    right = ahead(i, end)
    del tree, ahead
    # A root whose right side is known can still grow by less than its period to the left.
    period = end - i
    enough = np.maximum(runs.least_words, runs.copies * period)
    hopeful = (2 * period + right > enough) & (i > 0) | (period + right >= enough)
    i, end, right, period, enough = (x[hopeful] for x in (i, end, right, period, enough))
    left = np.zeros(len(i), np.int64)
    inner = i > 0
    if inner.any():
        back = Extensions(*SuffixTree(letters[::-1]).tour())
        left[inner] = back(n - i[inner], n - end[inner])
    length = left + period + right
    good = length >= enough
    return sorted(set(zip((i - left)[good].tolist(), length[good].tolist(), period[good].tolist())))


# ---- where runs can lie ----


def _stretches(words: list[bytes], runs: Runs) -> Iterator[tuple[int, int]]:
    """Stretches outside which no run lies, by counts of words, then of triples within each stretch until nothing changes."""
    count = Counter(words)
    flags = bytes([count[w] >= runs.copies for w in words])
    enough = re.compile(b"\x01{%d,}" % runs.least_words)
    triples = re.compile(b"\x01{%d,}" % max(1, runs.least_words - 2))
    todo = [m.span() for m in enough.finditer(flags)]
    while todo:
        lo, hi = todo.pop()
        grams = list(zip(words[lo:hi], words[lo + 1 : hi], words[lo + 2 : hi]))
        count = Counter(grams)
        if min(count.values()) >= runs.copies - 1:
            yield lo, hi
            continue
        flags = bytes([count[g] >= runs.copies - 1 for g in grams])
        todo += [(lo + m.start(), lo + m.end() + 2) for m in triples.finditer(flags)]


def runs_in(words: list[bytes], runs: Runs) -> list[tuple[int, int, int]]:
    found = []
    for lo, hi in _stretches(words, runs):
        number: dict[bytes, int] = {}
        letters = [number.setdefault(w, len(number) + 1) for w in words[lo:hi]]
        found += [(lo + s, length, q) for s, length, q in runs_of(letters, runs)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without any that a run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, q in found:
        keep[start + q : start + length] = False
    return b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)])


# ---- tables ----

RUN_SQL = "array<struct<start:bigint,length:bigint,period:bigint>>"


def find_runs(docs: DataFrame, runs: Runs = Runs()) -> DataFrame:
    """(doc_id, runs, collapsed) of every document: all runs by start, then period, and the text with each run cut to one period."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = {"doc_id": pa.int64(), "runs": kind, "collapsed": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            for part in slices(texts):
                found, short = [], []
                for text in texts[part]:
                    words = text.split()
                    found.append(runs_in(words, runs) if len(words) >= runs.least_words else [])
                    short.append(collapsed(words, found[-1]).decode())
                yield batch({"doc_id": b.column(0)[part.start : part.stop], "runs": found, "collapsed": short}, kinds)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, runs {RUN_SQL}, collapsed string")


def plant_repeats(docs: DataFrame) -> DataFrame:
    """A tenth of the documents (by crc32 of the id) with their ends made periodic, to test with; other columns are kept."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    made = F.transform(
        F.array(F.struct(words.alias("w"))),
        lambda x: F.transform(
            F.array(F.struct(x.w.alias("w"), F.size(x.w).cast("long").alias("n"), (g % F.size(x.w)).cast("long").alias("a"))),
            lambda y: F.concat(
                F.slice(y.w, F.lit(1), y.a.cast("int")),
                F.transform(
                    F.sequence(F.lit(0).cast("long"), y.n - y.a - 1),
                    lambda i: F.get(y.w, (y.a + i % (1 + F.floor((y.n - y.a) / (3 + g % 8)))).cast("int")),
                ),
            ),
        )[0],
    )[0]
    changed = F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.array_join(made, " ")).otherwise(F.col("text"))
    return docs.withColumn("text", changed)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the longest run (ties: smallest start, then period) and hashes, from the runs and the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"),
        (-F.col("b.p")).alias("period"), F.expr("1000 * b.length div -b.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
