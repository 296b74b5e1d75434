"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece starts as single bytes. Leaf i of the tree holds the rank of the pair that starts at live position i (none: infinite), an
inner node the least below it, and among equal ranks the leftmost; so the root names the next merge. A merge changes three leaves
(the pair itself, its left neighbour, the vanished position), each in logarithmic time, so a piece of n bytes takes
O(n log n) whatever it looks like. Pieces of up to ``SHORT`` bytes are merged many at once: their trees are the rows of an array, and
each step takes the next merge of every piece.

Texts are cut by the vocabulary's pattern. Pieces between blanks are met again and again, so a worker process remembers the ids of those
met lately, up to ``limit``; forgetting does not change results.

Defined results: null and empty texts have no ids and decode to no bytes. Extra columns of the input are ignored; repeated rows are coded
alike.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from runlens.llm.common import batch, few_rows, lasting, map_arrow, slices
from runlens.llm.tokenizing import UNSAFE, Recent, cut_at, groups

#: White space of the pattern's engine: the Unicode property, without the separators U+001C to U+001F.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NONE = 1 << 62
#: Longest piece that is merged together with others, and how many are at a time.
SHORT, TOGETHER = 33, 2_048


@dataclass(frozen=True)
class Vocabulary:
    #: A rank file and the pattern that cuts texts.
    path: str
    pattern: str
    limit: int = 800_000


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def cutter(pattern: str) -> regex.Pattern:
    def spelled(m: re.Match) -> str:
        return m[1].replace("\\s", WHITE) if m[1] else f"[{WHITE}]" if m[0] == "\\s" else f"[^{WHITE}]"

    return regex.compile(re.sub(r"(\[[^\]]*\])|\\s|\\S", spelled, pattern))


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always the least rank first, the leftmost of equal ones."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    bits = n.bit_length()
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << bits | i
    for p in range(size - 1, 0, -1):
        a, b = tree[2 * p], tree[2 * p + 1]
        tree[p] = a if a < b else b
    after = list(range(1, n + 1))  # the next live position
    before = list(range(-1, n))
    mask = (1 << bits) - 1

    while tree[1] != NONE:
        i = tree[1] & mask
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        r = get(piece[i : after[k]]) if k < n else None
        changes = [(i, NONE if r is None else r << bits | i)]
        if j < n - 1 and tree[size + j] != NONE:
            changes.append((j, NONE))
        h = before[i]
        if h >= 0:
            r = get(piece[h:k])
            v = NONE if r is None else r << bits | h
            if tree[size + h] != v:
                changes.append((h, v))
        for p, v in changes:
            p += size
            tree[p] = v
            while p > 1:
                other = tree[p ^ 1]
                if other < v:
                    v = other
                p >>= 1
                if tree[p] == v:
                    break
                tree[p] = v
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class ShortPieces:
    """Merges of many short pieces at once."""

    #: No token, and no merge.
    GONE = 1 << 30

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        # A merge is known by the ids of its two halves.
        merges = sorted(
            (a << 32 | b, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None
        )
        self.halves = np.array([m[0] for m in merges] + [(1 << 63) - 1], np.int64)
        self.merged = np.array([m[1] for m in merges] + [self.GONE], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        halves = left << 32 | right
        at = np.searchsorted(self.halves, halves)
        return np.where(self.halves[at] == halves, self.merged[at], self.GONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, in 32 bits each, of pieces of 2 to ``SHORT`` bytes."""
        out: list[bytes] = [b""] * len(pieces)
        widths: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            widths.setdefault(max(2, 1 << (len(p) - 2).bit_length()), []).append(i)
        for leaves, which in widths.items():
            for group in groups(which, TOGETHER):
                for i, ids in zip(group, self._merge([pieces[i] for i in group], leaves)):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """The same for pieces of at most ``leaves + 1`` bytes; a piece's pairs start at its positions 0 to ``leaves - 1``."""
        n, places, gone = len(pieces), leaves + 2, self.GONE
        shift = leaves.bit_length()
        mask = (1 << shift) - 1
        data = np.frombuffer(b"".join([p.ljust(places, b"\0") for p in pieces]), np.uint8).reshape(n, places)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        # The last place is never a byte's, so it also stands for what lies before a piece.
        tokens = np.where(np.arange(places) < sizes[:, None], self.single[data], gone)
        tree = np.full((n, 2 * leaves), gone, np.int64)
        first = self._ranks(tokens[:, :leaves], tokens[:, 1 : leaves + 1])
        tree[:, leaves:] = np.where(first < gone, first << shift | np.arange(leaves), gone)
        size = leaves
        while size > 1:
            np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2], out=tree[:, size // 2 : size])
            size //= 2
        after = np.tile(np.arange(1, places + 1), n)
        before = np.tile(np.append(places - 1, np.arange(places - 1)), n)
        flat, nodes = tokens.reshape(-1), tree.reshape(-1)
        rows = np.flatnonzero(tree[:, 1] < gone)
        while len(rows):
            base, root = rows * places, rows * (2 * leaves)
            best = nodes[root + 1]
            i, rank = best & mask, best >> shift
            j = after[base + i]
            k = after[base + j]
            h = before[base + i]
            after[base + i] = k
            before[base + k] = i
            flat[base + i], flat[base + j] = rank, gone
            new = self._ranks(np.concatenate([flat[base + h], rank]), np.concatenate([rank, flat[base + k]]))
            # A vanished last byte has no leaf, and the first pair no left neighbour; the pair itself is written last.
            own_j = np.where(j < leaves, j, i)
            own_h = np.where(h < leaves + 1, h, own_j)
            at = np.concatenate([own_h, i])
            value = np.where(new < gone, new << shift | at, gone)
            nodes[root + leaves + own_j] = gone
            nodes[root + leaves + own_h] = value[: len(rows)]
            nodes[root + leaves + i] = value[len(rows) :]
            top, path = np.tile(root, 3), np.concatenate([own_j, at]) + leaves
            for _ in range(shift - 1):
                path >>= 1
                child = top + 2 * path
                nodes[top + path] = np.minimum(nodes[child], nodes[child + 1])
            rows = rows[nodes[root + 1] < gone]
        live = tokens < gone
        return cut_at(tokens[live].astype(np.uint32).tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist())


class Codec:
    def __init__(self, v: Vocabulary):
        self.ranks, self.cut = load_ranks(v.path), cutter(v.pattern)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.known, self.short = Recent(v.limit), ShortPieces(self.ranks)

    def _matches(self, found: list[str]) -> dict[str, bytes]:
        """Ids of each distinct match of the pattern."""
        out, names, short = {}, [], []
        for piece in set(found):
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                out[piece] = packed([rank])
            elif len(data) <= SHORT:
                names.append(piece), short.append(data)
            else:
                out[piece] = packed(merge_pairs(data, self.ranks))
        out.update(zip(names, self.short.encode(short)))
        return out

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, of which nothing is remembered."""
        found = [self.cut.findall(t) for t in texts]
        ids = self._matches(list(chain.from_iterable(found)))
        return [b"".join(map(ids.__getitem__, row)) for row in found]

    def _learn(self, parts: set[str]) -> None:
        # Behind white space a blank may belong to a longer run, so such a cut is not safe.
        safe = [p for p in parts if p and not p[-1].isspace()]
        self.known.young.update(dict.fromkeys(parts.difference(safe), UNSAFE))
        for group in groups(safe, 20_000):
            self._learn_joined(group)

    def _learn_joined(self, parts: list[str]) -> None:
        """Remember the ids of pieces, each with a blank before it, that do not end in white space; no match reaches from one to the next."""
        found = self.cut.findall("".join([" " + p for p in parts]))
        ids = self._matches(found)
        # Only the first match of a piece starts with its blank.
        starts = [i for i, m in enumerate(found) if m[0] == " "]
        if len(starts) != len(parts):
            raise AssertionError("a match reached over a cut")
        entries = list(map(ids.__getitem__, found))
        self.known.young.update(zip(parts, [b"".join(entries[a:b]) for a, b in zip(starts, [*starts[1:], len(found)])]))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text in 32 bits each; a text is cut before each blank, where no match of the pattern reaches over the cut."""
        parts = [t.split(" ") for t in texts]
        firsts = [row.pop(0) for row in parts]
        found = self.known.entries(list(chain.from_iterable(parts)), self._learn)
        owns = [found[stop - len(row) : stop] for row, stop in zip(parts, accumulate(map(len, parts)))]
        # A last piece may end in white space.
        ends = [i for i, own in enumerate(owns) if own and own[-1] is UNSAFE]
        for i, ids in zip(ends, self.encode_plain([" " + parts[i][-1] for i in ends])):
            owns[i][-1] = ids
        whole = [bool(own) and (UNSAFE in own or first[-1:].isspace()) for own, first in zip(owns, firsts)]
        plain = self.encode_plain([text if w else first for text, first, w in zip(texts, firsts, whole)])
        return [head if w else head + b"".join(own) for head, own, w in zip(plain, owns, whole)]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], np.uint32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lasting
def codec_of(v: Vocabulary) -> Codec:
    """One codec, and what it remembers, for all tasks of a worker process."""
    return Codec(v)


ROUND_TRIP = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, ids array<int>) for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(v)
        for rows in few_rows(batches):
            texts, keys = [t or "" for t in rows.column(1).to_pylist()], rows.column(0)
            for s in slices(texts):
                ids = [np.frombuffer(data, np.int32) for data in codec.encode_many(texts[s])]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(s.start, s.stop - s.start), lists], names=["doc_id", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>", keeps=codec_of)


def decode(encoded: DataFrame, v: Vocabulary) -> DataFrame:
    """(doc_id, data binary) for each row of encoded(doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(v)
        for rows in few_rows(batches):
            data = [codec.decode(ids or []) for ids in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return map_arrow(
        encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary", keeps=codec_of
    )


def round_trip(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Digests of the ids and of the bytes they decode to, for each row; ids stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(v)
        names = list(map(str, range(len(codec.tokens))))
        for rows in few_rows(batches):
            out: dict[str, list] = {k: [] for k in ROUND_TRIP}
            texts, keys = [t or "" for t in rows.column(1).to_pylist()], rows.column(0).to_pylist()
            for s in slices(texts):
                for doc, data in zip(keys[s], codec.encode_many(texts[s])):
                    ids = np.frombuffer(data, np.uint32).tolist()
                    spelled = " ".join(map(names.__getitem__, ids))
                    values = (doc, len(ids), hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())
                    for k, x in zip(ROUND_TRIP, values):
                        out[k].append(x)
            yield batch(out, ROUND_TRIP)

    narrow = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return map_arrow(narrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=codec_of)
