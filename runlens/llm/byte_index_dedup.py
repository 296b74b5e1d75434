"""SimHash near-duplicates through an inverted index over byte positions.

A fingerprint has 64 bits, eight bytes at eight positions. Two fingerprints that differ in at most ``radius`` bits differ in at most that
many bytes, so they share at least 8 - radius of them: the guaranteed minimum. The index posts a fingerprint under what it
shares with a partner, so that lists stay short and a tally never starts from one common byte:

1. Every distinct fingerprint is posted under each choice of half of the positions that must survive (for radius 2: the positions are
   paired, and two of the four pairs are untouched, six lists a fingerprint). Lists are only counted here; a fingerprint that is
   alone in all of them has no partner and is done. That is most of the corpus.
2. The rest is posted under each choice of 8 - radius positions with their bytes (28 lists for radius 2). Every pair that reaches the
   minimum meets in one. Such a list leaves ``radius`` bytes open, so it holds at most 256**radius distinct fingerprints however
   many documents there are.
3. Lists go by as sorted streams. Members are compared with their next ``near`` neighbours at once; in longer lists each
   member looks its partners up among the open bytes, flipping one or two bits, which is linear in the list. The bytes that a
   pair shares are tallied, pairs below the minimum dropped, the bits of the others counted.

Links leave a list as one link for each member to the least partner it has there, plus links along the chain of partners, never as all pairs.
Equal fingerprints are one row from the start, so exact copies cost nothing.

Defined cases: documents without words (null, empty, blank texts) have fingerprint zero, which links like any other; rows with a null
id are fingerprinted, but name no component: their component is the smallest id that is reachable, null if there is none; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import as_bytes, batch, map_arrow, signed, slices, stored
from runlens.llm.components import connected_components

BYTES = 8


@dataclass(frozen=True)
class ByteIndex:
    words: int = 3
    radius: int = 2
    seed: int = 42
    #: Lists up to so many members are compared neighbour by neighbour.
    near: int = 12


# ---- fingerprints ----


def fingerprint_of(text: bytes, index: ByteIndex) -> int:
    """Signed votes of the shingles, repeats included; a bit is set if more than half of them set it."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(1, len(words) - index.words + 1)
    lo, hi = starts[:n].tolist(), ends[-n:].tolist()
    seed, digest = index.seed, xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(whole[a:b], seed) for a, b in zip(lo, hi)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, index: ByteIndex = ByteIndex()) -> DataFrame:
    """(doc_id, bits) of every row; bits is the fingerprint as a signed 64-bit number."""
    kinds = {"doc_id": pa.int64(), "bits": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            for part in slices(texts):
                found = np.array([fingerprint_of(t, index) for t in texts[part]], np.uint64)
                yield batch({"doc_id": b.column(0)[part.start : part.stop], "bits": signed(found)}, kinds)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, bits long")


# ---- index ----


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << 8 * p for p in positions)
    return value - (1 << 64) if value >> 63 else value


def _posted(bits: DataFrame, choices: list[tuple[int, ...]]) -> DataFrame:
    """(positions, shared, bits): one posting for each choice; ``shared`` are the bytes at its positions."""
    lists = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("positions"), F.col("bits").bitwiseAND(F.lit(_mask(c))).alias("shared")) for i, c in enumerate(choices)])
    return bits.select("bits", F.explode(lists).alias("l")).select("l.positions", "l.shared", "bits")


def coarse_choices(radius: int) -> list[tuple[int, ...]]:
    """Positions in ``2 * radius`` parts, of which ``radius`` are untouched."""
    parts = [p for p in np.array_split(np.arange(BYTES), min(BYTES, 2 * radius))]
    kept = len(parts) - radius
    return [tuple(int(x) for p in c for x in p) for c in itertools.combinations(parts, kept)]


def fine_choices(radius: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(BYTES), BYTES - radius))


def with_company(bits: DataFrame, index: ByteIndex) -> DataFrame:
    """The fingerprints that share a coarse list with another one."""
    posted = _posted(bits, coarse_choices(index.radius))
    # min and max tell whether a list has two members, without counting or collecting it.
    crowded = posted.groupBy("positions", "shared").agg(F.min("bits").alias("lo"), F.max("bits").alias("hi")).where("lo < hi")
    return posted.join(crowded.select("positions", "shared"), ["positions", "shared"], "left_semi").select("bits").distinct()


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many bytes of each XOR are zero: the tally of a pair."""
    return (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(1)


def _flips(positions: tuple[int, ...], radius: int) -> list[int]:
    """XOR masks with 1 to ``radius`` bits at the positions that a list leaves open."""
    free = [8 * p + k for p in range(BYTES) if p not in positions for k in range(8)]
    return [sum(1 << b for b in c) for r in range(1, radius + 1) for c in itertools.combinations(free, r)]


def _verified(a: np.ndarray, b: np.ndarray, index: ByteIndex) -> np.ndarray:
    x = a ^ b
    return (_shared_bytes(x) >= BYTES - index.radius) & (_ones(x) <= index.radius)


def list_links(place: np.ndarray, shared: np.ndarray, bits: np.ndarray, index: ByteIndex) -> tuple[np.ndarray, np.ndarray]:
    """Links within complete lists, which lie side by side; members in increasing order of the unsigned fingerprint.

    Each member is linked with its partners among the next ``near`` ones. In a longer list it is linked with its least partner, and
    with every partner that is the first after it by one flip; components are those of all pairs.
    """
    n = len(bits)
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (shared[1:] != shared[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, n))
    ids = np.repeat(np.arange(len(heads)), sizes)
    small = sizes[ids] <= index.near
    left, right = [], []
    for d in range(1, min(index.near, n)):
        ok = np.flatnonzero((ids[d:] == ids[:-d]) & small[d:])
        ok = ok[_verified(bits[ok], bits[ok + d], index)]
        left.append(bits[ok])
        right.append(bits[ok + d])
    for k in np.flatnonzero(sizes > index.near):
        members = bits[heads[k] : heads[k] + sizes[k]]
        # Each member has at most 136 partners (two open bytes); all of them are looked up, the forest that joins them is kept.
        root = np.arange(len(members))
        for flip in _flips(fine_choices(index.radius)[place[heads[k]]], index.radius):
            other = members ^ np.uint64(flip)
            at = np.searchsorted(members, other)
            at[at == len(members)] = 0
            hit = np.flatnonzero((members[at] == other) & (members < other))
            hit = hit[root[hit] != root[at[hit]]]
            if not len(hit):
                continue
            left.append(members[hit])
            right.append(members[at[hit]])
            root = _joined(root, hit, at[hit])
    return (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (left, right))


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component numbers after joining those of a[i] and b[i]."""
    while True:
        lo = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], lo)
        np.minimum.at(root, root[b], lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            return root


def links(bits: DataFrame, index: ByteIndex = ByteIndex()) -> DataFrame:
    """(a, b): fingerprints within the radius; enough links that components are those of all such pairs. ``bits`` are distinct."""
    kinds = {"a": pa.int64(), "b": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in itertools.chain(batches, [None]):
            if b is not None:
                now = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
                rows = [np.concatenate(x) for x in zip(held, now)] if held else now
                if not len(rows[0]):
                    continue
                # The last list may go on in the next batch; it is bounded, so it can wait.
                cut = int(np.flatnonzero(np.append(True, (np.diff(rows[0]) != 0) | (rows[1][1:] != rows[1][:-1])))[-1])
                rows, held = [x[:cut] for x in rows], [x[cut:] for x in rows]
            elif held:
                rows = held
            else:
                break
            if len(rows[0]):
                left, right = list_links(*rows, index)
                yield batch({"a": signed(left), "b": signed(right)}, kinds)

    posted = _posted(bits, fine_choices(index.radius))
    order = F.col("bits").bitwiseXOR(F.lit(-(2**63)))
    dealt = posted.repartition("positions", "shared").sortWithinPartitions("positions", "shared", order)
    return map_arrow(dealt, run, "a long, b long").distinct()


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def near_duplicates(docs: DataFrame, index: ByteIndex = ByteIndex()) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; the component is the smallest id that chains of links reach."""
    rows = stored(fingerprints(docs, index))
    classes = stored(rows.groupBy("bits").agg(F.min("doc_id").alias("least")))
    company = stored(with_company(classes.select("bits"), index))
    parts = connected_components(links(company, index))
    named = classes.join(parts.withColumnRenamed("id", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    member = stored(named.join(smallest, "component").select("bits", "component_id"))
    return rows.join(member, "bits").select("doc_id", as_hex(F.col("bits")).alias("fingerprint"), "component_id")
