"""SimHash fingerprints, and an exact search within a Hamming radius.

The terms of a text are its lower-cased word pairs (its only word, if it has one); a term's weight is 1 + ln(times it occurs).
Each term's 128 hash bits vote with its weight, and the sign of each sum is a bit of the fingerprint. Two fingerprints that differ
in h of b bits have an angle of about pi * h / b, whose cosine is the likeness (not below 0).

Search: equal fingerprints are one class with a count, whatever the number of copies. Eight tables hold every class, each led by
another 16-bit block. Of two fingerprints within the radius r, some block t differs in no more than radii[t] bits, where the numbers
radii[t] + 1 add up to r + 1. A query therefore takes from table t the classes under all keys so close to its own block, and a pair is
counted bit by bit, in the first table that brings it together. Tables are cut by leading bits of their block into cells of a bounded
size, a crowded cell further by a hash; only queries are copied to cells, classes never.
The pairs (query, class) come out as one list of classes for each query; the members of a class are the rows with its fingerprint.

Documents are compared with their successor by id. Ids are cut into ranges; the first document of each range is also given to the range
before it (the first of all to the last), so one sorted pass over each range sees every pair.

Defined results: null and empty texts, and texts of white space, have the fingerprint of all zeros. Null ids come first. Rows that
share an id follow each other by a hash of their texts. A single row is its own successor. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import WordHashes, batch, map_arrow, mix64, shingles, stored, with_id_ranges

LANES = 2
BITS = 64 * LANES
BLOCK = 16
TABLES = BITS // BLOCK


#: A cosine of 0.8 is 26 bits in the mean; the others allow for the deviation of 4.5 bits (README: recall).
NEAR_COPIES = 32


@dataclass(frozen=True)
class Search:
    radius: int = 3
    #: Rows whose id is divisible by this are the queries.
    every: int = 50
    #: About so many classes are in a cell of a table, and queries in a part of those that visit it.
    classes: int = 65_536
    queries: int = 4_096


def fingerprint(text: bytes, hashes: WordHashes) -> bytes:
    words = text.lower().split()
    if not words:
        return bytes(BITS // 8)
    terms, times = np.unique(shingles(hashes.of(words), min(2, len(words))), return_counts=True)
    weights = (1 + np.log(times)).astype(np.float32)
    votes = np.zeros(BITS, np.float32)
    for at in range(0, len(terms), 4096):
        t = terms[at : at + 4096]
        lanes = np.stack([mix64(t + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) for k in range(LANES)], axis=1)
        bits = np.unpackbits(lanes.view(np.uint8), axis=1)
        votes += weights[at : at + 4096] @ bits.astype(np.float32)
    return np.packbits(2 * votes > weights.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    differing = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, round(float(np.cos(np.pi * differing / BITS)), 6))


def edited(text: str, after: str) -> str:
    """The last quarter replaced by as much of the beginning of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def in_id_order(docs: DataFrame) -> DataFrame:
    """(range, guard, doc_id, text), sorted within partitions; a guard row is the next range's first document."""
    rows, n = with_id_ranges(docs)
    # One row for each range, MAX_RANGES at most.
    firsts = rows.groupBy("range").agg(F.min("key").alias("key")).orderBy("range").collect()
    first, before = [None] * n, [0] * n
    for i, r in enumerate(firsts):
        first[r["range"]], before[r["range"]] = r["key"], firsts[i - 1]["range"]
    own = F.struct(F.col("range"), F.lit(False).alias("guard"))
    guard = F.struct(F.get(F.array(*map(F.lit, before)), F.col("range")).alias("range"), F.lit(True).alias("guard"))
    leads = F.col("key") == F.get(F.array(*[F.lit(x).cast("long") for x in first]), F.col("range"))
    places = F.when(leads, F.array(own, guard)).otherwise(F.array(own))
    placed = rows.select(F.explode(places).alias("p"), "key", "doc_id", "text").select("p.range", "p.guard", "key", "doc_id", "text")
    return (
        placed.repartitionById(n, "range").sortWithinPartitions("range", "guard", "key", F.xxhash64("text"))
        .select("range", "guard", "doc_id", "text")
    )


TYPES = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}


def compare_successors(docs: DataFrame) -> DataFrame:
    """The fingerprint of each row of docs(doc_id, text), of its edited text, and their likenesses."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Rows with their fingerprints, each batch with the last row of the one before."""
        hashes, last = WordHashes(), []
        for rows in batches:
            texts = [t or "" for t in rows.column(3).to_pylist()]
            prints = [fingerprint(t.encode(), hashes) for t in texts]
            here = list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), texts, prints))
            yield hashes, [*last, *here]
            last = here[-1:] or last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, rows in flat(batches):
            out: dict[str, list] = {k: [] for k in TYPES}
            for (where, guard, doc, text, own), (there, _, _, after, following) in pairwise(rows):
                if guard or where != there:
                    continue
                changed = edited(text, after).encode()
                other = fingerprint(changed, hashes)
                values = (
                    doc, len(text), hashlib.sha256(changed).hexdigest(), own.hex(), other.hex(), likeness(own, other), likeness(own, following),
                )
                for k, v in zip(TYPES, values):
                    out[k].append(v)
            yield batch(out, TYPES)

    return map_arrow(
        in_id_order(docs), run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def block_radii(radius: int) -> list[int]:
    """Bits in which a block may differ; -1: its table is not needed."""
    return [(radius + 1 + TABLES - 1 - t) // TABLES - 1 for t in range(TABLES)]


@lru_cache(maxsize=32)
def masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of so many bits with at most ``radius`` of them set."""
    every = np.arange(2**bits, dtype=np.int64)
    return every[np.bitwise_count(every) <= radius] if radius >= 0 else every[:0]


def blocks_of(cells: pa.Array) -> np.ndarray:
    """Binary fingerprints as rows of 16-bit blocks."""
    return np.frombuffer(b"".join(cells.to_pylist()), ">u2").astype(np.uint16).reshape(-1, TABLES)


class Cell:
    """Classes of one cell of a table, in the order of the block that leads it."""

    def __init__(self, table: int, high: int, high_bits: int, blocks: np.ndarray, copies: np.ndarray):
        order = np.argsort(blocks[:, table], kind="stable")
        self.table, self.blocks, self.copies = table, blocks[order], copies[order]
        self.low_bits = BLOCK - high_bits
        self.high = high
        low = self.blocks[:, table].astype(np.int64) & (2**self.low_bits - 1)
        self.starts = np.searchsorted(low, np.arange(2**self.low_bits + 1))

    def near(self, query: np.ndarray, radius: int, radii: np.ndarray) -> np.ndarray:
        """Places of the classes within the radius that no earlier table brings together with the query."""
        own = int(query[self.table])
        spent = ((own >> self.low_bits) ^ self.high).bit_count()
        keys = masks(self.low_bits, int(radii[self.table]) - spent) ^ (own & (2**self.low_bits - 1))
        first, n = self.starts[keys], self.starts[keys + 1] - self.starts[keys]
        held = n > 0
        first, n = first[held], n[held]
        # The places first[k] .. first[k] + n[k] - 1, one after another.
        places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        bits = np.bitwise_count(self.blocks[places] ^ query)
        within = bits.sum(axis=1, dtype=np.int64) <= radius
        places, bits = places[within], bits[within]
        return places[np.argmax(bits <= radii, axis=1) == self.table]


def within_radius(prints: DataFrame, wanted: DataFrame, s: Search = Search()) -> DataFrame:
    """(fingerprint, n_within, within): for each of wanted(fingerprint), how many rows of prints(fingerprint) lie within the radius,
    and the fingerprints of their classes, sorted."""
    counted = stored(prints.groupBy("fingerprint").agg(F.count("*").alias("copies")))
    asked = stored(wanted.select("fingerprint").distinct())
    radii = block_radii(s.radius)
    n_classes = counted.count()
    high_bits = min(BLOCK, max(0, -(-n_classes // s.classes) - 1).bit_length())
    n = max(TABLES, TABLES * -(-n_classes // s.classes))
    parts = max(1, -(-asked.count() // s.queries))

    def leading(table):
        key = F.conv(F.substring("fingerprint", table * (BLOCK // 4) + 1, F.lit(BLOCK // 4)), 16, 10).cast("int")
        return F.shiftright(key, BLOCK - high_bits)

    used = F.array(*[F.lit(t) for t in range(TABLES) if radii[t] >= 0])
    tabled = counted.withColumn("table", F.explode(used)).withColumn("high", leading(F.col("table")))
    # One row for each cell of a table: TABLES * 2^16 rows at most.
    pieces = F.broadcast(tabled.groupBy("table", "high").agg(F.ceil(F.count("*") / s.classes).alias("pieces")))
    own = F.unhex("fingerprint").alias("own")
    cell = ("table", "high", "piece")
    classes = (
        tabled.join(pieces, ["table", "high"]).withColumn("piece", F.pmod(F.xxhash64("fingerprint"), "pieces"))
        .groupBy(*cell).agg(F.collect_list(F.struct(own, "copies")).alias("members")).select(*cell, F.lit(0).alias("part"), "members")
    )
    near_cells = F.array(*[
        F.struct(F.lit(t).alias("table"), F.array(*[F.lit(int(m)) for m in masks(high_bits, min(high_bits, radii[t]))]).alias("changes"))
        for t in range(TABLES) if radii[t] >= 0
    ])
    visits = (
        asked.withColumn("c", F.explode(near_cells)).select("fingerprint", "c.table", F.explode("c.changes").alias("change"))
        .withColumn("high", leading(F.col("table")).bitwiseXOR(F.col("change"))).join(pieces, ["table", "high"])
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        .groupBy(*cell, (F.pmod(F.xxhash64("fingerprint"), F.lit(parts)) + 1).cast("int").alias("part"))
        .agg(F.collect_list(F.struct(own, F.lit(0).cast("long").alias("copies"))).alias("members"))
    )
    cells = classes.unionByName(visits).repartition(n, *cell).sortWithinPartitions(*cell, "part")
    types = {"fingerprint": pa.string(), "n": pa.int64(), "found": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, limits = None, np.array(radii)
        for rows in batches:
            for i in range(rows.num_rows):
                table, high, _, part = (rows.column(k)[i].as_py() for k in range(4))
                members = rows.column(4)[i].values
                blocks = blocks_of(members.field(0))
                if part == 0:  # the classes of a cell come before its queries
                    there = Cell(table, high, high_bits, blocks, members.field(1).to_numpy())
                    continue
                out: dict[str, list] = {k: [] for k in types}
                for q in blocks:
                    found = there.near(q, s.radius, limits)
                    if len(found):
                        out["fingerprint"].append(q.astype(">u2").tobytes().hex())
                        out["n"].append(int(there.copies[found].sum()))
                        out["found"].append([x.astype(">u2").tobytes().hex() for x in there.blocks[found]])
                yield batch(out, types)

    near = map_arrow(cells, run, "fingerprint string, n long, found array<string>")
    return near.groupBy("fingerprint").agg(
        F.sum("n").alias("n_within"), F.array_sort(F.flatten(F.collect_list("found"))).alias("within")
    )
