"""Packing token sequences by the harmonic rule.

A piece of length in (C/(k+1), C/k] is of class k, and a bin of class k takes exactly k pieces, whatever they are, so bins need no
search: each worker numbers the pieces it cuts within each class, counts of (class, worker) become offsets, and piece number g
goes to place g mod k of bin g div k of its class. Since documents may be cut, a piece is only kept whole if its class
wastes at most ``tolerance`` of a bin on such pieces; else the largest exact piece floor(C/k) is cut off and the rest is looked at
again. The last bin of each class may lack pieces. Those pieces, fewer than k of each class and so a bounded number, are
put together by first fit.

Defined results: null and empty texts have the end id only. Repeated rows and rows without id are packed like others. Extra columns
of the input are ignored. No rows in, no rows out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.llm.common import batch, few_rows, map_arrow, slices, stored
from runlens.llm.tokenizing import space_pieces


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    end_id: int = 0
    capacity: int = 1024
    tolerance: float = 1 / 128


@lru_cache(maxsize=None)
def cuts(length: int, capacity: int, tolerance: float) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of a rest shorter than ``capacity``, in order."""
    out = []
    while length:
        k = capacity // length
        if capacity - k * length <= tolerance * capacity:
            out.append((length, k))
            break
        exact = capacity // (k + 1)
        out.append((exact, capacity // exact))
        length -= exact
    return tuple(out)


def pieces_of(length: int, capacity: int, tolerance: float) -> list[tuple[int, int]]:
    return [(capacity, 1)] * (length // capacity) + list(cuts(length % capacity, capacity, tolerance))


PIECE = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(),
    "class": pa.int32(), "worker": pa.int32(), "number": pa.int64(),
}


def cut_documents(docs: DataFrame, p: Packing) -> DataFrame:
    """One row for each piece, numbered within (class, worker)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, worker = space_pieces(p.tokenizer), TaskContext.get().partitionId()
        numbers: dict[int, int] = defaultdict(int)
        end = np.array([p.end_id], np.uint16).tobytes()
        for rows in few_rows(batches, 4_096):
            texts = [t or "" for t in rows.column(1).to_pylist()]
            ids = rows.column(0).to_pylist()
            out: dict[str, list] = {k: [] for k in PIECE}
            for s in slices(texts, 8_000_000):
                for doc, data in zip(ids[s], encoder.encode(texts[s])):
                    tokens = np.frombuffer(data + end, np.uint16).astype("<u4")
                    view, at = memoryview(tokens).cast("B"), 0
                    for length, k in pieces_of(len(tokens), p.capacity, p.tolerance):
                        crc = zlib.crc32(view[4 * at : 4 * (at + length)])
                        for name, v in zip(PIECE, (doc, at, length, crc, len(tokens), k, worker, numbers[k])):
                            out[name].append(v)
                        numbers[k] += 1
                        at += length
            yield batch(out, PIECE)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(
        narrow, run,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, worker int, number long",
        keeps=space_pieces,
    )


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, longest first; for the bounded rest only."""
    free: list[int] = []
    placed = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, room in enumerate(free) if room >= lengths[i]), len(free))
        if at == len(free):
            free.append(capacity)
        placed[i] = (at, capacity - free[at])
        free[at] -= lengths[i]
    return placed


def pack(docs: DataFrame, p: Packing) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of docs(doc_id, text)."""
    spark = docs.sparkSession
    pieces = stored(cut_documents(docs, p))
    counts = pieces.groupBy("class", "worker").agg(F.count("*").alias("n"))
    before = W.partitionBy("class").orderBy("worker").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("class", "worker", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # At most one row for each of the classes, of which there are about 2 * sqrt(capacity).
    sizes = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    bases, total = {}, 0
    for k in sorted(sizes):
        bases[k] = total
        total += sizes[k] // k
    classes = spark.createDataFrame(
        [(k, bases[k], sizes[k] // k) for k in sorted(sizes)], "class int, base long, bins long"
    )
    k = F.col("class")
    placed = (
        pieces.join(offsets, ["class", "worker"]).join(F.broadcast(classes), "class")
        .withColumn("g", F.col("shift") + F.col("number"))
        .withColumn("bin", F.floor(F.col("g") / k))
        .drop("worker", "number", "shift")
    )
    earlier = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = (
        placed.where(F.col("bin") < F.col("bins"))
        .withColumn("sequence_id", F.col("base") + F.col("bin")).withColumn("place", F.col("g") % k)
        .withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
        .select(*columns)
    )
    rest = placed.where(F.col("bin") >= F.col("bins"))
    # Fewer than k pieces of each class k.
    left = rest.select("class", "g", "length").orderBy("class", "g").collect()
    spots = first_fit([r["length"] for r in left], p.capacity)
    where = spark.createDataFrame(
        [(r["class"], r["g"], total + b, o) for r, (b, o) in zip(left, spots)], "class int, g long, sequence_id long, offset long"
    )
    return full.union(rest.join(F.broadcast(where), ["class", "g"]).select(*columns))
