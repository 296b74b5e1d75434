"""Token ids in files: one array of 16-bit ids for each block of documents, with Elias-Fano coded document boundaries.

A block holds documents that follow each other by id. Its boundaries 0 = b0 <= b1 <= ... <= bn rise to the block's token count u, so
they take about n * (2 + log2(u / n)) bits: the low l bits of each are packed, the high parts are a bit vector in which boundary i is
the i-th one, at place high + i. A directory counts the ones before each 512 bits; select(i) looks up the stretch and then
the place in it. Ids of documents are coded the same way, relative to the block's first. No table of 64-bit offsets is kept.

Files are written by Spark (one row for each block) and read back by Spark, so they may lie in any store, and a lost task is
written again. Documents reach the blocks through ranges of ids; each range is read as a sorted stream.

Defined results: null and empty texts have the end id only. Null ids come first. Rows that share an id follow each other by a hash of
their texts. Extra columns are ignored; no rows in, no rows out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.llm.common import as_bytes, batch, few_rows, map_arrow, slices, with_id_ranges
from runlens.llm.tokenizing import word_pieces

STRETCH = 512


@dataclass(frozen=True)
class Format:
    tokenizer: str
    end_id: int = 2
    #: A block is closed when it has so many tokens or documents.
    block_tokens: int = 1 << 20
    block_docs: int = 1 << 14


class EliasFano:
    """A rising sequence of whole numbers from 0 on."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, directory: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.directory = directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low_part = values & np.uint64((1 << low_bits) - 1)
        bits = (low_part[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        length = -(-(int(places[-1]) + 1 if n else 0) // STRETCH) * STRETCH
        high = np.zeros(length, np.uint8)
        high[places] = 1
        ones = high.reshape(-1, STRETCH).sum(axis=1, dtype=np.uint32)
        before = np.cumsum(ones, dtype=np.uint32) - ones
        return cls(n, low_bits, np.packbits(bits.ravel()).tobytes(), np.packbits(high).tobytes(), before.astype("<u4").tobytes())

    def select(self, which: np.ndarray) -> np.ndarray:
        """Values at the places ``which``."""
        which = np.asarray(which, np.int64)
        if not len(which):
            return np.empty(0, np.uint64)
        before = np.frombuffer(self.directory, "<u4").astype(np.int64)
        stretch = np.searchsorted(before, which, side="right") - 1
        out = np.empty(len(which), np.uint64)
        rows = np.frombuffer(self.high, np.uint8).reshape(-1, STRETCH // 8)
        low = np.frombuffer(self.low, np.uint8)
        for at in range(0, len(which), 4096):
            i, s = which[at : at + 4096], stretch[at : at + 4096]
            used, inverse = np.unique(s, return_inverse=True)
            ones = np.cumsum(np.unpackbits(rows[used], axis=1), axis=1, dtype=np.int32)
            # The place of one number r of a stretch is where the running count first exceeds r.
            flat = (ones + (np.arange(len(used)) * (STRETCH + 1))[:, None]).ravel()
            found = np.searchsorted(flat, inverse * (STRETCH + 1) + (i - before[s]) + 1, side="left")
            place = s * STRETCH + found - inverse * STRETCH
            value = (place - i).astype(np.uint64) << np.uint64(self.low_bits)
            for b in range(self.low_bits):
                bit = i * self.low_bits + b
                value |= ((low[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
            out[at : at + 4096] = value
        return out

    def all(self) -> np.ndarray:
        return self.select(np.arange(self.n))

    def cells(self, prefix: str) -> dict[str, object]:
        return {f"{prefix}_bits": self.low_bits, f"{prefix}_low": self.low, f"{prefix}_high": self.high, f"{prefix}_directory": self.directory}

    @classmethod
    def from_cells(cls, n: int, row: dict, prefix: str) -> EliasFano:
        return cls(n, *(row[f"{prefix}_{x}"] for x in ("bits", "low", "high", "directory")))


BLOCK = {
    "range": pa.int32(), "before": pa.int64(), "tokens": pa.int64(), "docs": pa.int64(), "nameless": pa.int64(), "first_id": pa.int64(),
    "bounds_bits": pa.int32(), "bounds_low": pa.binary(), "bounds_high": pa.binary(), "bounds_directory": pa.binary(),
    "names_bits": pa.int32(), "names_low": pa.binary(), "names_high": pa.binary(), "names_directory": pa.binary(), "ids": pa.binary(),
}
SQL_TYPES = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
BLOCK_SQL = ", ".join(f"{k} {SQL_TYPES[t]}" for k, t in BLOCK.items())


def block_row(where: int, before: int, names: list[int | None], ids: list[bytes]) -> dict[str, object]:
    known = np.array([x for x in names if x is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    bounds = np.cumsum([0, *(len(x) // 2 for x in ids)])
    relative = known.view(np.uint64) - np.array([first], np.int64).view(np.uint64) if len(known) else np.empty(0, np.uint64)
    return {
        "range": where, "before": before, "tokens": int(bounds[-1]), "docs": len(ids), "nameless": len(names) - len(known), "first_id": first,
        **EliasFano.of(bounds).cells("bounds"), **EliasFano.of(relative).cells("names"), "ids": b"".join(ids),
    }


def write_ids(docs: DataFrame, path: str, f: Format) -> None:
    """Write the blocks of docs(doc_id, text) below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_pieces(f.tokenizer)
        end = np.array([f.end_id], np.uint16).tobytes()
        where, before, names, ids, size = None, 0, [], [], 0

        def closed() -> pa.RecordBatch:
            row = block_row(where, before, names, ids)
            return batch({k: [row[k]] for k in BLOCK}, BLOCK)

        for rows in few_rows(batches):
            texts, ranges, keys = as_bytes(rows.column(2)), rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for s in slices(texts):
                for r, doc, data in zip(ranges[s], keys[s], encoder.encode(texts[s])):
                    if ids and (r != where or size >= f.block_tokens or len(ids) >= f.block_docs):
                        yield closed()
                        before = before + size if r == where else 0
                        names, ids, size = [], [], 0
                    where = r
                    names.append(doc)
                    ids.append(data + end)
                    size += len(data) // 2 + 1
        if ids:
            yield closed()

    rows, n = with_id_ranges(docs)
    ordered = rows.repartitionById(n, "range").sortWithinPartitions("range", "key", F.xxhash64("text")).select("range", "doc_id", "text")
    map_arrow(ordered, run, BLOCK_SQL, keeps=word_pieces).write.parquet(path)


READ = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}


def range_starts(blocks: DataFrame) -> DataFrame:
    """(range, base): ids before each range, of which there are MAX_RANGES at most."""
    whole = blocks.groupBy("range").agg(F.sum("tokens").alias("n"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    return whole.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                # One block at a time becomes Python objects.
                row = rows.slice(i, 1).to_pylist()[0]
                n = row["docs"]
                bounds = EliasFano.from_cells(n + 1, row, "bounds").select(np.arange(n + 1)).astype(np.int64)
                known = EliasFano.from_cells(n - row["nameless"], row, "names").all().view(np.int64) + row["first_id"]
                ids = np.frombuffer(row["ids"], np.uint16)
                spans = zip(bounds[:-1].tolist(), bounds[1:].tolist())
                out = {
                    "doc_id": [None] * row["nameless"] + known.tolist(), "start": bounds[:-1] + (row["base"] + row["before"]), "n_tokens": np.diff(bounds),
                    "ids_crc32": [zlib.crc32(ids[a:b].astype("<u4")) for a, b in spans],
                }
                yield batch(out, READ)

    blocks = spark.read.schema(BLOCK_SQL).parquet(path)
    based = blocks.join(F.broadcast(range_starts(blocks)), "range")
    return map_arrow(based, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(row: dict, which: int) -> np.ndarray:
    """Ids of document number ``which`` of a block read as a dictionary; only two boundaries are selected."""
    a, b = EliasFano.from_cells(row["docs"] + 1, row, "bounds").select(np.array([which, which + 1])).tolist()
    return np.frombuffer(row["ids"], np.uint16)[a:b]
