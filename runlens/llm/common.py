"""Helpers shared by the operators: batches of texts in tasks, words, hashes, stored tables.

Texts are handled as UTF-8 bytes. ``bytes.split()`` cuts at exactly the ASCII white space
``[\\x20\\x09-\\x0D]``, and ``bytes.lower()`` lower-cases exactly A-Z, so both give the words of the contracts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import cut_lineage, ship_package

#: Texts of about so many bytes are taken apart at once inside a task.
SLICE_BYTES = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def few_rows(batches: Iterator[pa.RecordBatch], most: int = 1_024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most``, for functions that make Python objects of a batch."""
    return (b.slice(at, most) for b in batches for at in range(0, b.num_rows, most))


def give_back() -> None:
    """Hand freed memory back to the system, which the C library otherwise keeps for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_LASTING: list = []


def lasting(make: Callable) -> Callable:
    """``make`` with its last result kept by the worker process, for tasks that say so (``map_arrow``); other tasks drop it."""
    kept = lru_cache(maxsize=1)(make)
    _LASTING.append(kept)
    return kept


def drop_lasting(keeps: Callable | None = None) -> None:
    """Drop what this process keeps of every other function than ``keeps``."""
    others = [kept for kept in _LASTING if kept is not keeps and kept.cache_info().currsize]
    for kept in others:
        kept.cache_clear()
    if others:
        give_back()


def map_arrow(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: Callable | None = None
) -> DataFrame:
    """``mapInArrow``; workers serve many tasks, so what a task has freed is given back when it ends, and what tasks of another operator
    have kept goes when it begins. ``keeps``: the ``lasting`` function that ``fn`` uses."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_lasting(keeps)
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared checkpoint folder and read back."""
    return cut_lineage(df)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Cells as UTF-8 bytes; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[slice]:
    """Cut a batch into runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def hash64(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(data, seed)


class WordHashes(dict):
    """64-bit hash of each word, remembered up to ``limit`` words (forgetting does not change results)."""

    def __init__(self, limit: int = 400_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all ``n``-word windows of a row of word hashes; order in the window counts."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out = mix64(out) + h[k : k + m]
    return mix64(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def batch(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Arrays in the order of ``types``."""
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x := columns[k], pa.Array) else pa.array(x, t) for k, t in types.items()], names=list(types)
    )


def sql_schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def keep_where(docs: DataFrame, good: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """The rows of ``docs`` whose texts are good, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            yield b.filter(pa.array(good(as_bytes(b.column(at))), pa.bool_()))

    return map_arrow(docs, run, sql_schema(docs))


#: At most so many ranges of ids; each is read as a stream, so their size does not matter for memory.
MAX_RANGES = 2_048


def key_ranges(keys: DataFrame, n: int, accuracy: int = 10_000) -> list[int]:
    """Up to ``n - 1`` increasing splitters of the only, integer column, from a mergeable quantile sketch of all rows."""
    if n < 2:
        return []
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    got = keys.agg(F.percentile_approx(keys.columns[0], probs, F.lit(accuracy)).alias("q")).first()["q"]
    return sorted(set(got or []))


def range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are at most the key, by binary search over a constant array."""
    if not splitters:
        return F.lit(0)
    cuts = F.array(*[F.lit(int(x)) for x in splitters])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(splitters).bit_length()))])
    return F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when((at + step <= len(splitters)) & (F.get(cuts, at + step - 1) <= key), at + step).otherwise(at),
    )


def with_id_ranges(docs: DataFrame) -> tuple[DataFrame, int]:
    """(range, key, doc_id, text): ``key`` is the id with null lowest, ``range`` grows with it. Also the number of ranges."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    n = min(MAX_RANGES, max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = key_ranges(docs.select(key.alias("key")), n)
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select(range_of(F.col("key"), cuts).alias("range"), "key", "doc_id", "text"), len(cuts) + 1
