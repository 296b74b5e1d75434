"""Quality rules: hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

Every document gives its byte n-grams to the raw multinomial, and the trusted ones give theirs to the target
multinomial as well. Both are vectors of ``buckets`` counts: each task sums its own, and one small aggregation sums the
tasks', so the model is bounded whatever the corpus. A document's score is the mean of log(p_target / p_raw) over its
n-grams, and one threshold holds for all documents, so equal texts always get the same verdict. It is -0.1, or lower where
that would cost more than one in a thousand trusted documents (as when one language has few labels); all trusted documents are scored
to find it.

Byte n-grams, not word n-grams: in the corpora at hand a tenth of all words occur once, so that a word table learns
little about the next document, while spelling, case and markup show in any few bytes.

Defined results: null text counts as empty; a text shorter than one n-gram scores 0 (no evidence) and is left to the
base rules; without trusted documents every score is 0. Repeated rows count each time. A document with contradicting
labels is not trusted. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import WordHashes, as_bytes, batch, few_rows, keep_where, map_arrow, shingles, slices

SYMBOLS = b"#*$%&|<>"  # fixed values of the base rule
SPACES = b" \t\n\r\x0b\x0c"

#: Texts of about so many bytes are taken apart at once, since each byte starts an n-gram of several longs.
GRAM_BYTES = 500_000


@dataclass(frozen=True)
class Rules:
    n: int = 4
    bits: int = 17
    #: Counts added to both multinomials in each bucket.
    smoothing: float = 2.0
    #: Least mean log-likelihood ratio (nats for each n-gram) of a kept document: this, or ``margin`` less than the score that
    #: all but a share ``spared`` of the trusted documents reach.
    threshold: float = -0.1
    spared: float = 0.001
    margin: float = 0.05
    min_words: int = 50
    max_repeated_percent: int = 50


@dataclass(frozen=True)
class Fitted:
    log_ratio: np.ndarray
    threshold: float


def ngram_buckets(text: bytes, n: int, bits: int) -> np.ndarray:
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(a) < n:
        return np.empty(0, np.int64)
    m = len(a) - n + 1
    x = a[:m].copy()
    for k in range(1, n):
        x = (x << np.uint64(8)) | a[k : k + m]
    x *= np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def joined_ngrams(texts: list[bytes], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of many texts in a row, and how many belong to each text; no n-gram spans two texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = ngram_buckets(b"".join(texts), n, bits)
    counts = np.maximum(sizes - n + 1, 0)
    starts = np.cumsum(sizes) - sizes
    if len(whole) == counts.sum():
        return whole, counts
    keep = np.zeros(len(whole) + 1, np.int32)
    some = counts > 0
    np.add.at(keep, starts[some], 1)
    np.add.at(keep, (starts + counts)[some], -1)
    return whole[np.cumsum(keep[:-1]) > 0], counts


def count_ngrams(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(bucket, raw, target) counts over all rows of docs(text, trusted boolean)."""
    size = 1 << rules.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in few_rows(batches):
            texts = as_bytes(b.column(0))
            trusted = np.array(b.column(1).to_pylist(), dtype=bool)
            for s in slices(texts, GRAM_BYTES):
                for flag in (True, False):
                    own = [t for t, g in zip(texts[s], trusted[s]) if g == flag]
                    if own:
                        got = np.bincount(joined_ngrams(own, rules.n, rules.bits)[0], minlength=size)
                        raw += got
                        if flag:
                            target += got
        at = np.flatnonzero(raw)
        yield batch(
            {"bucket": at, "raw": raw[at], "target": target[at]}, {"bucket": pa.int64(), "raw": pa.int64(), "target": pa.int64()}
        )

    parts = map_arrow(docs.select("text", F.coalesce("trusted", F.lit(False)).alias("trusted")), count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, trusted): whether all of a document's labels are 1."""
    return labels.groupBy("doc_id").agg((F.min("quality") == 1).alias("trusted"))


def fit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> Fitted:
    """The model from docs(doc_id, text) and labels(doc_id, quality).

    The counts that reach the driver are one row for each bucket, 2**bits at most, and one for each thousandth of a nat.
    """
    # Always the same join, so that a small label table does not make another plan than a large one.
    flagged = docs.select("doc_id", "text").join(trusted_ids(labels).hint("merge"), "doc_id", "left").select("text", "trusted")
    got = count_ngrams(flagged, rules).toPandas()
    raw, target = np.zeros(1 << rules.bits), np.zeros(1 << rules.bits)
    raw[got["bucket"]], target[got["bucket"]] = got["raw"], got["target"]
    if not target.sum():
        return Fitted(np.zeros(len(raw), np.float32), rules.threshold)
    expected = raw * (target.sum() / raw.sum())
    table = np.log((target + rules.smoothing) / (expected + rules.smoothing)).astype(np.float32)
    scored = log_ratios(docs, table, rules).join(trusted_ids(labels).where("trusted"), "doc_id")
    counts = sorted(scored.groupBy(F.floor(F.col("log_ratio") * 1000).alias("at")).count().collect())
    below, spared = 0, rules.spared * sum(r["count"] for r in counts)
    for r in counts:
        below += r["count"]
        if below > spared:
            return Fitted(table, min(rules.threshold, r["at"] / 1000 - rules.margin))
    return Fitted(table, rules.threshold)


def mean_ratios(texts: list[bytes], table: np.ndarray, rules: Rules) -> list[float]:
    grams, counts = joined_ngrams(texts, rules.n, rules.bits)
    sums = np.concatenate([[0.0], np.cumsum(table[grams], dtype=np.float64)])
    ends = np.cumsum(counts)
    return np.round((sums[ends] - sums[ends - counts]) / np.maximum(counts, 1), 9).tolist()


def log_ratios(docs: DataFrame, table: np.ndarray, rules: Rules) -> DataFrame:
    """(doc_id, log_ratio) of each row of docs(doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            texts = as_bytes(b.column(1))
            got = [x for s in slices(texts, GRAM_BYTES) for x in mean_ratios(texts[s], model.value, rules)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "log_ratio"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, log_ratio double")


def base_counts(text: bytes, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    n = len(words)
    symbols = sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
    # A code point is a byte that does not continue another.
    inner = np.frombuffer(text, np.uint8)
    chars = len(inner) - int(np.count_nonzero((inner & 0xC0) == 0x80))
    chars -= sum(map(text.count, (SPACES[i : i + 1] for i in range(len(SPACES)))))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dups = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        windows = shingles(hashes.of(words), 3)
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(twice)] |= twice
            repeated = int(covered.sum())
    return n, chars, symbols, dups, repeated


TYPES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "log_ratio": pa.float64(),
}


def apply_rules(docs: DataFrame, fitted: Fitted, rules: Rules = Rules()) -> DataFrame:
    """Each row of docs(doc_id, text): its counts, log_ratio, base_failed and kept."""
    model = docs.sparkSession.sparkContext.broadcast(fitted.log_ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in few_rows(batches):
            texts = as_bytes(b.column(1))
            rows: dict[str, list] = {k: [] for k in TYPES}
            for s in slices(texts, GRAM_BYTES):
                rows["log_ratio"] += mean_ratios(texts[s], model.value, rules)
                for t in texts[s]:
                    for k, v in zip(TYPES, base_counts(t, hashes)):
                        rows[k].append(v)
            own = [pa.array(rows[k], t) for k, t in TYPES.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), *own], names=["doc_id", *TYPES])

    kinds = ", ".join(f"{k} {'double' if pa.types.is_floating(t) else 'long'}" for k, t in TYPES.items())
    n = F.col("n_words")
    failed = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeated_percent * n)
    return (
        map_arrow(docs.select("doc_id", "text"), score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kinds}")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("log_ratio") >= fitted.threshold))
    )


def keep_good(docs: DataFrame, fitted: Fitted, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that ``apply_rules`` keeps, with all their columns, whatever their names."""
    model = docs.sparkSession.sparkContext.broadcast(fitted.log_ratio)

    def good(texts: list[bytes]) -> list[bool]:
        hashes = WordHashes()
        out = []
        for s in slices(texts, GRAM_BYTES):
            for t, ratio in zip(texts[s], mean_ratios(texts[s], model.value, rules)):
                n, _, _, _, repeated = base_counts(t, hashes)
                out.append(n >= rules.min_words and 100 * repeated <= rules.max_repeated_percent * n and ratio >= fitted.threshold)
        return out

    return keep_where(docs, good)
