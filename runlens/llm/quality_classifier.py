"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, temperature calibration.

Random indexing: each word bucket has a sparse ternary index vector fixed by its hash. The vector of a unit (a word, or a
word's last three bytes, so that words seen once still say something) is the sum of the index vectors of the words
around it, over the whole corpus. Units are hashed into ``2**unit_bits`` buckets, so the table is bounded; each task sums
its own and one aggregation sums the tasks'. A document is the mean, the deviation and the product of neighbours of its
word vectors. The network learns from at most ``max_labelled`` labelled documents, taken by a hash of the id;
everything else reads all documents.

Defined results: null text counts as empty; an empty text has the zero vector and gets the network's value for it; with no
labels, or labels of one kind only, every score is the share of label 1 (0.5 without labels). Documents with
contradicting labels are not learnt from. Repeated rows are scored alike. Extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import WordHashes, as_bytes, batch, few_rows, keep_where, map_arrow, mix64, slices


#: Texts of about so many bytes are pooled at once, since each word takes several vectors meanwhile.
POOLED_BYTES = 500_000


@dataclass(frozen=True)
class Settings:
    unit_bits: int = 14
    dims: int = 32
    nonzeros: int = 2
    window: int = 2
    #: Bound of the labelled sample.
    max_labelled: int = 16_384
    hidden: int = 32
    epochs: int = 40
    seed: int = 7


def units(words: list[bytes], hashes: WordHashes, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: the unit of the word, the unit of its ending (in one table of buckets), and its 64-bit hash."""
    h = hashes.of(words)
    ends = hashes.of([w[-3:] for w in words])
    shift = np.uint64(64 - s.unit_bits)
    return (mix64(h) >> shift).astype(np.int64), (mix64(ends ^ np.uint64(0x5BD1E995)) >> shift).astype(np.int64), h


def index_entries(h: np.ndarray, s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """The places and signs of the nonzero entries of each word's index vector."""
    out = []
    for k in range(s.nonzeros):
        r = mix64(h + np.uint64((k + 1) * 0x632BE59BD9B4E019 % 2**64))
        out.append(((r % np.uint64(s.dims)).astype(np.int64), np.where(r >> np.uint64(63), 1.0, -1.0)))
    return out


def tokenised(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    parts = [t.split() for t in texts]
    return [w for p in parts for w in p], np.fromiter(map(len, parts), np.int64, len(parts))


def same_document(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def context_sums(docs: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """The table of unit vectors summed over all texts (2**unit_bits rows of ``dims`` numbers)."""
    n_units, d = 1 << s.unit_bits, s.dims

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(n_units * d), WordHashes()
        for b in few_rows(batches):
            texts = as_bytes(b.column(0))
            for part in slices(texts):
                words, sizes = tokenised(texts[part])
                if not words:
                    continue
                whole, ending, h = units(words, hashes, s)
                doc = same_document(sizes)
                entries = index_entries(h, s)
                for step in range(1, s.window + 1):
                    near = doc[step:] == doc[:-step]
                    for place, sign in entries:
                        for unit in (whole, ending):
                            left = (unit[:-step] * d + place[step:])[near]
                            right = (unit[step:] * d + place[:-step])[near]
                            total += np.bincount(left, sign[step:][near], minlength=len(total))
                            total += np.bincount(right, sign[:-step][near], minlength=len(total))
        table = total.reshape(n_units, d).astype(np.float32)
        at = np.flatnonzero(table.any(axis=1))
        yield batch(
            {"unit": at, "v": pa.FixedSizeListArray.from_arrays(pa.array(table[at].ravel()), d).cast(pa.list_(pa.float32()))},
            {"unit": pa.int64(), "v": pa.list_(pa.float32())},
        )

    parts = map_arrow(docs.select("text"), collect, "unit long, v array<float>")
    sums = parts.groupBy("unit").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(d)]).alias("v"))
    table = np.zeros((n_units, d), np.float32)
    for unit, v in sums.toLocalIterator():
        table[unit] = v
    return table


def unit_vectors(table: np.ndarray) -> np.ndarray:
    """Directions of the summed vectors after the common direction is taken away."""
    used = table.any(axis=1)
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    v = table / np.where(norms > 0, norms, 1)
    if used.any():
        v[used] -= v[used].mean(axis=0)
    return v.astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray, hashes: WordHashes, s: Settings) -> np.ndarray:
    """A row of 3 * dims numbers for each text: mean, deviation, mean product of neighbouring words."""
    words, sizes = tokenised(texts)
    d, n = s.dims, len(sizes)
    out = np.zeros((n, 3 * d), np.float64)
    if not words:
        return out
    whole, ending, _ = units(words, hashes, s)
    v = vectors[whole] + vectors[ending]
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    counts = sizes[some, None].astype(np.float64)
    mean = np.add.reduceat(v, starts, axis=0) / counts
    square = np.add.reduceat(v * v, starts, axis=0) / counts
    after = np.zeros_like(v)
    after[:-1] = v[:-1] * v[1:]
    after[starts + sizes[some] - 1] = 0
    product = np.add.reduceat(after, starts, axis=0) / np.maximum(counts - 1, 1)
    out[some] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), product])
    return out


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    #: Used alone where there was nothing to learn from.
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the temperature is fitted on the last fifth."""
    nothing = Network(*(np.zeros(1),) * 5, 0.0, 1.0, constant=float(y.mean()) if len(y) else 0.5)
    if len(set(y.tolist())) < 2:
        return nothing
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5]
    fit = order[len(y) // 5 :]
    center, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    z = np.clip((x - center) / scale, -8, 8)
    p = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], s.hidden)), np.zeros(s.hidden),
        rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), np.zeros(1),
    ]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    size = 128
    epochs = max(s.epochs, min(400, 4000 * size // max(len(fit), 1)))  # small samples need as many steps
    for epoch in range(epochs):
        rate = 0.003 * (1 - epoch / epochs) + 1e-4
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // size)):
            step += 1
            hid = np.tanh(z[rows] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(err, p[2]) * (1 - hid * hid)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), hid.T @ err + 1e-4 * p[2], np.array([err.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(center, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if len(held):
        logits, truth = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.5), np.log(5.0), 60))
        loss = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def labelled_sample(labels: DataFrame, learn_from, s: Settings) -> DataFrame:
    """At most ``max_labelled`` (doc_id, y), the same at every run: those of the smallest hash."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("y"), F.max("quality").alias("_most")
    )
    sure = one.where((F.col("y") == F.col("_most")) & F.col("y").isin(0, 1) & learn_from(F.col("doc_id")))
    return sure.select("doc_id", F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_labelled)


def fit(docs: DataFrame, labels: DataFrame, learn_from, s: Settings = Settings()) -> tuple[np.ndarray, Network]:
    """Unit vectors from all of docs(doc_id, text); the network from labels(doc_id, quality) where ``learn_from(id)``."""
    vectors = unit_vectors(context_sums(docs, s))
    model = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in few_rows(batches):
            texts = as_bytes(b.column(0))
            for part in slices(texts, POOLED_BYTES):
                x = pooled(texts[part], model.value, hashes, s).astype(np.float32)
                ys = b.column(1).slice(part.start, part.stop - part.start)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([ys, lists], names=["y", "x"])

    # The sample has a fixed bound, so it may be broadcast, and its features may go to the driver.
    sample = docs.select("doc_id", "text").join(F.broadcast(labelled_sample(labels, learn_from, s)), "doc_id")
    rows = map_arrow(sample.select("text", "y"), features, "y int, x array<float>").toArrow()
    y = np.array(rows.column("y").to_pylist(), float)
    x = np.array(rows.column("x").to_pylist(), float).reshape(len(y), 3 * s.dims)
    order = np.lexsort([*x.T[:4], y])  # the order in which rows arrive must not matter
    return vectors, train(x[order], y[order], s)


def score(docs: DataFrame, vectors: np.ndarray, net: Network, s: Settings = Settings()) -> DataFrame:
    """(doc_id, score) of each row of docs(doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in few_rows(batches):
            values = scores_of(as_bytes(b.column(1)), *model.value, hashes, s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def scores_of(texts: list[bytes], vectors: np.ndarray, net: Network, hashes: WordHashes, s: Settings) -> np.ndarray:
    got = [net.probabilities(pooled(texts[part], vectors, hashes, s)) for part in slices(texts, POOLED_BYTES)]
    return np.concatenate(got) if got else np.empty(0)


def keep_good(docs: DataFrame, vectors: np.ndarray, net: Network, limit: float, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that score ``limit`` or more, with all their columns, whatever their names."""
    model = docs.sparkSession.sparkContext.broadcast((vectors, net))
    return keep_where(docs, lambda texts: (scores_of(texts, *model.value, WordHashes(), s) >= limit).tolist())
