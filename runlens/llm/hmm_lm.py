"""A hidden Markov language model: Baum-Welch over all training texts, exact likelihood by the scaled forward recursion.

Tokens: lower-cased words, then one end. The states emit symbols: each of the ``own`` most frequent words and the end has one, the
other words share ``groups`` symbols by their last three bytes. Within a group a word has probability
(c + 0.5) / (C + 0.5 * (V + 1)) whatever the state (c: its count; C, V: tokens and types of the group's other words; the +1 is one
unknown word), so the likelihood of a text is the forward recursion over its symbols times those factors.

* Word counts of the training texts are summed in tasks and then by word (64-bit hashes). The ``known`` most frequent words are sent
  to all tasks, a bounded table; counts of the rarer words of each text come by a join, which has no hot keys, as the frequent words
  are not in it.
* Texts are stored once as 16-bit symbols. Every Baum-Welch step sums expected counts in each task and then over tasks: states x symbols
  numbers, whatever the corpus. The first steps go through the corpus part by part (each text in one part) with a falling step size;
  then steps go through all texts until the likelihood settles, and the model is made of the counts of the last.

Defined results: null and empty texts consist of the end. Null ids are trained on (their text form is empty, remainder 0). Repeated rows
count and are scored each. Without training texts, counts are 0 and the states are alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import WordHashes, batch, crc_mod, map_arrow, mix64, signed, stored

END = b" "  # no word holds a blank


@dataclass(frozen=True)
class Model:
    states: int = 12
    own: int = 16_384
    groups: int = 4_096
    #: Bound of the table of frequent words and their counts.
    known: int = 262_144
    #: The first steps go through so many parts, which are all of the corpus.
    parts: int = 8
    #: Steps through all texts end when one raises the log likelihood by no more than this share.
    settled: float = 1e-3
    #: Weight of the overall symbol shares in each state's emissions, and of each transition.
    prior: float = 20.0
    seed: int = 5

    @property
    def symbols(self) -> int:
        return self.own + 1 + self.groups


def light(rows: pa.RecordBatch, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text."""
    sizes = pc.binary_length(rows.column(rows.schema.get_field_index("text"))).fill_null(0).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1).tolist(), rows.num_rows]
    return (rows.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct lower-cased words, for each word of the texts its place among them, and how many words there are up to each text's end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = lists.flatten()
    # An empty one stands at either end of a text with white space there.
    real = pc.greater(pc.binary_length(flat), 0)
    stops = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy()[1:]]
    coded = flat.filter(real).dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), stops


def group_of(words: list[bytes], hashes: WordHashes, m: Model) -> np.ndarray:
    return (mix64(hashes.of([w[-3:] for w in words]) ^ np.uint64(0xA5A5)) % np.uint64(m.groups)).astype(np.int64)


def groups_of(words: pa.Array, m: Model) -> np.ndarray:
    """``group_of`` words in an array, each distinct ending hashed once."""
    coded = pc.binary_slice(words, -3).dictionary_encode()
    return group_of(coded.dictionary.to_pylist(), WordHashes(), m)[coded.indices.to_numpy()]


def signed_hashes(words: pa.Array) -> np.ndarray:
    return signed(np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words)))


def count_words(docs: DataFrame, m: Model) -> DataFrame:
    """(word, group, n) of docs(text): how often each word, known by its hash, occurs."""
    types = {"word": pa.int64(), "group": pa.int32(), "n": pa.int64()}

    def merged(tables: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        words, groups, counts = map(np.concatenate, zip(*tables))
        found, first, which = np.unique(words, return_index=True, return_inverse=True)
        return found, groups[first], np.bincount(which, counts, minlength=len(found)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[tuple[np.ndarray, ...]] = []
        ends = 0
        for rows in batches:
            ends += rows.num_rows
            for part in light(rows):
                words, which, _ = distinct_words(part.column(0))
                tables.append((signed_hashes(words), groups_of(words, m), np.bincount(which, minlength=len(words))))
                if sum(len(t[0]) for t in tables) > 600_000:
                    tables = [merged(tables)]
                    if len(tables[0][0]) > 600_000:
                        yield batch(dict(zip(types, tables.pop())), types)
        if ends:
            end = pa.array([END])
            tables.append((signed_hashes(end), groups_of(end, m), np.array([ends])))
            yield batch(dict(zip(types, merged(tables))), types)

    parts = map_arrow(docs.select("text"), run, "word long, `group` int, n long")
    return parts.groupBy("word").agg(F.first("group").alias("group"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The frequent words, sorted by hash, and the size of each group; bounded by the model's parameters."""

    words: np.ndarray
    counts: np.ndarray
    groups: np.ndarray
    symbols: np.ndarray  # of words with one of their own, else -1
    group_logs: np.ndarray  # log10 of each group's denominator
    tokens: int
    types: int
    end_count: int
    shares: np.ndarray  # of the symbols, over all training tokens

    @property
    def base_log(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.types + 1)))


def most_frequent(counts: DataFrame, most: int):
    """The ``most`` rows of counts(word, group, n) with the largest n (ties: smallest word), as a pandas table.

    Two histograms find the last row that belongs to them, first over steps of n, then over (n, first bits of the word) within one
    step, so little more than ``most`` rows leave the executors, however many tasks hold the table.
    """
    step, lead = F.floor(F.log2("n") * 64).cast("int"), F.shiftright("word", 52).cast("int")

    def cut(sizes: list, left: int):
        """The first of the sorted (key, size) whose rows no longer all fit, and what is left for it."""
        for key, size in sizes:
            if size > left:
                return key, left
            left -= size
        return None, left

    steps = [(r[0], r[1]) for r in counts.groupBy(step.alias("s")).agg(F.count("*")).collect()]
    last, left = cut(sorted(steps, reverse=True), most)
    if last is None:
        return counts.toPandas().sort_values(["n", "word"], ascending=[False, True], kind="stable").reset_index(drop=True)
    fine = counts.where(step == last).groupBy("n", lead.alias("l")).agg(F.count("*")).collect()
    (n, at), _ = cut(sorted((((r[0], r[1]), r[2]) for r in fine), key=lambda x: (-x[0][0], x[0][1])), left)
    inside = (step > last) | (step == last) & ((F.col("n") > n) | (F.col("n") == n) & (lead <= at))
    return counts.where(inside).toPandas().sort_values(["n", "word"], ascending=[False, True], kind="stable").head(most).reset_index(drop=True)


def vocabulary(counts: DataFrame, m: Model) -> Vocabulary:
    end = int(signed(np.array([WordHashes().__missing__(END)], np.uint64))[0])
    totals = counts.agg(F.sum("n"), F.count("*")).first()
    per_group = counts.where(F.col("word") != end).groupBy("group").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
    top = most_frequent(counts.where(F.col("word") != end), m.known)
    ends = counts.where(F.col("word") == end).first()
    size, kinds = np.zeros(m.groups), np.zeros(m.groups)
    size[per_group["group"]], kinds[per_group["group"]] = per_group["n"], per_group["v"]
    own = top.iloc[: m.own]
    np.subtract.at(size, own["group"].to_numpy(np.int64), own["n"].to_numpy(np.float64))
    np.subtract.at(kinds, own["group"].to_numpy(np.int64), 1.0)
    symbols = np.full(len(top), -1, np.int64)
    symbols[: len(own)] = np.arange(len(own))
    end_count = int(ends["n"]) if ends else 0
    shares = np.zeros(m.symbols)
    shares[: len(own)] = own["n"]
    shares[m.own] = end_count
    shares[m.own + 1 :] = size
    order = np.argsort(top["word"].to_numpy(np.int64))
    return Vocabulary(
        top["word"].to_numpy(np.int64)[order], top["n"].to_numpy(np.int64)[order], top["group"].to_numpy(np.int64)[order], symbols[order], np.log10(size + 0.5 * (kinds + 1)),
        int(totals[0] or 0), int(totals[1]), end_count, (shares + 0.5) / (shares + 0.5).sum(),
    )


CODED = {
    "row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(),
    "count_logs": pa.float64(), "within": pa.float64(), "symbols": pa.binary(), "rare": pa.list_(pa.int64()), "times": pa.list_(pa.int32()),
}


def encode(docs: DataFrame, v: Vocabulary, m: Model) -> DataFrame:
    """Each row of docs(doc_id, text, held_out) as symbols, with the sums that frequent words allow and its rarer words."""
    model = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, row = model.value, TaskContext.get().partitionId() << 33
        logs = np.log10(voc.counts + 0.5)
        end_log = float(np.log10(voc.end_count + 0.5))
        shared = voc.symbols < 0
        symbol_of = np.where(shared, m.own + 1 + voc.groups, voc.symbols)
        within_of = np.where(shared, logs - voc.group_logs[voc.groups], 0.0)
        for rows in batches:
            for part in light(rows):
                yield coded(part, row, voc, logs, end_log, symbol_of, within_of)
                row += part.num_rows

    def coded(part, row, voc, logs, end_log, symbol_of, within_of) -> pa.RecordBatch:
        """Each distinct word of some texts is looked up once."""
        n = part.num_rows
        words, which, stops = distinct_words(part.column(1))
        hashes = signed_hashes(words)
        at = np.searchsorted(voc.words, hashes)
        known = np.zeros(len(words), bool)
        known[at < len(voc.words)] = voc.words[at[at < len(voc.words)]] == hashes[at < len(voc.words)]
        scarce = np.flatnonzero(~known)
        groups = np.zeros(len(words), np.int64)
        groups[scarce] = groups_of(words.take(pa.array(scarce)), m)
        symbols = m.own + 1 + groups
        symbols[known] = symbol_of[at[known]]
        starts = np.concatenate([[0], stops])
        sizes = np.diff(starts)
        texts = np.repeat(np.arange(n), sizes)
        table = np.full(len(which) + n, m.own, np.uint16)
        table[np.arange(len(which)) + texts] = symbols[which]
        ends = np.concatenate([[0], 2 * (stops + np.arange(1, n + 1))]).astype(np.int32)
        # Sums over each text's words, the frequent ones and the rarer.
        often = known[which]
        places, lacking = at[which[often]], voc.group_logs[groups[which[~often]]]
        cuts = np.concatenate([[0], np.cumsum(often)])[starts]
        spans = list(zip(cuts.tolist(), cuts[1:].tolist()))
        found_logs, found_within = logs[places], within_of[places]
        others = (starts - cuts).tolist()
        within = [float(found_within[a:b].sum() - lacking[c:d].sum()) for (a, b), c, d in zip(spans, others, others[1:])]
        # Rarer words of each text, each once.
        of, met = texts[~often], hashes[which[~often]]
        order = np.lexsort((met, of))
        of, met = of[order], met[order]
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (met[1:] != met[:-1])])[: len(of)])
        lists = pa.array(np.searchsorted(of[new], np.arange(n + 1)).astype(np.int32))
        return batch({
            "row": row + np.arange(n), "doc_id": part.column(0), "held_out": part.column(2), "n_tokens": sizes + 1,
            "n_known": np.diff(cuts) + (voc.end_count > 0), "count_logs": [float(found_logs[a:b].sum()) + end_log for a, b in spans], "within": within,
            "symbols": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(table)]),
            "rare": pa.ListArray.from_arrays(lists, pa.array(met[new])),
            "times": pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(new, len(of))).astype(np.int32))),
        }, CODED)

    return map_arrow(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out"), run,
        "row long, doc_id long, held_out boolean, n_tokens long, n_known long, count_logs double, within double, symbols binary, "
        "rare array<long>, times array<int>",
    )


@dataclass
class States:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


def first_states(v: Vocabulary, m: Model) -> States:
    """Sticky states whose emissions differ by fixed pseudo-random factors."""
    rng = np.random.default_rng(m.seed)
    emit = v.shares[:, None] * np.exp(rng.normal(0, 1.0, (m.symbols, m.states)))
    move = np.full((m.states, m.states), 0.1 / max(m.states - 1, 1))
    np.fill_diagonal(move, 0.9 if m.states > 1 else 1.0)
    return States(np.full(m.states, 1 / m.states), move, emit / emit.sum(axis=0))


def of_like_length(lengths: np.ndarray, cells: int = 200_000) -> Iterator[np.ndarray]:
    """Rows in groups whose padded size is about ``cells``, longest first."""
    order, at = np.argsort(-lengths, kind="stable"), 0
    while at < len(order):
        n = max(1, cells // int(lengths[order[at]]))
        yield order[at : at + n]
        at += n


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows, longest first, as columns of a table, and how many of them have a token at each step."""
    lengths = np.array([len(r) for r in rows])
    table = np.zeros((lengths[0], len(rows)), np.int64)
    for i, r in enumerate(rows):
        table[: len(r), i] = r
    return table, len(rows) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")


def scaled(seen: np.ndarray, active: np.ndarray, s: States, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Scales of the scaled recursion over ``seen``, the emissions of a table's symbols; with ``keep`` also the scaled values."""
    steps, n, k = seen.shape
    scales, ones = np.ones((steps, n)), np.ones(k)
    values = np.zeros((steps, n, k)) if keep else None
    for t in range(steps):
        a = active[t]
        if t:
            now = np.matmul(now[:a], s.move, out=values[t, :a] if keep else None)
        else:
            now = values[0] if keep else np.empty((n, k))
            now[:] = s.start
        now *= seen[t, :a]
        now /= np.matmul(now, ones, out=scales[t, :a])[:, None]
    return scales, values


def forward(table: np.ndarray, active: np.ndarray, s: States, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Log likelihood of each row by the scaled recursion; with ``keep`` also the scaled values; and the scales."""
    scales, values = scaled(np.take(s.emit, table, axis=0), active, s, keep)
    return np.log(scales).sum(axis=0), values, scales


def expected(rows: list[np.ndarray], s: States, counts: States) -> float:
    """Add the expected counts of ``rows`` (longest first) to ``counts``; returns their log likelihood."""
    table, active = padded(rows)
    seen = np.take(s.emit, table, axis=0)
    scales, values = scaled(seen, active, s, keep=True)
    steps, n, k = values.shape
    seen /= scales[:, :, None]
    # Rows that end at the step or before have ones.
    back, turned = np.ones((n, k)), np.ascontiguousarray(s.move.T)
    for t in range(steps - 2, -1, -1):
        a = active[t + 1]
        ahead = seen[t + 1, :a]
        ahead *= back[:a]
        counts.move += values[t, :a].T @ ahead
        values[t + 1, :a] *= back[:a]
        np.matmul(ahead, turned, out=back[:a])
    values[0] *= back
    counts.start += values[0].sum(axis=0)
    real = np.arange(n)[None, :] < active[:, None]
    flat, symbols = values[real], table[real]
    for j in range(k):
        counts.emit[:, j] += np.bincount(symbols, flat[:, j], minlength=len(counts.emit))
    return float(np.log(scales).sum())


def symbol_rows(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in column.to_pylist()]


def baum_welch_step(coded: DataFrame, s: States, m: Model) -> tuple[States, float]:
    """Expected counts of all rows of coded(symbols), summed in tasks and then over them; and the log likelihood."""
    model = coded.sparkSession.sparkContext.broadcast(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = model.value
        counts = States(*(np.zeros(x.shape) for x in (states.start, states.move, states.emit)))
        likelihood = 0.0
        for rows in batches:
            found = symbol_rows(rows.column(0))
            for which in of_like_length(np.array([len(x) for x in found], np.int64)) if found else ():
                likelihood += expected([found[i] for i in which], states, counts)
        counts.move *= states.move
        at = np.flatnonzero(counts.emit.any(axis=1))
        first = np.zeros(m.states)
        first[0] = likelihood
        numbers = np.vstack([counts.emit[at], counts.start[None], counts.move, first[None]])
        cells = np.concatenate([at, m.symbols + np.arange(m.states + 2)])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(numbers.astype(np.float32).ravel()), m.states).cast(pa.list_(pa.float32()))
        yield batch({"cell": cells, "v": lists}, {"cell": pa.int64(), "v": pa.list_(pa.float32())})

    parts = map_arrow(coded.select("symbols"), run, "cell long, v array<float>")
    sums = parts.groupBy("cell").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(m.states)]).toPandas()
    model.destroy()
    numbers = np.zeros((m.symbols + m.states + 2, m.states))
    numbers[sums["cell"]] = sums[[f"v{i}" for i in range(m.states)]].to_numpy()
    after = m.symbols
    counts = States(numbers[after], numbers[after + 1 : after + 1 + m.states], numbers[:after])
    return counts, float(numbers[-1, 0])


def maximised(counts: States, v: Vocabulary, m: Model) -> States:
    emit = counts.emit + m.prior * v.shares[:, None]
    move, start = counts.move + m.prior / m.states, counts.start + 1.0
    return States(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(coded: DataFrame, v: Vocabulary, m: Model) -> States:
    """coded(row, symbols) of the training texts, a stored table."""
    states = first_states(v, m)
    kept: States | None = None
    part = F.pmod(F.xxhash64("row"), F.lit(m.parts))
    for i in range(m.parts):
        got, _ = baum_welch_step(coded.where(part == i), states, m)
        rate = 1.0 if kept is None else (i + 1) ** -0.6
        mixed = States(*(m.parts * rate * x for x in (got.start, got.move, got.emit)))
        if kept is not None:
            mixed = States(*(x + (1 - rate) * y for x, y in zip((mixed.start, mixed.move, mixed.emit), (kept.start, kept.move, kept.emit))))
        kept = mixed
        states = maximised(kept, v, m)
    before: float | None = None
    while True:
        got, now = baum_welch_step(coded, states, m)
        states = maximised(got, v, m)
        if before is not None and now - before <= m.settled * abs(before):
            return states
        before = now


def likelihoods(coded: DataFrame, states: States) -> DataFrame:
    """(row, log10) of each row of coded(row, symbols)."""
    model = coded.sparkSession.sparkContext.broadcast(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = symbol_rows(rows.column(1))
            out = np.zeros(len(found))
            for which in of_like_length(np.array([len(x) for x in found], np.int64)) if found else ():
                table, active = padded([found[i] for i in which])
                out[which] = forward(table, active, model.value, keep=False)[0]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out / np.log(10))], names=["row", "log10"])

    return map_arrow(coded.select("row", "symbols"), run, "row long, log10 double")


def score(docs: DataFrame, m: Model = Model()) -> DataFrame:
    """Train on the rows of docs(doc_id, text) that are not held out, and score every row."""
    flagged = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"))
    counts = stored(count_words(flagged.where("not held_out"), m))
    v = vocabulary(counts, m)
    coded = stored(encode(flagged, v, m))
    states = train(coded.where("not held_out").select("row", "symbols"), v, m)
    rare = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).cast("long").alias("rare_known"),
    )
    zero = F.coalesce("rare_logs", F.lit(0.0))
    return (
        coded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "count_logs", "within")
        .join(likelihoods(coded, states), "row").join(met, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(v.tokens).cast("long").alias("train_tokens"),
            (F.col("count_logs") + zero - F.col("n_tokens") * F.lit(v.base_log)).alias("base_score"),
            (F.col("log10") + F.col("within") + zero).alias("score"),
        )
    )
