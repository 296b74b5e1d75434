"""Near-duplicate detection by b-bit MinHash.

1. Each text becomes its set of distinct word shingles (64-bit hashes). Texts with equal sets form a class at once, and only one
   of each class goes on, so thousands of exact copies cost one row.
2. ``bands * rows`` minima are taken for each class. A band's minima are hashed to a key; the lowest ``bits`` bits of all minima
   are packed into a signature of a few longs.
3. Candidates come from equal band keys, but never as all pairs of a bucket: a bucket's members are compared with a
   pivot, the one that meets most others. Members that it does not bring into one component ("outsiders") are the pivots of the
   next rounds, until each pair of a bucket was compared, lies in one component or cannot be similar enough. For the last,
   shingles that only one text of the crowded buckets has are counted: they are in nobody's intersection.
4. Packed signatures are compared bit by bit. The share of equal minima, corrected for chance collisions of low bits,
   estimates the similarity; pairs five standard deviations under the limit are dropped.
   Of each set, the parities of its shingles' numbers in ``cells`` hashed cells are kept too. Two sets differ in at least as many
   shingles as cells, so pairs with too many unlike parities are no links, without exception, and only near links meet their sets.
5. The rest is confirmed on the full sets, and confirmed links are joined to components.

A link at exactly the limit of 0.8 shares no band with probability 0.59**28 = 4e-7, and is below the estimate's margin with
about 3e-7. Shingles and sets are known by 64-bit hashes, whose collisions are not looked for. Nothing is capped.

Defined results: null and empty texts, and texts of white space, have the empty set, are linked with nothing and are components
of their own. A vertex is a set, not an id: a row without doc_id takes part like any other, and rows that repeat a doc_id go
by their own texts. A component's id is the smallest doc_id in it (null if it has none). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import WordHashes, as_bytes, batch, few_rows, map_arrow, mix64, shingles, signed, sql_schema, stored
from runlens.llm.components import connected_components


@dataclass(frozen=True)
class NearDup:
    words: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 4
    bits: int = 4
    #: Standard deviations of the estimate below the limit at which a candidate is dropped.
    margin: float = 5.0
    #: Parities kept of each set, 64 to a long.
    cells: int = 1024
    seed: int = 11
    #: The bitmap that tells tasks which texts to look at again has 2**filter_bits bits (8 MB).
    filter_bits: int = 26
    #: Buckets with more outsiders than this are first cleared of texts that cannot have a partner.
    few: int = 4
    #: Outsiders of such buckets are first compared with so many central members.
    probes: int = 8

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def longs(self) -> int:
        return -(-self.minima * self.bits // 64)

    @property
    def least_estimate(self) -> float:
        j, chance = self.percent / 100, 2.0**-self.bits
        p = j + (1 - j) * chance
        return j - self.margin * np.sqrt(p * (1 - p) / self.minima) / (1 - chance)


def shingle_set(text: bytes, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer than ``n`` words has its whole sequence as the only one."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(shingles(h, min(n, len(words))) + np.uint64(min(n, len(words))))


def set_id(items: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(items.tobytes())[:8], "little", signed=True)


def min_values(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 1024):
        np.minimum(best, (items[at : at + 1024, None] * a + b).min(axis=0), out=best)
    return best


def pack(low: np.ndarray, bits: int, longs: int) -> np.ndarray:
    """Low bits of the minima, ``64 // bits`` to a long."""
    each = 64 // bits
    padded = np.zeros(longs * each, np.uint64)
    padded[: len(low)] = low
    shifts = (np.arange(each, dtype=np.uint64) * np.uint64(bits))[None, :]
    return np.bitwise_or.reduce(padded.reshape(longs, each) << shifts, axis=1)


def parities(items: np.ndarray, cells: int) -> np.ndarray:
    """One bit for each hashed cell: whether an odd number of the items lies in it."""
    odd = np.bincount((items % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, s: NearDup, key: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, id, bands, packed, parity, row) for every row; id, a hash of the set, is null for the empty set; row is the ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(s.seed)
        a = rng.integers(0, 2**63, s.minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**64, s.minima, dtype=np.uint64, endpoint=False)
        order = np.arange(s.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        hashes = WordHashes()
        for rows in few_rows(batches):
            counts, ids, keys, packed, parity = [], [], [], [], []
            for text in as_bytes(rows.column(1)):
                items = shingle_set(text, s.words, hashes)
                counts.append(len(items))
                if not len(items):
                    ids.append(None), keys.append(None), packed.append(None), parity.append(None)
                    continue
                ids.append(set_id(items))
                parity.append(parities(items, s.cells))
                least = min_values(items, a, b)
                key = order.copy()
                for column in least.reshape(s.bands, s.rows).T:
                    key = mix64(key ^ column)
                keys.append(signed(key))
                packed.append(signed(pack(mix64(least) & np.uint64((1 << s.bits) - 1), s.bits, s.longs)))
            types = {
                "doc_id": pa.int64(), "n_shingles": pa.int64(), "id": pa.int64(), "bands": pa.list_(pa.int64()), "packed": pa.list_(pa.int64()),
                "parity": pa.list_(pa.int64()), "row": pa.int64(),
            }
            values = {"doc_id": rows.column(0), "n_shingles": counts, "id": ids, "bands": keys, "packed": packed, "parity": parity}
            yield batch(values | {"row": rows.column(2)}, types)

    row = (F.lit(None) if key is None else F.col(key)).cast("long").alias("row")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row)
    return map_arrow(narrow, run, "doc_id long, n_shingles long, id long, bands array<long>, packed array<long>, parity array<long>, row long")


def estimate(left: Column, right: Column, s: NearDup) -> Column:
    """Collision-corrected similarity from two packed signatures, by counting equal groups of ``bits`` bits."""
    ones = sum(1 << (s.bits * i) for i in range(64 // s.bits))
    ones = ones - 2**64 if ones >= 2**63 else ones
    differing = F.lit(0)
    for i in range(s.longs):
        x = F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))
        y = x
        for k in range(1, s.bits):
            y = y.bitwiseOR(F.shiftrightunsigned(x, k))
        differing = differing + F.bit_count(y.bitwiseAND(F.lit(ones)))
    chance = 2.0**-s.bits
    return ((1 - differing / F.lit(float(s.minima))) - chance) / (1 - chance)


def _may_be_near(left: Column, right: Column, n: Column, m: Column, s: NearDup) -> Column:
    """Whether sets of sizes n and m with these parities can be similar enough: they differ wherever parities do."""
    unlike = sum((F.bit_count(F.get(left, F.lit(i)).bitwiseXOR(F.get(right, F.lit(i)))) for i in range(s.cells // 64)), F.lit(0))
    return (100 + s.percent) * unlike <= (100 - s.percent) * (n + m)


def _place(value: Column, s: NearDup) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(1 << s.filter_bits))


def _bitmap(values: DataFrame, s: NearDup) -> Broadcast:
    """A bitmap of the places of the only column of ``values``, nulls left out; of a fixed size, however many there are."""
    place = _place(F.col(values.columns[0]), s)
    words = values.where(F.col(values.columns[0]).isNotNull()).groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")
    )
    got = words.toArrow()
    bitmap = np.zeros(1 << (s.filter_bits - 6), np.int64)
    bitmap[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return values.sparkSession.sparkContext.broadcast(bitmap)


def _marked(places: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 6] >> (places & 63)) & 1 == 1


def _those(classes: DataFrame, ids: DataFrame, s: NearDup) -> DataFrame:
    """The classes in ids(id), and some more whose ids share a place with theirs; a stored table.

    Rounds look at few classes, and joins of them with all would shuffle all signatures in every round. Here they stay where they
    are: tasks get a bitmap of the ids. A full one lets all pass, which costs time and loses nothing.
    """
    shared = _bitmap(ids.select("id"), s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = _marked(rows.column(rows.num_columns - 1).to_numpy(), shared.value)
            yield rows.select(range(rows.num_columns - 1)).filter(pa.array(keep))

    out = stored(map_arrow(classes.withColumn("place", _place(F.col("id"), s)), run, sql_schema(classes)))
    shared.destroy()
    return out


def _sets(docs: DataFrame, ids: DataFrame, s: NearDup) -> DataFrame:
    """(id, items) with the sorted shingles of the classes in ids(id, doc_id), from one of each class's texts; a stored table.

    Texts are not shuffled: tasks get a bitmap of hashed doc_ids, of a fixed size, and make sets for the texts that it lets
    pass. Only these sets are joined with the ids. A full bitmap lets all pass, which costs time and loses nothing.
    """
    shared = _bitmap(ids.select("doc_id"), s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for rows in few_rows(batches):
            at = rows.column(0).to_numpy()
            # Rows without doc_id may belong to any class.
            some = _marked(at, shared.value) | np.array(rows.column(1).to_pylist(), bool)
            own, items = [], []
            for text in as_bytes(rows.column(2).filter(pa.array(some))):
                found = shingle_set(text, s.words, hashes)
                if len(found):
                    own.append(set_id(found)), items.append(found.tobytes())
            yield batch({"id": own, "items": items}, {"id": pa.int64(), "items": pa.binary()})

    marked = docs.select(_place(F.col("doc_id"), s).alias("place"), F.col("doc_id").isNull().alias("nameless"), "text")
    found = map_arrow(marked, run, "id long, items binary").join(ids.select("id"), "id", "left_semi")
    out = stored(found.groupBy("id").agg(F.first("items").alias("items")))
    shared.destroy()  # the sets are written, and every round brings a bitmap of its own
    return out


def _likely(pairs: DataFrame, classes: DataFrame, s: NearDup) -> DataFrame:
    """Those of pairs(a, b) that sizes, signatures and parities do not rule out."""
    side = classes.select("id", "n_shingles", "packed", "parity")
    return (
        pairs.join(side.toDF("a", "n_a", "p_a", "x_a"), "a").join(side.toDF("b", "n_b", "p_b", "x_b"), "b")
        .where(100 * F.least("n_a", "n_b") >= s.percent * F.greatest("n_a", "n_b"))
        .where(_may_be_near(F.col("x_a"), F.col("x_b"), F.col("n_a"), F.col("n_b"), s))
        .where(estimate(F.col("p_a"), F.col("p_b"), s) >= s.least_estimate)
        .select("a", "b")
    )


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, s: NearDup) -> DataFrame:
    """Those of likely pairs(a, b) whose full sets are similar enough."""
    likely = stored(pairs)
    wanted = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    sets = _sets(docs, classes.select("id", "doc_id").join(wanted, "id", "left_semi"), s)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in few_rows(batches):
            keep = []
            for x, y in zip(rows.column(2), rows.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= s.percent * (len(x) + len(y) - common))
            chosen = rows.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], names=["a", "b"])

    met = likely.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return stored(map_arrow(met, compare, "a long, b long"))


FIRST_FAN = 64


def _may_link(common: Column, n: Column, m: Column, s: NearDup) -> Column:
    """Whether sets of sizes n and m with at most ``common`` shingles in common can be similar enough."""
    return 100 * common >= s.percent * (n + m - common)


def _without_loners(placed: DataFrame, classes: DataFrame, docs: DataFrame, s: NearDup) -> DataFrame:
    """Mark as done, in buckets of many outsiders, those that cannot be linked with any member.

    ``most`` becomes the number of an id's shingles that occur in another text of such buckets too: it can have no more in
    common with anyone. Of edited copies, those with many edits of their own fall out here, one by one, not pair by pair.
    """
    ids = placed.where(F.col("waiting") > s.few).select("id").distinct()
    sets = _sets(docs, classes.select("id", "doc_id").join(ids, "id", "left_semi"), s)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i, data in zip(rows.column(0).to_pylist(), rows.column(1)):
                items = np.frombuffer(data.as_py(), np.int64)
                yield batch({"id": np.full(len(items), i), "item": items}, {"id": pa.int64(), "item": pa.int64()})

    items = map_arrow(sets, spread, "id long, item long")
    lone = items.groupBy("item").agg(F.count("*").alias("n"), F.first("id").alias("id")).where("n = 1")
    alone = lone.groupBy("id").agg(F.count("*").alias("alone"))
    least = placed.groupBy("key").agg(F.min("n_shingles").alias("least"))
    known = placed.join(alone, "id", "left").withColumn(
        "most", F.when(F.col("waiting") > s.few, F.col("n_shingles") - F.coalesce("alone", F.lit(0))).otherwise(F.col("most"))
    )
    smallest = F.greatest(F.col("least").cast("double"), F.col("n_shingles") * (s.percent / 100))
    hopeless = ~_may_link(F.col("most"), F.col("n_shingles"), smallest, s)
    marked = known.join(least, "key").withColumn("used", F.col("used") | hopeless)
    # Whether outsiders are left is counted anew.
    left = F.count_if(_outside()).alias("waiting")
    still = marked.groupBy("key").agg(left).where("waiting > 0")
    return marked.drop("waiting", "alone", "least").join(still, "key")


STATE = ("key", "id", "first", "used", "n_shingles", "most", "weight")


def _outside() -> Column:
    """Members still to be compared with the others: not pivots yet, and not in the component of the bucket's first pivot."""
    return ~F.col("used") & (F.col("part") != F.col("main"))


def _placed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows of buckets that still have outsiders, with components and the number waiting; a stored table."""
    label = parts.toDF("id", "component")
    placed = (
        rows.select(*STATE).join(label, "id", "left").join(label.toDF("first", "first_component"), "first", "left")
        .select(*STATE, F.coalesce("component", "id").alias("part"), F.coalesce("first_component", "first").alias("main"))
    )
    still = placed.groupBy("key").agg(F.count_if(_outside()).alias("waiting")).where("waiting > 0")
    return stored(placed.join(still, "key"))


def _one_of_each(rows: DataFrame, salt: Column, order: str) -> DataFrame:
    """(key, p_id, p_part, p_n, p_most): from each bucket and salt the row of the highest ``order``."""
    best = F.max(F.struct(order, "id", "part", "n_shingles", "most")).alias("p")
    return rows.groupBy("key", salt.alias("salt")).agg(best).select(
        "key", F.col("p.id").alias("p_id"), F.col("p.part").alias("p_part"), F.col("p.n_shingles").alias("p_n"), F.col("p.most").alias("p_most")
    )


def _pairs(rows: DataFrame, pivots: DataFrame, classes: DataFrame, s: NearDup) -> DataFrame:
    """Distinct (a, b) of rows and pivots that meet in a bucket, are in different components and are likely.

    A pair that meets in many buckets comes from the first of them only. Parities and signatures are compared where a pair meets, so
    that no row is made of one that they rule out.
    """
    side = classes.select("id", "bands", "packed", "parity")
    with_bands = rows.join(side, "id")
    pivots = pivots.join(side.toDF("p_id", "p_bands", "p_packed", "p_parity"), "p_id")
    met = with_bands.join(pivots, "key").where("id <> p_id and part <> p_part and id <> first and p_id <> first").where(
        _may_link(F.least("most", "p_most"), F.col("n_shingles"), F.col("p_n"), s)
    ).where(
        _may_be_near(F.col("parity"), F.col("p_parity"), F.col("n_shingles"), F.col("p_n"), s)
    ).where(
        estimate(F.col("packed"), F.col("p_packed"), s) >= s.least_estimate
    ).where(F.array_min(F.array_intersect("bands", "p_bands")) == F.col("key"))
    return met.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct()


def _joined(parts: DataFrame, found: DataFrame) -> DataFrame:
    """The components with new links, which join whole components; so only these are looked at."""
    if found.isEmpty():
        return parts
    of = parts.toDF("id", "c")
    ends = found.join(of.toDF("a", "x"), "a", "left").join(of.toDF("b", "y"), "b", "left")
    merged = connected_components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    named = merged.toDF("c", "whole")
    moved = of.join(named, "c", "left").select("id", F.coalesce("whole", "c").alias("component"))
    alone = named.select(F.col("c").alias("id"), F.col("whole").alias("component")).join(of, "id", "left_anti")
    return stored(moved.union(alone))


def near_duplicates(docs: DataFrame, s: NearDup = NearDup(), key: str | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    With ``key``, a stored column that tells rows apart, the result has that column too, and ``kept`` holds for exactly one row of each
    component: the smallest doc_id, then the smallest key; rows without doc_id come last.
    """
    rows = stored(signatures(docs, s, key))
    # All rows of a class have the same bands and signature, so any of them will do.
    classes = stored(
        rows.where("id is not null").groupBy("id").agg(
            F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n_shingles", "packed", "parity", "bands")]
        )
    )
    buckets = classes.select("id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(buckets.join(shared, "key").select("key", "id", "n"))
    # The pivot is the member that meets most others in all its buckets: of edited copies, the least edited one.
    weights = members.groupBy("id").agg(F.sum("n").alias("weight"))
    members = members.join(weights, "id")
    pivots = members.groupBy("key").agg(F.max(F.struct("weight", "id")).alias("p")).select("key", F.col("p.id").alias("first"))
    members = stored(members.join(pivots, "key"))
    pairs = members.where("id <> first").select(F.least("first", "id").alias("a"), F.greatest("first", "id").alias("b")).distinct()
    parts = stored(connected_components(_confirmed(_likely(pairs, classes, s), classes, docs, s)))

    begun = (
        members.where("n > 2").join(classes.select("id", "n_shingles"), "id")
        .withColumns({"used": F.col("id") == F.col("first"), "most": F.col("n_shingles")})
    )
    state = _placed(begun, parts)
    if not state.isEmpty():
        # Later rounds look at members that wait now, and at no others.
        classes = _those(classes, state, s)
        # Crowded buckets: drop who can have no partner, then compare outsiders with a few more central members.
        state = stored(_without_loners(state, classes, docs, s))
        crowded = state.where(F.col("waiting") > s.few)
        probes = _one_of_each(crowded, F.pmod(F.xxhash64("id"), F.lit(s.probes)), "weight")
        pairs = _pairs(crowded.where(_outside()), probes, classes, s)
        parts = _joined(parts, _confirmed(pairs, classes, docs, s))
    fan = FIRST_FAN
    while True:
        state = _placed(state, parts)
        if state.isEmpty():
            break
        # All outsiders of a bucket are pivots at once where they are few; else one for each of ``fan`` hash values.
        salt = F.when(F.col("waiting") <= fan, F.col("id")).otherwise(F.pmod(F.xxhash64("id"), F.lit(fan)))
        pivots = _one_of_each(state.where(_outside()), salt, "weight")
        parts = _joined(parts, _confirmed(_pairs(state, pivots, classes, s), classes, docs, s))
        done = pivots.select("key", F.col("p_id").alias("id"), F.lit(True).alias("_now"))
        state = state.join(done, ["key", "id"], "left").withColumn("used", F.col("used") | F.coalesce("_now", F.lit(False)))
        fan *= 4

    label = parts.toDF("id", "part")
    found = stored(
        rows.select("doc_id", "n_shingles", "id", "row").join(label, "id", "left")
        .select("doc_id", "n_shingles", F.coalesce("part", "id").alias("part"), "row")
    )
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    smallest = found.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("component_id"), first)
    named = found.join(smallest, "part", "left")
    mine = F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    verdicts = named.select("doc_id", "n_shingles", mine.alias("component_id"), "row", "part", F.col("first.row").alias("first"))
    if key is None:
        return verdicts.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return verdicts.select(
        F.col("row").alias(key), "doc_id", "n_shingles", "component_id", (F.col("part").isNull() | (F.col("row") == F.col("first"))).alias("kept")
    )
