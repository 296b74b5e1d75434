"""Sharding by sampled splitters, with DataFrame functions only.

Records get a range key (the text's crc32, so that equal texts lie side by side, then the id). A sample in which each record
has weight in proportion to its size gives splitters at its quantiles; records go to the ranges between them. Ranges that turn out
overfull are split again by splitters drawn from their own records; a third part of the key, the row's number, makes any
range divisible, even one of equal rows. Exact byte and row counts of the ranges then become offsets, so each record knows how
many bytes come before it in key order, and shard i takes the records whose middle lies in the i-th equal share of all bytes.

What is gathered: the sample (about ``sample`` rows), one row for each range (about ``ranges``, and one for each
``range_rows`` rows), one row for each shard. Windows run inside one range.

Defined results: null text has no bytes and the crc32 of nothing, 0. Null ids sort first. Repeated rows are told apart by their row
number in a stored table, so all keep places of their own. Extra columns of the input are ignored. No rows in, no rows out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.llm.common import stored


@dataclass(frozen=True)
class Sharding:
    shards: int = 40
    #: Bytes that a record counts for besides its text.
    overhead: int = 16
    sample: int = 16_384
    ranges: int = 1_024
    #: A range is overfull above this many rows or above ``overfull`` times its share of rows.
    range_rows: int = 2_000_000
    overfull: float = 2.0


KEY = ("text_crc32", "doc_id", "row")


def key(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}") for c in KEY])


def records(docs: DataFrame, s: Sharding) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + s.overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )


def unit(*cols) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def weighted_sample(rows: DataFrame, weight: Column, share: Column) -> DataFrame:
    """Rows with ``draws``, on average weight * share; at least one draw each."""
    expected = weight.cast("double") * share
    draws = F.floor(expected + unit("text_crc32", "doc_id", "row", F.lit(17)))
    return rows.withColumn("draws", draws.cast("long")).where("draws > 0")


def find_place(cuts: Column, item: Column, most: int) -> Column:
    """How many entries of the sorted array ``cuts`` are at most ``item``, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, most).bit_length()))])
    return F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when((at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= item), at + step).otherwise(at),
    )


def splitters(sample: DataFrame, keys: list[str], parts: Column) -> DataFrame:
    """For each of ``keys``: the sample's keys at ``parts - 1`` equal steps of its draws, as the sorted array ``cuts``."""
    upto = W.partitionBy(*keys).orderBy(*KEY)
    total = W.partitionBy(*keys)
    step = F.floor(F.sum("draws").over(upto.rowsBetween(W.unboundedPreceding, 0)) * parts / F.sum("draws").over(total))
    before = F.coalesce(F.lag("_step").over(upto), F.lit(0))
    marked = sample.withColumn("_step", step).withColumn("_cut", (F.col("_step") > before) & (F.col("_step") < parts))
    return marked.where("_cut").groupBy(*keys).agg(F.array_sort(F.collect_list(key())).alias("cuts"))


def in_ranges(rows: DataFrame, s: Sharding) -> DataFrame:
    """Rows with ``range`` and ``part``; (range, part) increases with the key."""
    whole = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    totals = whole.select(F.struct("bytes", "n").alias("t"))
    share = F.lit(float(s.sample)) / totals.scalar()["bytes"]
    cuts = splitters(weighted_sample(rows, F.col("size"), share).withColumn("all", F.lit(1)), ["all"], F.lit(s.ranges)).select("cuts")
    placed = rows.withColumn("cuts", cuts.scalar()).withColumn("range", find_place(F.col("cuts"), key(), s.ranges))
    first = stored(placed.drop("cuts"))
    # Overfull ranges are few: each holds more than the limit.
    limit = F.least(F.lit(float(s.range_rows)), F.greatest(F.lit(1.0), s.overfull * totals.scalar()["n"] / F.lit(float(s.ranges))))
    counts = first.groupBy("range").agg(F.count("*").alias("rows"))
    over = counts.where(F.col("rows") > limit).select("range", F.ceil(F.col("rows") / limit).cast("int").alias("parts"), "rows")
    inside = first.join(F.broadcast(over), "range")
    again = weighted_sample(inside, F.lit(1), F.least(F.lit(1.0), F.lit(64.0) * F.col("parts") / F.col("rows")))
    finer = splitters(again, ["range", "parts"], F.col("parts")).select("range", F.col("cuts").alias("finer"))
    most = s.ranges * 64
    return first.join(F.broadcast(finer), "range", "left").withColumn(
        "part", F.when(F.col("finer").isNull(), F.lit(0)).otherwise(find_place(F.col("finer"), key(), most))
    ).drop("finer")


def shard(docs: DataFrame, s: Sharding = Sharding()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs(doc_id, text)."""
    placed = stored(in_ranges(stored(records(docs, s)), s))
    sums = placed.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    earlier = W.orderBy("range", "part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        "range", "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
    )
    total = placed.agg(F.sum("size").alias("bytes"))
    inside = W.partitionBy("range", "part").orderBy(*KEY)
    at = F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2
    ranked = (
        placed.join(offsets, ["range", "part"])
        .withColumn("place", F.row_number().over(inside) - 1 + F.col("rows_before"))
        .withColumn("shard", F.least(F.lit(s.shards - 1), F.floor(at * s.shards / total.scalar()).cast("int")))
    )
    firsts = ranked.groupBy("shard").agg(F.min("place").alias("first"))
    return ranked.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard"),
        (F.col("place") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
