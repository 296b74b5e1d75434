"""Isotonic regression as a mergeable computation: sorted ranges are pooled in their tasks, then neighbouring ranges are merged.

Pool-adjacent-violators can be applied to any range of sorted points, and to the blocks of neighbouring ranges again: the result is
that of the whole. So points (key, x, sum of y, weight) are dealt to ranges of x, each range becomes blocks of rising means in one
pass with a stack, and rounds merge ``FAN_IN`` neighbouring ranges until one is left for each key. A range keeps
its blocks only, which is what the fitted curve needs anyway; no task sorts or holds all points.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.session import cut_lineage, ship_package

FAN_IN = 8
BLOCKS_SQL = "key long, part long, lo double, hi double, total double, weight double"
_NAMES = ("key", "part", "lo", "hi", "total", "weight")


def push(stack: list[tuple], lo: float, hi: float, total: float, weight: float) -> None:
    """Add the next block of one key in order of x, pooled with earlier ones until the means of the stack rise strictly."""
    while stack and stack[-1][2] * weight >= total * stack[-1][3]:
        first, _, t, w = stack.pop()
        lo, total, weight = first, t + total, w + weight
    stack.append((lo, hi, total, weight))


def _pooled(df: DataFrame, part: Column | None) -> DataFrame:
    """Pool each run of equal (key, part) of a frame whose partitions are sorted by (key, x)."""

    # Tasks get a flag: a column can't be sent to them.
    by_task = part is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = TaskContext.get().partitionId() if by_task else None
        group, stack = None, []

        def done() -> pa.RecordBatch:
            rows = [(group[0], group[1], *b) for b in stack]
            return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=_NAMES), preserve_index=False)

        for b in batches:
            key, where, *cells = (b.column(i).to_pylist() for i in range(6))
            for k, w, lo, hi, total, weight in zip(key, where, *cells):
                now = (k, own if by_task else w)
                if now != group:
                    if stack:
                        yield done()
                    group, stack = now, []
                push(stack, lo, hi, total, weight)
        if stack:
            yield done()

    ship_package(df.sparkSession)
    return df.withColumn("part", F.lit(0).cast("long") if part is None else part).select(*_NAMES).mapInArrow(run, BLOCKS_SQL)


def fit_blocks(points: DataFrame) -> DataFrame:
    """(key, lo, hi, value, weight): the blocks of the isotonic fit of each key.

    points: key LONG, x DOUBLE, y DOUBLE (unweighted rows). Rows with a null or NaN x or a null y are left out; infinite x are values like
    any other; equal x are one point.
    """
    known = points.where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull())
    merged = known.groupBy("key", "x").agg(F.sum("y").alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))
    ranges = merged.select("key", F.col("x").alias("lo"), F.col("x").alias("hi"), "total", "weight").repartitionByRange("key", "lo")
    blocks = cut_lineage(_pooled(ranges.sortWithinPartitions("key", "lo"), None))
    # Range partitions are numbered in order, so a key's parts are neighbours; their numbers are few.
    most = blocks.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    while most > 0:
        part = F.floor(F.col("part") / FAN_IN).cast("long")
        dealt = blocks.withColumn("_to", part).repartition("key", "_to").sortWithinPartitions("key", "_to", "lo").drop("_to")
        blocks = cut_lineage(_pooled(dealt, part))
        most //= FAN_IN
    return blocks.select("key", "lo", "hi", (F.col("total") / F.col("weight")).alias("value"), "weight")


def fitted_values(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """``points`` with ``fitted``, the value of the block that their x lies in (null for points that were left out).

    Starts of blocks and points become one sorted column per key, and the last start before a point is carried forward. Some starts cut
    a key into segments, so that a key is no single window.
    """
    starts = blocks.select("key", F.col("lo").alias("x"), F.lit(0).alias("kind"), F.col("value").alias("fitted"))
    distinct = points.where(F.col("x").isNotNull() & ~F.isnan("x")).select("key", "x").distinct()
    both = starts.unionByName(distinct.withColumns({"kind": F.lit(1), "fitted": F.lit(None).cast("double")}))
    cuts = blocks.groupBy("key").agg(F.percentile_approx("lo", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(10_000)).alias("cuts"))
    placed = both.join(cuts, "key", "left").withColumn("seg", F.size(F.filter("cuts", lambda c: c <= F.col("x")))).drop("cuts")
    # A segment begins with its cut, which is a start, so nothing has to be carried into it.
    order = W.partitionBy("key", "seg").orderBy("x", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = placed.withColumn("fitted", F.last("fitted", ignorenulls=True).over(order)).where("kind = 1").select("key", "x", "fitted")
    return points.join(carried, ["key", "x"], "left")
