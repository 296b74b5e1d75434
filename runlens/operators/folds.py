"""Reproducible stratified folds and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.ordering import hash_bucket, hash_order, ordered_index


def safe_fold_count(df: DataFrame, label: str, k: int = 5) -> int:
    """At most ``k`` folds, fewer when the smallest class is smaller, never below two."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0]
    return max(2, min(k, int(least or 2)))


def assign_folds(df: DataFrame, label: str, k: int = 5, seed: int = 0, key: str = "run_id") -> DataFrame:
    """Add ``fold`` in 0..k-1: rows of each label dealt out in hash order.

    Only a handful of labels exist, so ranks are taken per (label, hash prefix) and shifted; a label
    is never ordered in one task. ``df`` should be a stored table (it is read twice).
    """
    h = hash_order(F.col(key), F.lit(seed))
    tagged = df.withColumn("_h", h)
    ranked = ordered_index(tagged, [label], [F.col("_h"), F.col(key)], hash_bucket(F.col("_h")), out="_rank")
    return ranked.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_h", "_rank")


#: Groups with more than this part of a fold's share of the rows are dealt one by one, the others by rank.
LARGE = 64


def group_folds(df: DataFrame, group: str, label: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Add ``fold`` in 0..k-1 so that no group lies in two folds and labels are spread as evenly as whole groups allow.

    The few groups that could unbalance a fold (at most ``LARGE`` * k of them, whatever the table's size) are dealt greedily by their
    label counts, largest first. All others are ranked by size within their main label and dealt back and forth. Rows without
    a group are one group. ``df`` should be a stored table (it is read three times).
    """
    name = F.struct(F.col(group).alias("g"))
    counts = df.groupBy(name.alias("_g"), F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("_g").agg(
        F.sum("n").alias("n"), F.max_by("_y", F.struct(F.col("n"), F.coalesce("_y", F.lit("")).alias("y"))).alias("_main"),
        F.map_from_entries(F.collect_list(F.struct(F.coalesce("_y", F.lit("")), F.col("n")))).alias("labels"),
    )
    total = df.count()
    limit = max(1.0, total / (k * LARGE))
    large = sorted(groups.where(F.col("n") > limit).collect(), key=lambda r: (-r["n"], str(r["_g"])))
    target: dict[str, float] = {}
    for r in counts.groupBy("_y").agg(F.sum("n").alias("n")).collect():
        target[r["_y"] or ""] = r["n"] / k
    held: list[dict[str, float]] = [dict.fromkeys(target, 0.0) for _ in range(k)]
    dealt: dict[int, list] = {i: [] for i in range(k)}
    for r in large:
        def cost(i: int, r=r) -> tuple:
            over = sum((held[i][y] + n - target[y]) ** 2 - (held[i][y] - target[y]) ** 2 for y, n in r["labels"].items())
            return over, sum(held[i].values()), i

        best = min(range(k), key=cost)
        for y, n in r["labels"].items():
            held[best][y] += n
        dealt[best].append(r["_g"]["g"])
    h = hash_order(F.col("_g"), F.lit(seed))
    small = groups.where(F.col("n") <= limit).select("_g", "_main", (-F.col("n")).alias("_size"), h.alias("_h"))
    # Folds that large groups have filled get their turn later, by the same walk.
    spot = ordered_index(small, ["_main"], [F.col("_size"), F.col("_h"), F.col("_g")], F.struct("_size", hash_bucket(F.col("_h"))), out="_rank")
    turn = F.pmod(F.col("_rank"), F.lit(2 * k))
    folds = spot.select("_g", F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int").alias("_fold"))
    fixed = F.lit(None).cast("int")
    for i, names in dealt.items():
        known = [x for x in names if x is not None]
        if known:
            fixed = F.when(F.col(group).isin(known), i).otherwise(fixed)
        if len(known) < len(names):
            fixed = F.when(F.col(group).isNull(), i).otherwise(fixed)
    out = df.withColumn("_g", name).join(folds, "_g", "left")
    return out.withColumn("fold", F.coalesce("_fold", fixed)).drop("_g", "_fold")


def group_holdout(df: DataFrame, group: str, label: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): whole groups, about a fifth of the rows in the test set."""
    f = group_folds(df, group, label, 5, seed)
    return f.where("fold <> 0").drop("fold"), f.where("fold = 0").drop("fold")


def holdout(df: DataFrame, label: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, test): the first of five folds is the test set."""
    f = assign_folds(df, label, 5, seed)
    return f.where("fold <> 0").drop("fold"), f.where("fold = 0").drop("fold")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add the balanced weight n / (classes * n_class); the per-class table has one row per label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    w = counts.withColumn("_t", totals).select(label, (F.col("_t.n") / (F.col("_t.k") * F.col("_n"))).alias(out))
    return df.join(w, label, "left")


def leaked(train: DataFrame, test: DataFrame, key: str = "run_id") -> DataFrame:
    """Keys that appear on both sides (must be empty)."""
    return train.select(key).intersect(test.select(key))
