"""Features per experiment entry (a group of runs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.numeric import finite
from runlens.functions.ordering import exact_quantiles
from runlens.operators.cleaning import long_features

AGGREGATES = ("mean", "std", "min", "max", "ptp")
STABILITY_COLUMNS = (
    "val_loss_final", "val_loss_min", "val_acc_final", "val_acc_max", "train_acc_final", "acc_final_gap",
    "loss_final_gap", "val_loss_argmin_frac",
)


def group_key(runs: DataFrame, meta_keys: tuple[str, ...] = ("meta_entry_id", "meta_config_id", "meta_group_id")) -> DataFrame:
    """Replace entry_id: manifest value, else a metadata value, else a group of its own."""
    have = [F.col(c) for c in ("entry_id", *meta_keys) if c in runs.columns]
    solo = F.concat(F.lit("__solo__:"), F.col("run_id"))
    return runs.withColumn("entry_id", F.coalesce(*have, solo))


def group_aggregates(table: DataFrame, columns: list[str]) -> DataFrame:
    """n_runs and mean/std/min/max/range of the finite values of each column, per entry (map-side combined)."""
    aggs = [F.count(F.lit(1)).alias("n_runs")]
    for c in columns:
        x = finite(F.col(c).cast("double"))
        aggs += [
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_pop(x).alias(f"{c}__std"),
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
            (F.max(x) - F.min(x)).alias(f"{c}__ptp"),
        ]
    return table.groupBy("entry_id").agg(*aggs)


def group_stability(table: DataFrame, columns: list[str] | tuple[str, ...] = STABILITY_COLUMNS) -> DataFrame:
    """Population variance, interquartile range and range per entry and column."""
    long = long_features(table, list(columns), ["entry_id"])
    spread = long.groupBy("entry_id", "feature").agg(
        F.var_pop("x").alias("var"), (F.max("x") - F.min("x")).alias("range")
    )
    quart = exact_quantiles(long, ["entry_id", "feature"], "x", {"q25": 0.25, "q75": 0.75})
    j = spread.join(quart, ["entry_id", "feature"])
    per = {"var": F.col("var"), "iqr": F.col("q75") - F.col("q25"), "range": F.col("range")}
    return j.groupBy("entry_id").agg(
        *[F.max(F.when(F.col("feature") == c, e)).alias(f"stab_{c}_{s}") for c in columns for s, e in per.items()]
    )


def group_labels(runs: DataFrame, order: str = "ord") -> DataFrame:
    """Majority label (ties go to the label seen first) and number of distinct labels per entry."""
    counts = runs.where("primary_label is not null").groupBy("entry_id", "primary_label").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first")
    )
    return counts.groupBy("entry_id").agg(
        F.max_by("primary_label", F.struct(F.col("n"), (-F.col("first")).alias("f"))).alias("group_label"),
        F.count(F.lit(1)).alias("n_unique_labels"),
    )


def group_slices(parts: DataFrame) -> DataFrame:
    """core / extended when all runs agree, mixed otherwise, null when no run has a slice."""
    return parts.groupBy("entry_id").agg(
        F.when(F.max("slice") != F.min("slice"), "mixed").otherwise(F.max("slice")).alias("slice")
    )


def grouped_table(features: DataFrame, runs: DataFrame, parts: DataFrame, columns: list[str]) -> DataFrame:
    """Entry-level table from per-run features, labels and partition slices."""
    keyed = group_key(runs)
    entry = keyed.select("run_id", "entry_id")
    t = features.join(entry, "run_id")
    slices = group_slices(parts.select("run_id", "slice").join(entry, "run_id"))
    stab = [c for c in STABILITY_COLUMNS if c in columns]
    out = group_aggregates(t, columns)
    if stab:
        out = out.join(group_stability(t, stab), "entry_id", "left")
    return out.join(group_labels(keyed), "entry_id", "left").join(slices, "entry_id", "left")


def slice_members(groups: DataFrame, holdout: DataFrame | None = None) -> DataFrame:
    """(slice, entry_id) index sets full / core / extended / mixed, optionally inside a holdout."""
    g = groups.select("entry_id", "slice")
    if holdout is not None:
        g = g.join(holdout.select("entry_id"), "entry_id", "left_semi")
    return g.select(F.explode(F.array_compact(F.array(F.lit("full"), F.col("slice")))).alias("slice"), "entry_id")
