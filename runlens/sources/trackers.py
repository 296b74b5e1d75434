"""Experiment-tracker exports: long metric rows to aligned histories, parameter lifting, silver labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.ordering import ordered_index
from runlens.operators.curves import prepare
from runlens.session import cut_lineage

# --- fixed values: metric names per history column, in order of preference ----------------------
METRIC_NAMES = {
    "train_loss": ("train_loss", "training_loss", "loss", "Loss/train", "loss/train", "train/loss", "training/loss"),
    "val_loss": (
        "val_loss", "validation_loss", "valid_loss", "Loss/val", "loss/val", "val/loss", "validation/loss",
    ),
    "train_acc": (
        "train_acc", "train_accuracy", "training_accuracy", "accuracy", "Accuracy/train", "accuracy/train",
        "train/accuracy", "training/accuracy",
    ),
    "val_acc": (
        "val_acc", "val_accuracy", "validation_accuracy", "valid_accuracy", "Accuracy/val", "accuracy/val",
        "val/accuracy", "validation/accuracy",
    ),
    "lr": ("lr", "learning_rate", "LearningRate", "optim/lr"),
    "grad_norm": ("grad_norm", "GradNorm", "gradient_norm"),
    "weight_norm": ("weight_norm", "WeightNorm"),
}
EVENT_TAGS = {
    "train_loss": ("train_loss", "Loss/train", "loss/train", "Loss_train", "epoch_loss", "training/loss"),
    "val_loss": ("val_loss", "Loss/val", "loss/val", "Loss_val", "epoch_val_loss", "validation/loss"),
    "train_acc": (
        "train_acc", "Accuracy/train", "accuracy/train", "Accuracy_train", "epoch_accuracy", "training/accuracy",
    ),
    "val_acc": (
        "val_acc", "Accuracy/val", "accuracy/val", "Accuracy_val", "epoch_val_accuracy", "validation/accuracy",
    ),
    "lr": ("lr", "learning_rate", "LearningRate", "Learning_rate", "optim/lr"),
    "grad_norm": ("grad_norm", "GradNorm", "gradient_norm"),
    "weight_norm": ("weight_norm", "WeightNorm"),
}
PARAM_NAMES = {
    "dataset_name": ("dataset_name", "dataset", "data"),
    "model_name": ("model_name", "model", "architecture"),
    "framework": ("framework", "library"),
    "optimizer": ("optimizer", "optim"),
    "learning_rate": ("learning_rate", "lr", "initial_lr"),
    "batch_size": ("batch_size", "batchsize"),
    "seed": ("seed", "random_seed"),
}
SILVER_KEYWORDS = (
    ("leakage", ("leak",)),
    ("overfitting", ("overfit",)),
    ("instability", ("unstable", "instability", "diverg")),
    ("label_noise", ("noise", "noisy_label")),
)
# --- end of fixed values ------------------------------------------------------------------------


def resolve_metrics(
    metrics: DataFrame, names: dict[str, tuple[str, ...]] = METRIC_NAMES, user_map: dict[str, str] | None = None
) -> DataFrame:
    """(run_id, column, metric): which metric feeds which history column, per run.

    The user's map comes first; otherwise the first listed name that the run has. A run that lacks a metric of the user's
    map stops the query.
    """
    user_map = user_map or {}
    rows = [(c, m, -1) for c, m in user_map.items()]
    rows += [(c, m, i) for c, options in names.items() if c not in user_map for i, m in enumerate(options)]
    alias = metrics.sparkSession.createDataFrame(rows, "column string, metric string, prio int")
    have = metrics.select("run_id", "metric").distinct()
    # The alias list is a fixed vocabulary of a few dozen rows.
    matched = have.join(F.broadcast(alias), "metric")
    if user_map:
        mapped = sorted(set(user_map.values()))
        seen = have.groupBy("run_id").agg(*[F.max(F.col("metric") == m).alias(f"has{i}") for i, m in enumerate(mapped)])
        lacking = F.concat_ws(", ", *[F.when(~F.col(f"has{i}"), F.lit(m)) for i, m in enumerate(mapped)])
        stop = F.raise_error(F.concat(F.lit("run "), F.col("run_id"), F.lit(" lacks the mapped metric "), lacking)).cast("boolean")
        complete = seen.select("run_id", F.when(lacking == "", F.lit(True)).otherwise(stop).alias("_complete"))
        matched = matched.join(complete, "run_id").where("_complete").drop("_complete")
    return matched.groupBy("run_id", "column").agg(F.min_by("metric", "prio").alias("metric"))


def repair_steps(metrics: DataFrame) -> DataFrame:
    """Series with any missing step are renumbered 0.. by timestamp; others stay as logged."""
    broken = metrics.where("step is null").select("run_id", "metric").distinct()
    keep = metrics.join(broken, ["run_id", "metric"], "left_anti")
    fix = ordered_index(
        metrics.join(broken, ["run_id", "metric"], "left_semi").drop("step"),
        ["run_id", "metric"],
        [F.col("ts"), F.col("seq")],
        F.date_trunc("hour", F.col("ts")),
        out="step",
    )
    return keep.unionByName(fix.select(*keep.columns))


def to_history(
    metrics: DataFrame, names: dict[str, tuple[str, ...]] = METRIC_NAMES, user_map: dict[str, str] | None = None
) -> DataFrame:
    """(run_id, metric, step, ts, seq, value) to (run_id, pos, epoch, one column per curve).

    The last value per step wins, metrics are aligned by step, and epochs are renumbered from 1.
    """
    mapping = resolve_metrics(metrics, names, user_map)
    m = repair_steps(metrics).join(mapping, ["run_id", "metric"])
    last = m.groupBy("run_id", "step", "column").agg(F.max_by("value", F.struct("ts", "seq")).alias("value"))
    wide = last.groupBy("run_id", "step").agg(
        *[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in names]
    )
    # Numbering reads its input twice (sizes, then rows), so the joined and pivoted rows are written once.
    wide = cut_lineage(wide)
    placed = ordered_index(wide, ["run_id"], [F.col("step")], F.floor(F.col("step") / 4096), out="pos")
    return placed.select("run_id", "pos", (F.col("pos") + 1).alias("epoch"), *names)


def lift_params(params: DataFrame) -> DataFrame:
    """(run_id, params MAP<STRING,STRING>) to typed meta columns by synonym lists."""
    p = F.col("params")

    def pick(keys: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.try_element_at(p, F.lit(k)) for k in keys])

    casts = {"learning_rate": "double", "batch_size": "long", "seed": "long"}
    return params.select(
        "run_id",
        *[
            (pick(keys).try_cast(casts[c]) if c in casts else pick(keys)).alias(c)
            for c, keys in PARAM_NAMES.items()
        ],
    )


def silver_keyword(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, words in reversed(SILVER_KEYWORDS):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, label).otherwise(out)
    return out


def silver_curve_stats(history: DataFrame) -> DataFrame:
    """Per run: length, first and final accuracies, spread of the last ten validation accuracies."""
    last10 = F.col("pos") >= F.col("run_rows") - 10
    final = F.col("pos") == F.col("run_rows") - 1
    return prepare(history).groupBy("run_id").agg(
        F.max("run_rows").alias("n_rows"),
        F.max(F.col("val_acc").isNotNull()).alias("has_val"),
        F.max(F.col("train_acc").isNotNull()).alias("has_train"),
        F.max(F.when(final, F.col("x_val_acc"))).alias("val_final"),
        F.max(F.when(final, F.col("x_train_acc"))).alias("train_final"),
        F.max(F.when(F.col("pos") == 0, F.col("x_train_acc"))).alias("train_first"),
        F.stddev_pop(F.when(last10, F.col("x_val_acc"))).alias("val_std_last10"),
    )


def silver_labels(runs: DataFrame, stats: DataFrame) -> DataFrame:
    """Silver label per run from (run_id, run_name, tags): keywords first, then curve rules."""
    text = F.lower(F.concat_ws(" ", F.coalesce("run_name", F.lit("")), F.coalesce("tags", F.lit(""))))
    gap = F.col("train_final") - F.col("val_final")
    no = F.lit(False)
    rules = (
        F.when(F.col("n_rows").isNull() | (F.col("n_rows") < 3), "unlabeled")
        .when(~F.col("has_val"), "unlabeled")
        .when(
            F.coalesce(
                (F.col("val_final") >= 0.85) & (F.col("train_final") >= 0.95) & (F.abs(gap) < 0.05), no
            ),
            "healthy",
        )
        .when(F.coalesce(gap > 0.20, no), "overfitting")
        .when(F.coalesce(F.col("val_std_last10") > 0.10, no), "instability")
        .when(
            F.coalesce(
                (F.col("val_final") < 0.65)
                & (~F.col("has_train") | F.coalesce(F.col("val_final") - F.col("train_first") < 0.10, no)),
                no,
            ),
            "underfitting",
        )
        .otherwise("unlabeled")
    )
    j = runs.join(stats, "run_id", "left")
    return j.select("run_id", F.coalesce(silver_keyword(text), rules).alias("label"))


def silver_summary(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_runs"))
