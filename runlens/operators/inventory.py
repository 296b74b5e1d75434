"""Corpus inventory: counts, cross-tabs, branch support, coverage gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.vocab import FAULTY_CLASSES, taxonomy, to_stage1, to_stage2

UNLABELLED, UNKNOWN = "<unlabeled>", "<unknown>"


def filled(runs: DataFrame) -> DataFrame:
    return runs.fillna({"primary_label": UNLABELLED, "severity": UNKNOWN, "dataset": UNKNOWN})


def marginal_counts(runs: DataFrame) -> DataFrame:
    """(dimension, value, n) for label, severity and dataset in one aggregation."""
    dims = ("primary_label", "severity", "dataset")
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])
    # Count the combinations first, so that each row is shuffled (and spread) as part of a count.
    cells = cross_tab(runs, *dims)
    long = cells.select("n", F.explode(pairs).alias("p")).select("n", "p.dimension", "p.value")
    return long.groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def cross_tab(runs: DataFrame, *columns: str) -> DataFrame:
    return filled(runs).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def cross_tab_with_totals(runs: DataFrame, rows: str, columns: str, total: str = "<total>") -> DataFrame:
    """Two-way counts with row, column and grand totals."""
    cube = filled(runs).cube(rows, columns).agg(
        F.count(F.lit(1)).alias("n"), F.grouping(rows).alias("_gr"), F.grouping(columns).alias("_gc")
    )
    return cube.select(
        F.when(F.col("_gr") == 1, total).otherwise(F.col(rows)).alias(rows),
        F.when(F.col("_gc") == 1, total).otherwise(F.col(columns)).alias(columns),
        "n",
    )


def scalar_counts(runs: DataFrame, min_history_epochs: int = 5) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.count_if("is_multi_label").alias("multi_label_count"),
        F.count_if(F.col("n_history_rows") < min_history_epochs).alias("short_history_count"),
    )


def class_counts(runs: DataFrame) -> DataFrame:
    """taxonomy + n, zero-filled; labels outside the vocabulary are left out."""
    counts = runs.groupBy(F.col("primary_label").alias("primary")).agg(F.count(F.lit(1)).alias("n"))
    # Counts hold one row per distinct label and the taxonomy six rows.
    return taxonomy(runs.sparkSession).join(counts, "primary", "left").fillna({"n": 0})


def label_distribution(runs: DataFrame) -> DataFrame:
    """(level, parent, label, n) zero-filled over the vocabulary of each stage."""
    c = class_counts(runs)
    pairs = F.array(
        F.struct(F.lit("stage1").alias("level"), F.lit("").alias("parent"), F.col("stage1").alias("label")),
        F.struct(F.lit("stage2").alias("level"), F.lit("").alias("parent"), F.col("stage2").alias("label")),
        F.struct(F.lit("stage3").alias("level"), F.col("stage2").alias("parent"), F.col("stage3").alias("label")),
    )
    long = c.select("n", F.explode(pairs).alias("p")).select("p.*", "n").where("label is not null")
    return long.groupBy("level", "parent", "label").agg(F.sum("n").alias("n"))


def coverage_gaps(runs: DataFrame, min_leaf_support: int = 5) -> DataFrame:
    """(kind, label, severity, detail, support): what the corpus lacks to train every stage."""
    c = class_counts(runs)
    absent = c.where("n = 0").select(
        F.lit("taxonomy").alias("kind"),
        F.col("primary").alias("label"),
        F.lit("blocker").alias("severity"),
        F.format_string(
            "primary class `%s` is not represented at all — the failure taxonomy is incomplete on this corpus.", "primary"
        ).alias("detail"),
        F.col("n").alias("support"),
    )
    branches = c.where("stage2 is not null").groupBy("stage2").agg(F.sum("n").alias("n")).where("n = 0").select(
        F.lit("branch").alias("kind"),
        F.col("stage2").alias("label"),
        F.lit("blocker").alias("severity"),
        F.format_string(
            "Stage-2 branch `%s` has zero faulty runs — Stage-2 / Stage-3 models for this side cannot be trained.", "stage2"
        ).alias("detail"),
        F.col("n").alias("support"),
    )
    leaves = c.where(F.col("stage3").isNotNull() & (F.col("n") < min_leaf_support)).select(
        F.lit("stage3_leaf").alias("kind"),
        F.col("stage3").alias("label"),
        F.when(F.col("n") > 0, "warning").otherwise("blocker").alias("severity"),
        F.format_string(
            f"leaf class `%s` (branch `%s`) has only %d runs (< {min_leaf_support}) — Stage-3 model for this branch will be unstable.",
            "stage3", "stage2", "n",
        ).alias("detail"),
        F.col("n").alias("support"),
    )
    strong = runs.where(F.col("severity").isin("moderate", "severe")).groupBy(F.col("primary_label").alias("primary")).agg(
        F.count(F.lit(1)).alias("strong")
    )
    weak = (
        c.where(F.col("primary").isin(*FAULTY_CLASSES))
        .join(strong, "primary", "left")
        .where(F.coalesce("strong", F.lit(0)) == 0)
        .select(
            F.lit("severity_dataset").alias("kind"),
            F.col("primary").alias("label"),
            F.lit("warning").alias("severity"),
            F.format_string(
                "class `%s` has no moderate/severe runs — it cannot enter the core benchmark slice.", "primary"
            ).alias("detail"),
            F.lit(0).cast("long").alias("support"),
        )
    )
    return absent.unionByName(branches).unionByName(leaves).unionByName(weak)


def inventory_verdict(gaps: DataFrame, strict: bool = False) -> DataFrame:
    """One row: number of blockers and warnings, and whether the corpus passes."""
    blockers, warnings = F.count_if(F.col("severity") == "blocker"), F.count_if(F.col("severity") == "warning")
    taxonomy_ok = F.count_if(F.col("kind") == "taxonomy") == 0
    branch_ok = F.count_if(F.col("kind").isin("branch", "stage3_leaf") & (F.col("severity") == "blocker")) == 0
    failing = blockers + warnings if strict else blockers
    return gaps.agg(
        blockers.alias("n_blockers"),
        warnings.alias("n_warnings"),
        taxonomy_ok.alias("taxonomy_complete"),
        branch_ok.alias("branch_complete"),
        (failing == 0).alias("passed"),
    )


def unknown_labels(runs: DataFrame) -> DataFrame:
    """Distinct labels outside the taxonomy."""
    return (
        runs.where("primary_label is not null").select(F.col("primary_label").alias("primary")).distinct()
        .join(taxonomy(runs.sparkSession), "primary", "left_anti")
    )


def class_balance(runs: DataFrame) -> DataFrame:
    """(primary_label, n, share): counts with their share of all runs."""
    counts = cross_tab(runs, "primary_label")
    total = runs.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def stages_of(runs: DataFrame, strict: bool = True) -> DataFrame:
    """Stage labels per run; an unknown label fails the query unless ``strict`` is off."""
    lab = F.col("primary_label")
    return runs.select(
        "run_id",
        "primary_label",
        to_stage1(lab, strict).alias("stage1"),
        to_stage2(lab, strict).alias("stage2"),
        F.when(to_stage2(lab, strict).isNotNull(), lab).alias("stage3"),
    )

