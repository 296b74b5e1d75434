"""Core / extended partition of a corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.vocab import HEALTHY


@dataclass(frozen=True)
class PartitionRules:
    core_severities: tuple[str, ...] = ("moderate", "severe")
    extended_severities: tuple[str, ...] = ("mild",)
    require_single_label: bool = True
    min_history_epochs: int = 5
    saturated_datasets: tuple[str, ...] = ()

    @classmethod
    def from_mapping(cls, settings: dict | None) -> PartitionRules:
        """From a config section; absent keys keep their defaults."""
        names = {
            "core_severities": "core_severities",
            "extended_severities": "extended_severities",
            "require_single_label_for_core": "require_single_label",
            "min_history_epochs": "min_history_epochs",
            "near_saturated_datasets": "saturated_datasets",
        }
        given = {names[k]: v for k, v in (settings or {}).items() if k in names and v is not None}
        return cls(**{k: tuple(map(str, v)) if isinstance(v, (list, tuple)) else v for k, v in given.items()})


def _unlabelled(r: PartitionRules) -> list[tuple[Column, str]]:
    return [(F.coalesce(F.col("primary_label"), F.lit("")) == "", "unlabeled")]


def _multi_label(r: PartitionRules) -> list[tuple[Column, str]]:
    return [(F.coalesce(F.col("is_multi_label"), F.lit(False)) & F.lit(r.require_single_label), "multi_label")]


def _mild(r: PartitionRules) -> list[tuple[Column, str]]:
    return [(F.lower("severity").isin(*r.extended_severities), "severity_mild")]


def _severity(r: PartitionRules) -> list[tuple[Column, str]]:
    sev = F.lower("severity")
    blank = F.coalesce(F.col("severity"), F.lit("")) == ""
    healthy = F.coalesce(F.col("primary_label") == HEALTHY, F.lit(False))
    known = sev.isin(*r.core_severities, *r.extended_severities, "none")
    return [
        (blank, "severity_unknown"),
        (~blank & (sev == "none") & ~healthy, "severity_none_on_faulty"),
        (~blank & ~known, "severity_out_of_vocabulary"),
    ]


def _short(r: PartitionRules) -> list[tuple[Column, str]]:
    n = F.col("n_history_rows")
    return [
        (n.isNull(), "history_unparseable"),
        (n < r.min_history_epochs, f"short_history_lt_{r.min_history_epochs}"),
    ]


def _saturated(r: PartitionRules) -> list[tuple[Column, str]]:
    if not r.saturated_datasets:
        return []
    return [((F.lower("severity") == "mild") & F.col("dataset").isin(*r.saturated_datasets), "mild_on_near_saturated")]


RULES = (_unlabelled, _multi_label, _mild, _severity, _short, _saturated)


def reasons(rules: PartitionRules) -> Column:
    found = [F.when(cond, F.lit(name)) for rule in RULES for cond, name in rule(rules)]
    return F.array_compact(F.array(*found))


def partition_runs(runs: DataFrame, rules: PartitionRules = PartitionRules()) -> DataFrame:
    """Add ``slice`` (core / extended) and ``reasons``; a narrow projection."""
    sev = F.lower("severity")
    healthy_ok = (F.col("primary_label") == HEALTHY) & (sev.isNull() | sev.isin("none", *rules.core_severities))
    core = F.coalesce(healthy_ok | sev.isin(*rules.core_severities), F.lit(False))
    out = runs.withColumn("_r", reasons(rules))
    clean = F.size("_r") == 0
    return out.select(
        *runs.columns,
        F.when(clean & core, "core").otherwise("extended").alias("slice"),
        F.when(clean & ~core, F.array(F.lit("severity_not_in_core_whitelist"))).otherwise(F.col("_r")).alias("reasons"),
    )


def slice_summary(parts: DataFrame) -> DataFrame:
    """(slice, primary_label, n): class balance per slice."""
    return parts.groupBy("slice", "primary_label").agg(F.count(F.lit(1)).alias("n"))


def reason_summary(parts: DataFrame) -> DataFrame:
    return parts.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def evaluation_slices(parts: DataFrame, features: DataFrame, holdout: DataFrame | None = None) -> DataFrame:
    """(slice, run_id) for full, core and extended, limited to runs with features and in the holdout."""
    ids = features.select("run_id")
    if holdout is not None:
        ids = ids.join(holdout.select("run_id"), "run_id", "left_semi")
    known = ids.join(parts.select("run_id", "slice"), "run_id", "left")
    names = F.array_compact(F.array(F.lit("full"), F.col("slice")))
    return known.select(F.explode(names).alias("slice"), "run_id")
