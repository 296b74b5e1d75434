"""Run-level feature assembly: numeric meta features, declared integrity values, joins, contrast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.numeric import coerce_scalar
from runlens.operators import curves
from runlens.vocab import HEALTHY, LEAKAGE

# --- fixed values: meta keys read as numeric features, and synonyms of integrity values ---------
NUMERIC_META = ("lr", "learning_rate", "batch_size", "weight_decay", "n_params")
INTEGRITY_META = {
    "di_train_val_overlap": ("train_val_overlap", "trainval_overlap", "duplicate_overlap_ratio"),
    "di_duplicate_index_overlap": ("duplicate_index_overlap", "duplicate_indices_ratio", "exact_duplicates_ratio"),
    "di_replay_evidence": ("replay_evidence", "augmentation_replay", "replay_indicator"),
    "di_mi_target_features": ("mi_target_features", "mutual_information_features_target", "mi_features_target"),
    "di_split_hash_collision": ("split_hash_collision", "split_hash_collisions", "split_integrity_collision_rate"),
    "di_label_noise_rate_declared": ("label_noise_rate", "declared_noise_rate", "noise_ratio"),
    "di_split_seed": ("split_seed", "data_split_seed"),
}
# --- end of fixed values ------------------------------------------------------------------------


def meta_numerics(meta_json: Column) -> dict[str, Column]:
    """``meta_<key>`` for JSON numbers only (booleans, strings and absent keys give null)."""
    v = F.try_parse_json(meta_json)
    out = {}
    for key in NUMERIC_META:
        item = F.try_variant_get(v, f"$.{key}", "variant")
        kind = F.schema_of_variant(item)
        number = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT")
        out[f"meta_{key}"] = F.when(number, F.try_variant_get(v, f"$.{key}", "double"))
    return out


def integrity_meta(meta_json: Column) -> dict[str, Column]:
    """The seven declared integrity values: the first synonym that coerces to a number wins."""
    return {
        name: F.coalesce(*[coerce_scalar(F.get_json_object(meta_json, f"$.{k}")) for k in keys])
        for name, keys in INTEGRITY_META.items()
    }


def integrity_meta_features(meta: DataFrame) -> DataFrame:
    exprs = integrity_meta(F.col("meta_json"))
    return meta.select("run_id", *[e.alias(n) for n, e in exprs.items()])


def build_feature_table(history: DataFrame, meta: DataFrame, labels: DataFrame) -> DataFrame:
    """Base table: curve features, kept proxies, meta numerics and the label.

    All three inputs have one row per run except ``history``; joins are equi-joins on run_id.
    """
    numerics = meta.select("run_id", *[e.alias(n) for n, e in meta_numerics(F.col("meta_json")).items()])
    return curves.feature_table(history).join(numerics, "run_id", "left").join(labels, "run_id", "left")


def join_integrity(base: DataFrame, integrity: DataFrame) -> DataFrame:
    """Left-join the integrity block; columns that the base already has are taken from the block."""
    overlap = [c for c in integrity.columns if c != "run_id" and c in base.columns]
    return base.drop(*overlap).join(integrity, "run_id", "left")


def leakage_contrast(table: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean and sample deviation of each column for leakage and healthy runs (4 digits)."""
    kept = table.where(F.col("primary_label").isin(LEAKAGE, HEALTHY))
    aggs = []
    for c in columns:
        aggs += [
            F.count(c).alias(f"{c}__count"),
            F.round(F.avg(c), 4).alias(f"{c}__mean"),
            F.round(F.stddev_samp(c), 4).alias(f"{c}__std"),
        ]
    return kept.groupBy("primary_label").agg(*aggs)
