"""Meta features for stacking the contours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.numeric import finite
from runlens.functions.probs import items, kl_divergence, top_label, top_value
from runlens.vocab import CLASSES, STAGE_COLUMNS

FLAT_COLUMNS = tuple(f"flat_{c}" for c in CLASSES)
CASCADE_COLUMNS = tuple(f"cascade_{c}" for c in CLASSES)
ARBITRATOR_COLUMNS = tuple(f"arb_{c}" for c in CLASSES)
META_FEATURES = (
    *FLAT_COLUMNS, *CASCADE_COLUMNS, *STAGE_COLUMNS, "agreement_bit", "min_max_proba", "max_max_proba", "kl_flat_cascade",
    *ARBITRATOR_COLUMNS, "arb_triggered_bit", "arb_confidence",
)


def meta_feature_columns() -> dict[str, Column]:
    """The 33 meta features from flat[6], cascade[6], stage_probs[9], arbitrator[6], arb_triggered, arb_confidence."""
    fp, cp = F.col("flat"), F.col("cascade")
    out: dict[str, Column] = {}
    out.update(zip(FLAT_COLUMNS, items(fp, 6)))
    out.update(zip(CASCADE_COLUMNS, items(cp, 6)))
    out.update(zip(STAGE_COLUMNS, items(F.col("stage_probs"), 9)))
    out["agreement_bit"] = (top_label(fp) == top_label(cp)).cast("double")
    out["min_max_proba"] = F.least(top_value(fp), top_value(cp))
    out["max_max_proba"] = F.greatest(top_value(fp), top_value(cp))
    out["kl_flat_cascade"] = kl_divergence(fp, cp)
    out.update(zip(ARBITRATOR_COLUMNS, [F.coalesce(v, F.lit(0.0)) for v in items(F.col("arbitrator"), 6)]))
    out["arb_triggered_bit"] = F.col("arb_triggered").cast("double")
    out["arb_confidence"] = F.col("arb_confidence").cast("double")
    return out


def meta_features(df: DataFrame, keep: tuple[str, ...] = ("run_id",), means: DataFrame | None = None) -> DataFrame:
    """keep + META_FEATURES; missing values become the column's mean (of ``means``, else of ``df``)."""
    raw = df.select(*keep, *[c.alias(n) for n, c in meta_feature_columns().items()])
    means = feature_means(raw) if means is None else means
    packed = raw.withColumn("_m", means.select(F.struct(*META_FEATURES)).scalar())
    return packed.select(*keep, *[F.coalesce(finite(F.col(c)), F.col(f"_m.{c}")).alias(c) for c in META_FEATURES])


def feature_means(raw: DataFrame) -> DataFrame:
    return raw.agg(*[F.coalesce(F.avg(finite(F.col(c))), F.lit(0.0)).alias(c) for c in META_FEATURES])
