"""Linear cascade stages from a table of weights: scored as plain columns, so they run in batch and inside a stream alike.

weights: stage, label, feature, weight; the feature ``bias`` is the intercept. A stage's probabilities are the softmax of its
labels' sums. Missing features count as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.probs import softmax
from runlens.operators.training import STAGES

WEIGHTS_SQL = "stage string, label string, feature string, weight double"
Weights = dict[tuple[str, str], dict[str, float]]


def save(spark: SparkSession, weights: Weights, path: str) -> None:
    rows = [(stage, label, feature, float(w)) for (stage, label), row in weights.items() for feature, w in row.items()]
    spark.createDataFrame(rows, WEIGHTS_SQL).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Weights:
    """At most a few hundred numbers: one row per stage, label and feature."""
    out: Weights = {}
    for r in spark.read.schema(WEIGHTS_SQL).parquet(path).collect():
        out.setdefault((r["stage"], r["label"]), {})[r["feature"]] = r["weight"]
    missing = [label for label in STAGES["stage1"] if ("stage1", label) not in out]
    if missing:
        raise ValueError(f"stage1 lacks weights of {missing}")
    return out


def _sum(row: dict[str, float]) -> Column:
    total = F.lit(float(row.get("bias", 0.0)))
    for feature, w in sorted(row.items()):
        if feature != "bias":
            total = total + F.coalesce(F.nanvl(F.col(feature), F.lit(None)), F.lit(0.0)) * F.lit(float(w))
    return total


def stage_probabilities(weights: Weights) -> Column:
    """``stage_probs`` in the order of the vocabulary; null entries for a stage without weights."""
    parts: list[Column] = []
    for stage, labels in STAGES.items():
        if all((stage, label) in weights for label in labels):
            parts.append(softmax([_sum(weights[stage, label]) for label in labels]))
        else:
            parts.append(F.array(*[F.lit(None).cast("double")] * len(labels)))
    return F.concat(*parts)


def importances(weights: Weights) -> dict[str, dict[str, float]]:
    """Stage -> feature -> mean absolute weight over the stage's labels, in order of the features' names."""
    out: dict[str, dict[str, float]] = {}
    for stage, labels in STAGES.items():
        rows = [weights[stage, label] for label in labels if (stage, label) in weights]
        names = sorted({f for row in rows for f in row if f != "bias"})
        if names:
            out[stage] = {f: sum(abs(row.get(f, 0.0)) for row in rows) / len(rows) for f in names}
    return out


def score(features: DataFrame, weights: Weights) -> DataFrame:
    return features.withColumn("stage_probs", stage_probabilities(weights))
