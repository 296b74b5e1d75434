"""From curves to diagnoses, evidence, text and actions for a whole fleet of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators import curves
from runlens.operators.actions import recommendations
from runlens.operators.cascade import diagnose
from runlens.operators.cleaning import column_medians, impute_medians
from runlens.operators.curves import BASE_FEATURES, KEPT_PROXIES, PROXY_FEATURES
from runlens.operators.evidence import build_evidence
from runlens.operators.integrity import integrity_meta_features
from runlens.operators.narrative import narrate
from runlens.operators.training import Cascade, train_cascade
from runlens.session import cut_lineage

MODEL_COLUMNS = (*BASE_FEATURES, *KEPT_PROXIES)


def fleet_features(history: DataFrame, meta: DataFrame) -> DataFrame:
    """One stored row per run: curve features, integrity proxies, declared integrity values."""
    f = curves.full_features(history).select("run_id", *BASE_FEATURES, *PROXY_FEATURES)
    return cut_lineage(f.join(integrity_meta_features(meta), "run_id", "left"))


def model_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(run_id, y, x): imputed feature arrays; medians are fitted on the labelled rows."""
    columns = list(MODEL_COLUMNS)
    t = features.select("run_id", *columns).join(labels.select("run_id", F.col("primary_label").alias("y")), "run_id", "left")
    filled = impute_medians(t, columns, column_medians(t.where("y is not null"), columns))
    return cut_lineage(filled.select("run_id", "y", F.array(*columns).alias("x")))


def diagnose_fleet(history: DataFrame, meta: DataFrame, labels: DataFrame, *, cascade: Cascade | None = None, kind: str = "logistic", language: str = "en", max_recommendations: int = 3) -> DataFrame:
    """Diagnosis, evidence, narrative and ranked actions per run.

    A fitted ``cascade`` (its columns named MODEL_COLUMNS) scores all runs; without one, the stages are trained on the labelled runs
    first. The evidence holds the features that weighed most in each fitted stage.
    """
    features = fleet_features(history, meta)
    rows = model_rows(features, labels)
    if cascade is None:
        cascade = train_cascade(rows.where("y is not null"), kind=kind, columns=MODEL_COLUMNS)
    diagnoses = diagnose(cut_lineage(cascade.score(rows.select("run_id", "x")).drop("x")), healthy_threshold=cascade.healthy_threshold)
    evidence = build_evidence(diagnoses, features, cascade.importances())
    text = narrate(evidence, language)
    return evidence.withColumn("actions", recommendations(max_recommendations)).join(text, "run_id")
