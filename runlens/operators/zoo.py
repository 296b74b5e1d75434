"""Classifiers on MLlib with one scoring interface: a probability array in a fixed class order."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.probs import normalise, top_label
from runlens.operators import boosting, isotonic
from runlens.operators.boosting import BoostedTrees
from runlens.operators.folds import assign_folds
from runlens.operators.metrics import confusion_cells, summary
from runlens.session import cut_lineage

PARALLEL_FITS = 4


def logistic(seed: int, n_classes: int, iterations: int = 100) -> Pipeline:
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", maxIter=iterations, regParam=1e-3, family="multinomial")
    return Pipeline(stages=[scale, lr])


def random_forest(seed: int, n_classes: int, trees: int = 300, depth: int = 12) -> Pipeline:
    rf = RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees, minInstancesPerNode=2, maxDepth=depth, seed=seed
    )
    return Pipeline(stages=[rf])


def entropy_tree(seed: int, n_classes: int, depth: int = 10) -> Pipeline:
    dt = DecisionTreeClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", impurity="entropy", maxDepth=depth, minInstancesPerNode=2, seed=seed
    )
    return Pipeline(stages=[dt])


ZOO = {"logistic": logistic, "random_forest": random_forest, "entropy_tree": entropy_tree}
KINDS = (*ZOO, "boosted")


@dataclass
class Scorer:
    """A fitted classifier. ``parts`` is one model."""

    kind: str
    classes: tuple[str, ...]
    columns: tuple[str, ...]
    parts: list[Model | BoostedTrees]
    calibrators: list[Model] = field(default_factory=list)

    def probabilities(self, df: DataFrame, out: str = "p", features: str = "x") -> DataFrame:
        """Add ``out``: probabilities in class order. ``features`` is an ARRAY<DOUBLE> column."""
        keep = df.columns
        if self.kind == "boosted":
            t = self.parts[0].transform(df, features, "_v")
        else:
            t = self.parts[0].transform(df.withColumn("features", array_to_vector(features))).withColumn("_v", vector_to_array("probability"))
        p = [F.coalesce(F.get("_v", F.lit(i)), F.lit(0.0)) for i in range(len(self.classes))]
        raw = t.withColumn(out, normalise(p)).select(*keep, out)
        return raw if not self.calibrators else _apply_calibration(raw, out, self.calibrators)

    def predict(self, df: DataFrame, out: str = "pred", features: str = "x") -> DataFrame:
        scored = self.probabilities(df, "_p", features)
        return scored.withColumn(out, top_label(F.col("_p"), self.classes)).drop("_p")

    def importances(self) -> dict[str, float]:
        """Tree importances, or mean absolute coefficients, per feature column."""
        if self.kind == "boosted":
            values = self.parts[0].importances()
        elif self.kind == "logistic":
            values = abs(self.parts[0].stages[-1].coefficientMatrix.toArray()).mean(axis=0)
        else:
            values = self.parts[0].stages[-1].featureImportances.toArray()
        return {c: float(v) for c, v in zip(self.columns, values)}


def _training_rows(df: DataFrame, classes: tuple[str, ...], label: str, features: str) -> tuple[DataFrame, int]:
    """(label index, balanced weight, feature vector) and the vector width.

    Class counts are a few numbers, so the weights enter as literals: MLlib scans its input many
    times and every scan stays a plain projection of the stored table.
    """
    known = df.where(F.col(label).isin(*classes))
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(features)).alias("w")).collect()
    if not counts:
        raise ValueError("no labelled training rows")
    total = sum(r["n"] for r in counts)
    index, weight = F.lit(None).cast("double"), F.lit(None).cast("double")
    for r in counts:
        mine = F.col(label) == r[label]
        index = F.when(mine, float(classes.index(r[label]))).otherwise(index)
        weight = F.when(mine, total / (len(counts) * r["n"])).otherwise(weight)
    rows = known.select(index.alias("label"), weight.alias("weight"), array_to_vector(features).alias("features"))
    return rows, counts[0]["w"]


def fit(
    df: DataFrame, classes: tuple[str, ...], *, kind: str = "logistic", label: str = "y", features: str = "x",
    columns: tuple[str, ...] | None = None, seed: int = 0, **options,
) -> Scorer:
    """Fit one classifier on rows (label, features ARRAY<DOUBLE>) with balanced class weights."""
    t, size = _training_rows(df, tuple(classes), label, features)
    width = columns or tuple(f"f{i}" for i in range(size))
    if kind == "boosted":
        # Boosting weighs all rows alike.
        rows = df.where(F.col(label).isin(*classes)).select(_class_number(label, classes).alias("y"), F.col(features).alias("x"))
        return Scorer(kind, tuple(classes), width, [boosting.fit(rows, len(classes), boosting.Boosting(**options))])
    return Scorer(kind, tuple(classes), width, [ZOO[kind](seed, len(classes), **options).fit(t)])


def _class_number(label: str, classes: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1


# --- calibration ---------------------------------------------------------------------------------


def out_of_fold(df: DataFrame, classes: tuple[str, ...], *, k: int = 3, kind: str = "logistic", label: str = "y", features: str = "x", seed: int = 0, **options) -> DataFrame:
    """``df`` + fold + p: every row scored by a model that did not see its fold."""
    # Training reads its rows many times: fold membership is computed once and stored.
    folded = df if "fold" in df.columns else cut_lineage(assign_folds(df, label, k, seed))

    def one(i: int) -> DataFrame:
        model = fit(folded.where(F.col("fold") != i), classes, kind=kind, label=label, features=features, seed=seed, **options)
        return model.probabilities(folded.where(F.col("fold") == i), "p", features)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        parts = list(pool.map(one, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _isotonic(scored: DataFrame, classes: tuple[str, ...], label: str) -> list[Model]:
    """One curve per class, fitted on all scores as they are; MLlib's model holds the finished blocks (their two ends each)."""
    curves = F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("key"), F.get("p", F.lit(i)).alias("x"), (F.col(label) == c).cast("double").alias("y"))
        for i, c in enumerate(classes)
    ]))
    blocks = cut_lineage(isotonic.fit_blocks(scored.select(curves.alias("c")).select("c.*")))
    ends = F.explode(F.when(F.col("lo") < F.col("hi"), F.array("lo", "hi")).otherwise(F.array("lo"))).alias("features")

    def one(i: int) -> Model:
        points = blocks.where(F.col("key") == i).select(ends, F.col("value").alias("label"), F.lit(1.0).alias("weight"))
        return IsotonicRegression(featuresCol="features", labelCol="label", weightCol="weight").fit(points)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(one, range(len(classes))))


def _sigmoid(scored: DataFrame, classes: tuple[str, ...], label: str) -> list[Model]:
    def one(i: int) -> Model:
        rows = scored.select(
            array_to_vector(F.array(F.get("p", F.lit(i)))).alias("features"), (F.col(label) == classes[i]).cast("double").alias("label")
        )
        return LogisticRegression(featuresCol="features", labelCol="label").fit(rows)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(one, range(len(classes))))


def _apply_calibration(df: DataFrame, p: str, calibrators: list[Model]) -> DataFrame:
    keep = df.columns
    t = df
    for i, m in enumerate(calibrators):
        sigmoid = hasattr(m, "coefficients")
        x = F.get(p, F.lit(i))
        t = m.transform(t.withColumn("features", array_to_vector(F.array(x)) if sigmoid else x))
        value = F.get(vector_to_array("probability"), F.lit(1)) if sigmoid else F.col("prediction")
        t = t.withColumn(f"_c{i}", value).drop("features", "prediction", "rawPrediction", "probability")
    return t.withColumn(p, normalise([F.col(f"_c{i}") for i in range(len(calibrators))])).select(*keep)


def fit_calibrated(df: DataFrame, classes: tuple[str, ...], *, method: str = "isotonic", k: int = 3, **settings) -> Scorer:
    """A classifier fitted on all rows, with per-class calibration curves from out-of-fold scores."""
    label = settings.get("label", "y")
    scored = cut_lineage(out_of_fold(df, classes, k=k, **settings).select(label, "p"))
    model = fit(df, classes, **settings)
    model.calibrators = (_isotonic if method == "isotonic" else _sigmoid)(scored, model.classes, label)
    return model


# --- selection -----------------------------------------------------------------------------------


def cv_scores(df: DataFrame, classes: tuple[str, ...], kinds: tuple[str, ...], *, k: int = 5, label: str = "y", features: str = "x", seed: int = 0, options: dict | None = None) -> DataFrame:
    """(kind, fold, accuracy, macro_f1) of every candidate on the same folds."""
    folded = cut_lineage(assign_folds(df, label, k, seed))
    out = None
    for kind in kinds:
        scored = out_of_fold(folded, classes, k=k, kind=kind, label=label, features=features, seed=seed, **(options or {}).get(kind, {}))
        rows = scored.select("fold", F.col(label).alias("y_true"), top_label(F.col("p"), classes).alias("pred"))
        rep = summary(confusion_cells(rows, ["fold"]), ["fold"], classes).select(F.lit(kind).alias("kind"), "fold", "accuracy", "macro_f1")
        out = rep if out is None else out.unionByName(rep)
    return out


def select_model(df: DataFrame, classes: tuple[str, ...], kinds: tuple[str, ...], **settings) -> tuple[str, list]:
    """(winning kind, mean macro-F1 per kind); only the per-kind means reach the driver."""
    means = cv_scores(df, classes, kinds, **settings).groupBy("kind").agg(F.avg("macro_f1").alias("m")).collect()
    order = {kd: i for i, kd in enumerate(kinds)}
    best = max(means, key=lambda r: (r["m"], -order[r["kind"]]))
    return best["kind"], sorted(((r["kind"], r["m"]) for r in means), key=lambda e: order[e[0]])


# --- persistence ---------------------------------------------------------------------------------


def save(model: Scorer, path: str, **extra) -> None:
    """Write the models below ``path`` and their settings as one JSON line."""
    spark = SparkSession.getActiveSession()
    for name, group in (("part", model.parts), ("calibrator", model.calibrators)):
        for i, m in enumerate(group):
            if isinstance(m, BoostedTrees):
                m.save(spark, f"{path}/{name}-{i}")
            else:
                PipelineModel(stages=[m]).write().overwrite().save(f"{path}/{name}-{i}")
    settings = {
        "kind": model.kind, "classes": list(model.classes), "columns": list(model.columns), "parts": len(model.parts),
        "calibrators": len(model.calibrators), **extra,
    }
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load(spark, path: str) -> tuple[Scorer, dict]:
    settings = json.loads(spark.read.text(f"{path}/settings").first()[0])

    def models(name: str) -> list[Model | BoostedTrees]:
        if name == "part" and settings["kind"] == "boosted":
            return [BoostedTrees.load(spark, f"{path}/part-0")]
        return [PipelineModel.load(f"{path}/{name}-{i}").stages[0] for i in range(settings[f"{name}s"])]

    model = Scorer(settings["kind"], tuple(settings["classes"]), tuple(settings["columns"]), models("part"), models("calibrator"))
    return model, settings

