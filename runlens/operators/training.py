"""Training the flat model and the four-stage cascade, out-of-fold predictions, stacking, ablations."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.probs import items, top_label
from runlens.operators import zoo
from runlens.operators.cascade import compose_probabilities
from runlens.operators.folds import assign_folds
from runlens.operators.metrics import confusion_cells, summary
from runlens.operators.stacking import META_FEATURES, meta_features
from runlens.session import cut_lineage
from runlens.vocab import CLASSES, DATA, FAULTY, OPTGEN, STAGE1, STAGE2, STAGE3_DATA, STAGE3_OPT, to_stage1, to_stage2

STAGES = {"stage1": STAGE1, "stage2": STAGE2, "stage3_data": STAGE3_DATA, "stage3_opt": STAGE3_OPT}


def stage_rows(df: DataFrame, stage: str, label: str = "y") -> DataFrame:
    """Training rows of a stage with its own label in ``stage_y``."""
    y = F.col(label)
    s1, s2 = to_stage1(y, strict=False), to_stage2(y, strict=False)
    if stage == "stage1":
        return df.withColumn("stage_y", s1).where("stage_y is not null")
    if stage == "stage2":
        return df.where(s1 == FAULTY).withColumn("stage_y", s2)
    branch = DATA if stage == "stage3_data" else OPTGEN
    return df.where(s2 == branch).withColumn("stage_y", y)


@dataclass
class Cascade:
    """Fitted stages; a stage whose rows held fewer than two classes is absent."""

    stages: dict[str, zoo.Scorer]
    healthy_threshold: float = 0.5

    def score(self, df: DataFrame, features: str = "x") -> DataFrame:
        """Add stage_probs[9]; every stage scores every row (narrow), gating happens when composing."""
        t, keep = df, df.columns
        for name, model in self.stages.items():
            t = model.probabilities(t, f"_{name}", features)
        none = F.lit(None).cast("double")
        parts = []
        for name, classes in STAGES.items():
            have = name in self.stages
            parts += items(F.col(f"_{name}"), len(classes)) if have else [none] * len(classes)
        return t.withColumn("stage_probs", F.array(*parts)).select(*keep, "stage_probs")

    def importances(self) -> dict[str, dict[str, float]]:
        """Stage -> feature column -> importance of the fitted models."""
        return {name: model.importances() for name, model in self.stages.items()}


@dataclass
class Selected:
    """A cascade and a flat model whose kinds won on the same folds; ``scores`` has one row per (stage, kind)."""

    cascade: Cascade
    flat: zoo.Scorer
    scores: DataFrame


def select_models(
    df: DataFrame, kinds: tuple[str, ...] = zoo.KINDS, *, k: int = 5, label: str = "y", features: str = "x", seed: int = 0,
    options: dict[str, dict] | None = None, columns: tuple[str, ...] | None = None,
) -> Selected:
    """Choose the kind of every stage and of the flat model by mean macro-F1 over ``k`` folds, and refit the winners on all rows.

    One folded table serves all fits; a fold of a stage is the stage's part of the table's fold. All (stage, kind, fold) fits go
    through one bounded pool. A fit brings two numbers to the driver.
    """
    folded = cut_lineage(assign_folds(df.where(F.col(label).isNotNull()), label, k, seed))
    stages = {"flat": CLASSES, **STAGES}
    parts = {s: folded.withColumn("stage_y", F.col(label)) if s == "flat" else stage_rows(folded, s, label) for s in stages}
    present = {s: {r["stage_y"] for r in rows.select("stage_y").distinct().collect()} for s, rows in parts.items()}
    stages = {s: classes for s, classes in stages.items() if len(present[s]) > 1}

    def settings(kind: str) -> dict:
        return dict(kind=kind, label="stage_y", features=features, seed=seed, **(options or {}).get(kind, {}))

    def judge(job: tuple[str, str, int]) -> tuple:
        stage, kind, fold = job
        rows, classes = parts[stage], stages[stage]
        model = zoo.fit(rows.where(F.col("fold") != fold), classes, **settings(kind))
        seen = model.predict(rows.where(F.col("fold") == fold), features=features).select(F.col("stage_y").alias("y_true"), "pred")
        got = summary(confusion_cells(seen, []), [], classes).select("macro_f1", "accuracy", "n_samples").first()
        return stage, kind, fold, got["macro_f1"], got["accuracy"], got["n_samples"]

    def refit(stage: str) -> tuple[str, zoo.Scorer]:
        return stage, zoo.fit(parts[stage], stages[stage], columns=columns, **settings(won[stage]))

    jobs = [(s, kind, i) for s in stages for kind in kinds for i in range(k)]
    with ThreadPoolExecutor(zoo.PARALLEL_FITS) as pool:
        judged = [r for r in pool.map(judge, jobs) if r[5]]
        means: dict[tuple[str, str], list[float]] = {}
        for stage, kind, _, f1, acc, n in judged:
            means.setdefault((stage, kind), []).append((f1, acc, n))
        won = {s: max(kinds, key=lambda kind: (sum(x[0] for x in means[s, kind]) / len(means[s, kind]), -kinds.index(kind))) for s in stages}
        fitted = dict(pool.map(refit, stages))
    rows = [
        (s, kind, sum(x[0] for x in v) / len(v), sum(x[1] for x in v) / len(v), int(sum(x[2] for x in v)), len(v), won[s] == kind)
        for (s, kind), v in means.items()
    ]
    scores = df.sparkSession.createDataFrame(
        rows, "stage string, kind string, macro_f1 double, accuracy double, n_samples long, n_folds int, chosen boolean"
    )
    return Selected(Cascade({s: m for s, m in fitted.items() if s != "flat"}), fitted["flat"], scores)


def holdout_predictions(models: Selected, test: DataFrame, keep: tuple[str, ...] = ("run_id", "y"), features: str = "x") -> DataFrame:
    """keep + model (flat, cascade) + pred of every row of a shared holdout."""
    scored = models.cascade.score(models.flat.probabilities(test, "flat", features), features)
    gate = F.get("stage_probs", F.lit(0)) < models.cascade.healthy_threshold
    both = F.array(
        F.struct(F.lit("flat").alias("model"), top_label(F.col("flat")).alias("pred")),
        F.struct(F.lit("cascade").alias("model"), top_label(compose_probabilities(F.col("stage_probs"), gate)).alias("pred")),
    )
    return scored.select(*keep, F.explode(both).alias("m")).select(*keep, "m.*")


def slice_reports(predictions: DataFrame, slice_: str = "slice", label: str = "y") -> DataFrame:
    """(model, slice, n_samples, accuracy, macro_f1, ...) over full and each slice of a shared holdout."""
    rows = predictions.select("model", F.explode(F.array_compact(F.array(F.lit("full"), F.col(slice_)))).alias("slice"), F.col(label).alias("y_true"), "pred")
    return summary(confusion_cells(rows, ["model", "slice"]), ["model", "slice"])


def train_cascade(df: DataFrame, *, kind: str = "logistic", label: str = "y", features: str = "x", seed: int = 0, calibrate: str | None = None, columns: tuple[str, ...] | None = None, **options) -> Cascade:
    """Fit the four stages side by side on their own subsets of ``df`` (a stored table); ``columns`` names the features."""

    def one(stage: str) -> tuple[str, zoo.Scorer | None]:
        rows = stage_rows(df, stage, label)
        if rows.select("stage_y").distinct().count() < 2:
            return stage, None
        settings = dict(kind=kind, label="stage_y", features=features, seed=seed, columns=columns, **options)
        if calibrate:
            return stage, zoo.fit_calibrated(rows, STAGES[stage], method=calibrate, **settings)
        return stage, zoo.fit(rows, STAGES[stage], **settings)

    with ThreadPoolExecutor(zoo.PARALLEL_FITS) as pool:
        fitted = dict(pool.map(one, STAGES))
    return Cascade({s: m for s, m in fitted.items() if m is not None})


def save_cascade(cascade: Cascade, path: str) -> None:
    for name, model in cascade.stages.items():
        zoo.save(model, f"{path}/{name}", healthy_threshold=cascade.healthy_threshold)


def load_cascade(spark, path: str, stages: tuple[str, ...] = tuple(STAGES)) -> Cascade:
    """Load the stages that were saved; stage1 is required, others may be missing."""
    found, threshold = {}, 0.5
    for name in stages:
        try:
            found[name], settings = zoo.load(spark, f"{path}/{name}")
            threshold = settings.get("healthy_threshold", threshold)
        except Exception as e:  # a missing optional stage
            if name == "stage1" or "PATH_NOT_FOUND" not in str(e):
                raise
    return Cascade(found, threshold)


def oof_predictions(df: DataFrame, *, k: int = 5, kind: str = "logistic", label: str = "y", features: str = "x", seed: int = 0, gate: bool = False, **options) -> DataFrame:
    """run_id, y, fold, flat[6], cascade[6], stage_probs[9], all from models that did not see the row.

    ``gate`` applies the stage-1 gate as batch scoring does; without it all stages are composed.
    """
    folded = cut_lineage(assign_folds(df, label, k, seed))

    def one(i: int) -> DataFrame:
        train, test = folded.where(F.col("fold") != i), folded.where(F.col("fold") == i)
        flat = zoo.fit(train, CLASSES, kind=kind, label=label, features=features, seed=seed, **options)
        casc = train_cascade(train, kind=kind, label=label, features=features, seed=seed, **options)
        return casc.score(flat.probabilities(test, "flat", features), features)

    with ThreadPoolExecutor(zoo.PARALLEL_FITS) as pool:
        parts = list(pool.map(one, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    gate_col = (F.get("stage_probs", F.lit(0)) < 0.5) if gate else None
    return out.withColumn("cascade", compose_probabilities(F.col("stage_probs"), gate_col))


def check_oof(df: DataFrame, oof: DataFrame) -> DataFrame:
    """One row: rows expected, rows present, lost keys, duplicate keys, rows with a missing probability."""
    lost = df.select("run_id").join(oof, "run_id", "left_anti").agg(F.count(F.lit(1))).scalar()
    keys = oof.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1))).scalar()
    expected = df.agg(F.count(F.lit(1))).scalar()
    bad = F.exists("flat", lambda v: v.isNull()) | F.exists("cascade", lambda v: v.isNull())
    return oof.agg(F.count(F.lit(1)).alias("n_present"), F.count_if(bad).alias("n_incomplete")).withColumns(
        {"n_expected": expected, "n_lost": lost, "n_duplicate": keys}
    )


def fold_leaks(folded: DataFrame, key: str) -> DataFrame:
    """(key, n_folds) of values of ``key`` (an entry, a run) that lie in more than one fold, in one aggregation."""
    return folded.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("fold").alias("n_folds")).where("n_folds > 1")


# --- stacking ------------------------------------------------------------------------------------


@dataclass
class MetaModel:
    scorer: zoo.Scorer
    means: dict[str, float]
    cv_macro_f1: float

    def top_features(self, k: int = 3) -> list[tuple[str, float]]:
        return sorted(self.scorer.importances().items(), key=lambda e: -e[1])[:k]

    def predict(self, df: DataFrame, keep: tuple[str, ...] = ("run_id",), k: int = 3) -> DataFrame:
        """keep + stacked[6], final_label, final_confidence, top_features (the row's ``k`` largest importance x |value|)."""
        spark = df.sparkSession
        means = spark.createDataFrame([tuple(self.means[c] for c in META_FEATURES)], ", ".join(f"{c} double" for c in META_FEATURES))
        x = meta_features(df, keep, means).withColumn("x", F.array(*META_FEATURES)).select(*keep, "x")
        weights = self.scorer.importances()
        entries = F.array(*[
            F.struct((-F.abs(F.get("x", F.lit(i))) * F.lit(float(weights[c]))).alias("neg"), F.lit(i).alias("ord"), F.lit(c).alias("column"), F.get("x", F.lit(i)).alias("value"))
            for i, c in enumerate(META_FEATURES)
        ])
        top = F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["column"].alias("column"), e["value"].alias("value"), (-e["neg"]).alias("importance")))
        scored = self.scorer.probabilities(x.withColumn("top_features", top), "stacked").drop("x")
        return scored.withColumns({"final_label": top_label(F.col("stacked")), "final_confidence": F.array_max("stacked")})


def with_no_arbitrator(df: DataFrame) -> DataFrame:
    """Zeros for the arbitrator's columns (no external decisions)."""
    zeros = F.array(*[F.lit(0.0)] * len(CLASSES))
    return df.withColumns({"arbitrator": zeros, "arb_triggered": F.lit(0), "arb_confidence": F.lit(0.0)})


def train_meta(oof: DataFrame, *, kind: str = "logistic", k: int = 5, seed: int = 0, label: str = "y", drop: tuple[str, ...] = (), **options) -> MetaModel:
    """Meta model on out-of-fold meta features; ``drop`` removes features (ablation)."""
    feats = cut_lineage(meta_features(oof, ("run_id", label)))
    used = tuple(c for c in META_FEATURES if c not in drop)
    x = feats.withColumn("x", F.array(*[F.col(c) if c in used else F.lit(0.0) for c in META_FEATURES])).select("run_id", label, "x")
    _, means = zoo.select_model(x, CLASSES, (kind,), k=k, label=label, seed=seed, options={kind: options})
    scorer = zoo.fit(x, CLASSES, kind=kind, label=label, seed=seed, columns=META_FEATURES, **options)
    row = feats.agg(*[F.avg(c).alias(c) for c in META_FEATURES]).first()
    return MetaModel(scorer, {c: float(row[c]) for c in META_FEATURES}, float(means[0][1]))


def meta_oof(oof: DataFrame, *, kind: str = "logistic", k: int = 5, seed: int = 0, label: str = "y", **options) -> DataFrame:
    """run_id, y, p[6]: stacked probabilities from meta models that did not see the row (for calibration)."""
    x = cut_lineage(meta_features(oof, ("run_id", label)).select("run_id", label, F.array(*META_FEATURES).alias("x")))
    return zoo.out_of_fold(x, CLASSES, k=k, kind=kind, label=label, seed=seed, **options).drop("x", "fold")


# --- ablations -----------------------------------------------------------------------------------


def ablation(train: DataFrame, test: DataFrame, variants: dict[str, list[int]], *, kind: str = "logistic", label: str = "y", features: str = "x", seed: int = 0, **options) -> DataFrame:
    """(variant, n_features, n_samples, accuracy, macro_f1, leakage_f1) of the same trainer on feature subsets."""
    out = None
    for name, index in variants.items():
        x = F.array(*[F.get(features, F.lit(i)) for i in index])
        model = zoo.fit(train.withColumn("xs", x), CLASSES, kind=kind, label=label, features="xs", seed=seed, **options)
        pred = model.predict(test.withColumn("xs", x), features="xs").select(F.col(label).alias("y_true"), "pred")
        rep = summary(confusion_cells(pred.withColumn("variant", F.lit(name)), ["variant"]), ["variant"])
        rep = rep.withColumn("n_features", F.lit(len(index)))
        out = rep if out is None else out.unionByName(rep)
    return out


def ablation_verdict(reports: DataFrame, base: str, extended: str, margin: float = 0.01) -> DataFrame:
    """One row: change of macro-F1 and leakage F1 and whether the added block helps."""
    v = {(n, m): F.max(F.when(F.col("variant") == n, F.col(m))) for n in (base, extended) for m in ("macro_f1", "leakage_f1")}
    d = v[(extended, "macro_f1")] - v[(base, "macro_f1")]
    return reports.agg(
        d.alias("delta_macro_f1"),
        (v[(extended, "leakage_f1")] - v[(base, "leakage_f1")]).alias("delta_leakage_f1"),
        F.when(d > margin, "helps").when(d < -margin, "hurts").otherwise("no material change").alias("verdict"),
    )
