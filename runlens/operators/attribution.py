"""Which stage caused an error, stage-wise reports, flat-versus-cascade comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.functions.numeric import ratio, ratio0
from runlens.operators.metrics import class_metrics, confusion_cells, summary
from runlens.operators.evidence import feature_evidence
from runlens.vocab import CLASSES, DATA, HEALTHY, LEAKAGE, OPTGEN, STAGE1, STAGE2, STAGE3_DATA, STAGE3_OPT, labels_array, to_stage1, to_stage2

STAGES = ("stage1", "stage2", "stage3", "composition")


def attribute_errors(diagnoses: DataFrame) -> DataFrame:
    """Add correct, stage_at_fault (null when correct) and the two critical flags. Needs y_true."""
    y, final = F.col("y_true"), F.col("final_class")
    s1, s2 = to_stage1(y, strict=False), to_stage2(y, strict=False)
    fault = (
        F.when(final == y, F.lit(None).cast("string"))
        .when(F.col("stage1_pred") != s1, "stage1")
        .when(s1 == HEALTHY, "composition")
        .when(~F.col("stage2_pred").eqNullSafe(s2), "stage2")
        .when(~F.col("stage3_pred").eqNullSafe(y), "stage3")
        .otherwise("composition")
    )
    return diagnoses.withColumns(
        {
            "correct": final == y,
            "stage_at_fault": fault,
            "is_leakage_to_healthy": (y == LEAKAGE) & (final == HEALTHY),
            "is_healthy_to_faulty": (y == HEALTHY) & (final != HEALTHY),
        }
    )


def attribution_summary(attributed: DataFrame) -> DataFrame:
    """(bucket, stage, n): all errors, errors per true class, and the two critical kinds, zero-filled."""
    errors = attributed.where("stage_at_fault is not null").groupBy(
        "y_true", "stage_at_fault", "is_leakage_to_healthy", "is_healthy_to_faulty"
    ).agg(F.count(F.lit(1)).alias("n"))
    buckets = F.array_compact(
        F.array(
            F.lit("all"),
            F.concat(F.lit("class:"), F.col("y_true")),
            F.when(F.col("is_leakage_to_healthy"), F.lit("leakage_to_healthy")),
            F.when(F.col("is_healthy_to_faulty"), F.lit("healthy_to_faulty")),
        )
    )
    counts = errors.select(F.explode(buckets).alias("bucket"), F.col("stage_at_fault").alias("stage"), "n").groupBy("bucket", "stage").agg(F.sum("n").alias("n"))
    names = ["all", *[f"class:{c}" for c in CLASSES], "leakage_to_healthy", "healthy_to_faulty"]
    grid = attributed.sparkSession.range(1).select(F.explode(labels_array(names)).alias("bucket")).select(
        "bucket", F.explode(labels_array(STAGES)).alias("stage")
    )
    return grid.join(counts, ["bucket", "stage"], "left").fillna({"n": 0})


def disagreements(
    diagnoses: DataFrame, flat: DataFrame, features: DataFrame | None = None, importances: dict[str, dict[str, float]] | None = None, k: int = 5
) -> DataFrame:
    """Rows where the contours differ and exactly one is right, with the winner.

    With ``features`` (run_id and the models' columns) and the fitted stages' ``importances`` each row has stage 1's ``top_evidence``.
    """
    j = diagnoses.join(flat.select("run_id", "flat_label"), "run_id")
    f, c = F.col("flat_label") == F.col("y_true"), F.col("final_class") == F.col("y_true")
    found = j.where((F.col("flat_label") != F.col("final_class")) & (f != c))
    extra = []
    if features is not None and importances:
        weights = {"stage1": importances["stage1"]}
        found = found.join(features.select("run_id", feature_evidence(weights, k).alias("top_evidence")), "run_id", "left")
        extra = ["top_evidence"]
    return found.select(
        "run_id", "y_true", "flat_label", F.col("final_class").alias("cascade_label"),
        F.when(f, "flat").otherwise("cascade").alias("winner"), "stage1_pred", "stage2_pred", "stage3_pred", *extra,
    )


def stage_reports(diagnoses: DataFrame) -> DataFrame:
    """(stage, class, precision, recall, f1, support) and accuracy per stage; a stage not run counts as wrong."""
    y = F.col("y_true")
    faulty, branch = to_stage1(y, strict=False) != HEALTHY, to_stage2(y, strict=False)
    no2 = F.coalesce("stage2_pred", F.lit("<no_stage2>"))
    no3 = F.coalesce("stage3_pred", F.lit("<no_stage3>"))
    parts = F.array_compact(
        F.array(
            F.struct(F.lit("stage1").alias("stage"), to_stage1(y, strict=False).alias("y_true"), F.col("stage1_pred").alias("pred")),
            F.when(faulty, F.struct(F.lit("stage2").alias("stage"), branch.alias("y_true"), no2.alias("pred"))),
            F.when(branch == DATA, F.struct(F.lit(f"stage3_{DATA}").alias("stage"), y.alias("y_true"), no3.alias("pred"))),
            F.when(branch == OPTGEN, F.struct(F.lit(f"stage3_{OPTGEN}").alias("stage"), y.alias("y_true"), no3.alias("pred"))),
        )
    )
    cells = confusion_cells(diagnoses.select(F.explode(parts).alias("p")).select("p.*"), ["stage"])
    vocabulary = (("stage1", STAGE1), ("stage2", STAGE2), (f"stage3_{DATA}", STAGE3_DATA), (f"stage3_{OPTGEN}", STAGE3_OPT))
    labels = F.lit(None).cast("array<string>")
    for stage, names in vocabulary:
        labels = F.when(F.col("stage") == stage, F.array(*map(F.lit, names))).otherwise(labels)

    def total(chosen) -> Column:
        return F.aggregate(F.filter("cells", chosen), F.lit(0).cast("long"), lambda acc, c: acc + c["n"])

    # One row per stage with its few cells; everything else is arithmetic on them.
    per = cells.groupBy("stage").agg(F.collect_list(F.struct("y_true", "pred", "n")).alias("cells"))
    hits = total(lambda c: c["y_true"].eqNullSafe(c["pred"]))
    rows = per.select("stage", "cells", ratio0(hits, total(lambda c: F.lit(True))).alias("accuracy"), F.explode(labels).alias("class"))
    name = F.col("class")
    counted = rows.select(
        "stage", "class", "accuracy", total(lambda c: c["y_true"].eqNullSafe(name)).alias("support"),
        total(lambda c: c["pred"].eqNullSafe(name)).alias("predicted"),
        total(lambda c: c["y_true"].eqNullSafe(name) & c["pred"].eqNullSafe(name)).alias("tp"),
    )
    f1 = ratio0(F.lit(2) * F.col("tp"), F.col("support") + F.col("predicted"))
    scored = counted.select(
        "stage", "class", ratio0(F.col("tp"), F.col("predicted")).alias("precision"), ratio0(F.col("tp"), F.col("support")).alias("recall"),
        f1.alias("f1"), "support", "accuracy",
    )
    # A stage has six classes at most.
    return scored.withColumn("macro_f1", F.avg("f1").over(W.partitionBy("stage")))


def error_propagation(diagnoses: DataFrame) -> DataFrame:
    """One row: accuracies along the cascade."""
    y = F.col("y_true")
    s1 = F.col("stage1_pred") == to_stage1(y, strict=False)
    s2, s3 = F.col("stage2_pred").eqNullSafe(to_stage2(y, strict=False)), F.col("stage3_pred").eqNullSafe(F.when(y != HEALTHY, y))
    final = F.col("final_class") == y

    def rate(cond, where=None):
        x = cond.cast("double")
        return F.avg(x if where is None else F.when(where, x))

    return diagnoses.agg(
        F.count(F.lit(1)).alias("n"),
        rate(s1).alias("stage1_acc"),
        rate(s2, F.col("stage2_pred").isNotNull()).alias("stage2_acc_given_eligible"),
        rate(s3, F.col("stage3_pred").isNotNull()).alias("stage3_acc_given_eligible"),
        F.count_if(s1 & ~final).alias("stage1_only_correct_but_final_wrong"),
        F.count_if(~s1).alias("stage1_wrong_runs"),
        rate(final).alias("final_acc"),
    )


def long_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, class, metric, value) with class '' for overall metrics; rows carry y_true and pred."""
    cells = confusion_cells(df, by)
    s = summary(cells, by).select(
        *by, F.lit("").alias("class"),
        F.explode(F.create_map(*[x for m in ("accuracy", "macro_f1", "weighted_f1") for x in (F.lit(m), F.col(m))])).alias("metric", "value"),
    )
    c = class_metrics(cells, by).select(*by, "class", F.lit("f1").alias("metric"), F.col("f1").alias("value"))
    return s.unionByName(c)


def metric_deltas(long: DataFrame, by: list[str], base: str = "flat", other: str = "cascade") -> DataFrame:
    """other - base per (by, class, metric) of a long table that has a ``contour`` column."""
    v = {n: F.max(F.when(F.col("contour") == n, F.col("value"))) for n in (base, other)}
    return long.groupBy(*by, "class", "metric").agg(v[base].alias(base), v[other].alias(other)).withColumn(
        "delta", F.col(other) - F.col(base)
    )


def contours(df: DataFrame, keep: list[str], labels: dict[str, str]) -> DataFrame:
    """(keep, y_true, contour, pred): one row per contour label column."""
    rows = F.array(*[F.struct(F.lit(n).alias("contour"), F.col(c).alias("pred")) for n, c in labels.items()])
    return df.select(*keep, "y_true", F.explode(rows).alias("r")).select(*keep, "y_true", "r.contour", "r.pred")


def agreement_analysis(df: DataFrame, by: list[str]) -> DataFrame:
    """Agreement rate and accuracies on agreement / disagreement; needs final_label and both contour labels."""
    y, agree = F.col("y_true"), F.col("flat_label") == F.col("cascade_label")

    def acc(label, where):
        return F.avg(F.when(where, (F.col(label) == y).cast("double")))

    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(agree).alias("n_agreement"),
        F.count_if(~agree).alias("n_disagreement"),
        ratio(F.count_if(agree), F.count(F.lit(1))).alias("agreement_rate"),
        acc("final_label", agree).alias("accuracy_on_agreement"),
        acc("flat_label", ~agree).alias("flat_accuracy_on_disagreement"),
        acc("cascade_label", ~agree).alias("cascade_accuracy_on_disagreement"),
        acc("final_label", ~agree).alias("hybrid_accuracy_on_disagreement"),
    )


def path_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "resolution_path").agg(F.count(F.lit(1)).alias("n"))


def disagreement_pool(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, pi, accuracy, envelope_low, envelope_high, inside): how often the truth is one of the two labels."""
    pool = df.where((F.col("flat_label") != F.col("cascade_label")) & F.col("arb_label").isNotNull())
    hit = F.col("y_true").isin(F.col("flat_label"), F.col("cascade_label")).cast("double")
    pi, acc = F.avg(hit), F.avg((F.col("arb_label") == F.col("y_true")).cast("double"))
    return pool.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pi.alias("pi"), acc.alias("accuracy")).withColumns(
        {
            "envelope_low": F.col("pi") / 2,
            "envelope_high": F.col("pi"),
            "inside": (F.col("accuracy") >= F.col("pi") / 2) & (F.col("accuracy") <= F.col("pi")),
        }
    )


def noise_robustness(df: DataFrame, sigmas: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2), seed: int = 0) -> DataFrame:
    """(sigma, n_disagreement, pi, envelope) after softmax(p + sigma * normal noise) on both contours.

    Noise comes from a digest of (run, contour, class, sigma, seed), so a recomputed task, or another engine, repeats it.
    """
    from runlens.functions.probs import items, softmax, top_label

    def uniform(tag: str, i: int, salt: int):
        name = F.concat_ws("|", "run_id", F.lit(f"{tag}|{i}|{seed}|{salt}"), F.round(F.col("sigma") * 1e6).cast("long").cast("string"))
        # 52 bits of the digest: a double holds them exactly.
        return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)

    def noisy(col: str):
        z = [
            F.sqrt(-2.0 * F.log(uniform(col, i, 1))) * F.cos(uniform(col, i, 2) * 6.283185307179586) for i in range(6)
        ]
        return softmax([p + F.col("sigma") * n for p, n in zip(items(F.col(col), 6), z)])

    grid = df.select("run_id", "y_true", "flat", "cascade", F.explode(F.array(*[F.lit(float(s)) for s in (0.0, *sigmas)])).alias("sigma"))
    zero = F.col("sigma") == 0
    lab = grid.select(
        "sigma", "y_true",
        top_label(F.when(zero, F.col("flat")).otherwise(noisy("flat"))).alias("f"),
        top_label(F.when(zero, F.col("cascade")).otherwise(noisy("cascade"))).alias("c"),
    )
    off = F.col("f") != F.col("c")
    return lab.groupBy("sigma").agg(
        F.count_if(off).alias("n_disagreement"),
        F.avg(F.when(off, F.col("y_true").isin(F.col("f"), F.col("c")).cast("double"))).alias("pi"),
    ).withColumns({"envelope_low": F.col("pi") / 2, "envelope_high": F.col("pi")})
