"""Classification metrics and calibration, computed from small count tables.

Every metric first reduces the rows to counts over (group, truth, prediction) or (group, bin); that
step combines map-side and is the only one whose work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.numeric import add_all, ratio, ratio0
from runlens.functions.probs import items, top_label, top_value
from runlens.vocab import CLASSES, HEALTHY, LABEL_NOISE, LEAKAGE, labels_array

N_BINS = 10


def confusion_cells(df: DataFrame, by: list[str], y: str = "y_true", pred: str = "pred", weight: str | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*by, F.col(y).alias("y_true"), F.col(pred).alias("pred")).agg(n.alias("n"))


def _grid(cells: DataFrame, by: list[str], labels, name: str) -> DataFrame:
    groups = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()
    return groups.select(*by, F.explode(labels_array(labels)).alias(name))


def confusion_matrix(cells: DataFrame, by: list[str], labels=CLASSES) -> DataFrame:
    """Zero-filled counts over labels x labels per group."""
    g = _grid(cells, by, labels, "y_true").withColumn("pred", F.explode(labels_array(labels)))
    return g.join(cells, [*by, "y_true", "pred"], "left").fillna({"n": 0})


def class_metrics(cells: DataFrame, by: list[str], labels=CLASSES) -> DataFrame:
    """(by, class, precision, recall, f1, support); zero where a denominator is zero."""
    n, hit = F.col("n"), F.col("y_true").eqNullSafe(F.col("pred"))
    parts = F.array(
        F.struct(F.col("y_true").alias("class"), n.alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(hit, n).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("support"), n.alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )
    sums = cells.select(*by, F.explode(parts).alias("q")).select(*by, "q.*").groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    out = _grid(cells, by, labels, "class").join(sums, [*by, "class"], "left").fillna(
        {"support": 0, "predicted": 0, "tp": 0}
    )
    p, r = ratio0(F.col("tp"), F.col("predicted")), ratio0(F.col("tp"), F.col("support"))
    f1 = ratio0(F.lit(2) * F.col("tp"), F.col("support") + F.col("predicted"))
    return out.select(*by, "class", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support")


def summary(cells: DataFrame, by: list[str], labels=CLASSES) -> DataFrame:
    """(by, n_samples, accuracy, macro_f1, weighted_f1). Accuracy also counts rows outside the labels."""
    hit = F.col("y_true").eqNullSafe(F.col("pred"))
    acc = cells.groupBy(*by).agg(
        F.sum("n").alias("n_samples"), ratio0(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy")
    )
    f = class_metrics(cells, by, labels).groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        ratio0(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.max(F.when(F.col("class") == LEAKAGE, F.col("f1"))).alias("leakage_f1"),
    )
    if not by:
        one = f.select(F.struct(*f.columns).alias("o")).scalar()
        return acc.withColumn("o", one).select("n_samples", "accuracy", "o.macro_f1", "o.weighted_f1", "o.leakage_f1")
    return acc.join(f, by)


# --- calibration ---------------------------------------------------------------------------------


def confidence_bin(conf: Column, n_bins: int = N_BINS) -> Column:
    """Bin by comparison with the edges i/n (computed as i * (1/n)); the last bin is closed."""
    step = 1.0 / n_bins
    return add_all([(conf >= F.lit(i * step)).cast("int") for i in range(1, n_bins)])


def bin_table(df: DataFrame, by: list[str], conf: str = "confidence", correct: str = "correct", n_bins: int = N_BINS) -> DataFrame:
    """(by, bin, n, sum_conf, sum_correct) for confidences in [0, 1]."""
    c = F.col(conf)
    used = df.where((c >= 0) & (c <= 1))
    return used.groupBy(*by, confidence_bin(c, n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(c).alias("sum_conf"), F.sum(F.col(correct).cast("double")).alias("sum_correct")
    )


def calibration_errors(bins: DataFrame, by: list[str]) -> DataFrame:
    """(by, ece, mce)."""
    gap = F.abs(F.col("sum_conf") / F.col("n") - F.col("sum_correct") / F.col("n"))
    return bins.groupBy(*by).agg(
        ratio(F.sum(gap * F.col("n")), F.sum("n")).alias("ece"), F.coalesce(F.max(gap), F.lit(0.0)).alias("mce")
    )


def reliability(bins: DataFrame, by: list[str], n_bins: int = N_BINS) -> DataFrame:
    """All bins per group with centre, mean confidence, accuracy and count; empty bins get defaults."""
    step = 1.0 / n_bins
    groups = bins.select(*by).distinct() if by else bins.sparkSession.range(1).select()
    g = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    upper = F.when(F.col("bin") == n_bins - 1, F.lit(1.0)).otherwise((F.col("bin") + 1) * F.lit(step))
    centre = (F.col("bin") * F.lit(step) + upper) / 2
    j = g.join(bins, [*by, "bin"], "left").fillna({"n": 0})
    return j.select(
        *by,
        "bin",
        centre.alias("bin_center"),
        F.coalesce(F.try_divide("sum_conf", "n"), centre).alias("bin_confidence"),
        F.coalesce(F.try_divide("sum_correct", "n"), F.lit(0.0)).alias("bin_accuracy"),
        F.col("n").alias("bin_count"),
    )


def brier_term(p: Column, y: Column, labels=CLASSES) -> Column:
    """Sum of squared differences to the one-hot truth (a label outside the vocabulary is all zero)."""
    return add_all(
        [
            (v - (F.coalesce(y == c, F.lit(False))).cast("double")) * (v - (F.coalesce(y == c, F.lit(False))).cast("double"))
            for v, c in zip(items(p, len(labels)), labels)
        ]
    )


def calibration_report(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_used, accuracy, ece, mce, brier) from rows with y_true and p[6]."""
    rows = long.select(
        *by,
        (top_label(F.col("p")) == F.col("y_true")).alias("correct"),
        top_value(F.col("p")).alias("confidence"),
        brier_term(F.col("p"), F.col("y_true")).alias("b"),
    )
    flat = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_used"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("b").alias("brier")
    )
    return flat.join(calibration_errors(bin_table(rows, by), by), by)


def policy_probabilities(df: DataFrame) -> DataFrame:
    """(policy, y_true, p): flat and cascade for every row, the arbitrator only where it was triggered."""
    rows = F.array_compact(
        F.array(
            F.struct(F.lit("flat").alias("policy"), F.col("flat").alias("p")),
            F.struct(F.lit("cascade").alias("policy"), F.col("cascade").alias("p")),
            F.when(F.col("arb_triggered") == 1, F.struct(F.lit("arbitrator").alias("policy"), F.col("arbitrator").alias("p"))),
        )
    )
    return df.select("y_true", F.explode(rows).alias("r")).select("y_true", "r.policy", "r.p")


# --- named error counts --------------------------------------------------------------------------


def leakage_healthy(df: DataFrame, by: list[str]) -> DataFrame:
    """Leakage called healthy and healthy called leakage, with rates (null without such runs)."""
    y, p = F.col("y_true"), F.col("pred")
    l2h, h2l = F.count_if((y == LEAKAGE) & (p == HEALTHY)), F.count_if((y == HEALTHY) & (p == LEAKAGE))
    n_l, n_h = F.count_if(y == LEAKAGE), F.count_if(y == HEALTHY)
    return df.groupBy(*by).agg(
        l2h.alias("leakage_called_healthy"),
        h2l.alias("healthy_called_leakage"),
        F.count_if((y == HEALTHY) & (p != HEALTHY)).alias("healthy_called_faulty"),
        n_l.alias("n_leakage"),
        n_h.alias("n_healthy"),
        ratio(l2h, n_l).alias("leakage_recall_loss_to_healthy"),
        ratio(h2l, n_h).alias("healthy_false_alarm_to_leakage"),
    )


# Cost of each kind of error.
COST_WEIGHTS = {
    "leakage_to_healthy": 3.0,
    "label_noise_to_healthy": 2.0,
    "other_faulty_to_healthy": 1.5,
    "healthy_to_faulty": 1.0,
}


def cost_columns(weights: dict[str, float] = COST_WEIGHTS) -> dict[str, Column]:
    """Aggregates over rows (y_true, pred, n): the four error counts and their weighted sum."""
    y, p, n = F.col("y_true"), F.col("pred"), F.col("n")
    to_h = p == HEALTHY

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n).otherwise(0)), F.lit(0))

    counts = {
        "leakage_to_healthy": total((y == LEAKAGE) & to_h),
        "label_noise_to_healthy": total((y == LABEL_NOISE) & to_h),
        "other_faulty_to_healthy": total(~y.isin(HEALTHY, LEAKAGE, LABEL_NOISE) & to_h),
        "healthy_to_faulty": total((y == HEALTHY) & ~to_h),
    }
    return {**counts, "total_cost": add_all([counts[k].cast("double") * F.lit(weights[k]) for k in counts])}


def error_cost(cells: DataFrame, by: list[str], weights: dict[str, float] = COST_WEIGHTS) -> DataFrame:
    return cells.groupBy(*by).agg(*[c.alias(k) for k, c in cost_columns(weights).items()])
