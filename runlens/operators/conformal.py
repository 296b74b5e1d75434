"""Split-conformal prediction sets over class probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.ordering import exact_order_statistics, exact_quantiles
from runlens.functions.probs import let, prob_of, top_label, top_value
from runlens.session import cut_lineage
from runlens.vocab import CLASSES, labels_array

TOL = 1e-12


def scores(df: DataFrame, prob: str = "p", y: str = "y_true") -> DataFrame:
    """Add ``score`` = 1 - P(true class); 1.0 for a label outside the vocabulary."""
    return df.withColumn("score", F.lit(1.0) - F.coalesce(prob_of(F.col(prob), F.col(y)), F.lit(0.0)))


def _rank(alpha: float):
    """0-based rank of the finite-sample quantile: the level min(1, ceil((n+1)(1-a))/n), rounded up."""

    def rank(n: Column) -> Column:
        level = F.least(F.try_divide(F.ceil((n + 1) * F.lit(1.0 - alpha)), n), F.lit(1.0))
        return F.ceil(level * (n - 1))

    return rank


def calibrate(scored: DataFrame, alphas: tuple[float, ...] = (0.05,)) -> DataFrame:
    """(alpha, quantile, n_calibration), one row per alpha; quantile 1.0 without calibration rows.

    The exact order statistic comes from narrowing ranges of scores by counts, so the scores are
    never sorted in one task.
    """
    names = {f"a{i}": a for i, a in enumerate(alphas)}
    stats = exact_order_statistics(
        scored, [], "score", {k: _rank(a) for k, a in names.items()}
    )
    packed = stats.agg(
        *[F.coalesce(F.max(k), F.lit(1.0)).alias(k) for k in names], F.coalesce(F.max("n_values"), F.lit(0)).alias("n")
    )
    rows = F.array(
        *[F.struct(F.lit(float(a)).alias("alpha"), F.col(k).alias("quantile")) for k, a in names.items()]
    )
    return packed.select(F.explode(rows).alias("r"), "n").select(
        "r.alpha", "r.quantile", F.col("n").cast("long").alias("n_calibration")
    )


def score_summary(scored: DataFrame) -> DataFrame:
    """n, min, median, p95 and max of the nonconformity scores."""
    ends = scored.agg(F.count("score").alias("n"), F.min("score").alias("min"), F.max("score").alias("max"))
    mid = exact_quantiles(scored, [], "score", {"median": 0.5, "p95": 0.95})
    one = mid.select(F.struct("median", "p95").alias("m")).scalar()
    return ends.withColumn("m", one).select("n", "min", "m.median", "m.p95", "max")


def prediction_set(p: Column, quantile: Column) -> Column:
    """Labels with p >= 1 - q (tolerance 1e-12); the first maximum when none qualifies."""

    def chosen(a: Column) -> Column:
        inside = F.array_compact(
            F.array(*[F.when(F.get(a, F.lit(i)) >= F.lit(1.0) - quantile - TOL, F.lit(c)) for i, c in enumerate(CLASSES)])
        )
        return F.when(F.size(inside) > 0, inside).otherwise(F.array(top_label(a)))

    return let(p, chosen)


def predict(df: DataFrame, quantile: Column, prob: str = "p") -> DataFrame:
    """Add prediction_set, set_size, point_prediction, point_confidence, is_abstained, nonconformity."""
    p = F.col(prob)
    out = df.withColumn("_q", quantile)
    out = out.withColumn("prediction_set", prediction_set(p, F.col("_q"))).drop("_q")
    return out.withColumns(
        {
            "set_size": F.size("prediction_set"),
            "point_prediction": top_label(p),
            "point_confidence": top_value(p),
            "is_abstained": F.size("prediction_set") > 1,
            "nonconformity": F.lit(1.0) - top_value(p),
        }
    )


def quantile_of(calibration: DataFrame) -> Column:
    """The quantile of a one-row calibration table as a scalar subquery."""
    return calibration.select("quantile").scalar()


def _rates() -> list[Column]:
    hit = F.array_contains("prediction_set", F.col("y_true")).cast("double")
    abst = F.col("is_abstained")
    correct = (F.col("point_prediction") == F.col("y_true")).cast("double")
    return [
        F.count(F.lit(1)).alias("n_test"),
        F.avg(hit).alias("empirical_coverage"),
        F.avg(abst.cast("double")).alias("abstain_rate"),
        F.count_if(abst).alias("n_abstained"),
        F.count_if(~abst).alias("n_confident"),
        F.avg(F.when(~abst, correct)).alias("conditional_accuracy"),
        F.avg(F.col("set_size").cast("double")).alias("average_set_size"),
    ]


def evaluate(predicted: DataFrame, alpha: float) -> DataFrame:
    """One row: coverage, gap to the target, abstention, accuracy when confident, set size."""
    out = predicted.agg(*_rates())
    return out.withColumn("target_coverage", F.lit(1.0 - alpha)).withColumn(
        "coverage_gap", F.col("empirical_coverage") - F.col("target_coverage")
    )


def evaluate_by_class(predicted: DataFrame) -> DataFrame:
    """(class, n, coverage, abstain_rate) for every class of the vocabulary."""
    hit = F.array_contains("prediction_set", F.col("y_true")).cast("double")
    per = predicted.groupBy(F.col("y_true").alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("coverage"), F.avg(F.col("is_abstained").cast("double")).alias("abstain_rate")
    )
    vocab = predicted.sparkSession.range(1).select(F.explode(labels_array()).alias("class"))
    return vocab.join(per, "class", "left").fillna({"n": 0})


def alpha_sweep(calibration: DataFrame, test: DataFrame, alphas: tuple[float, ...], prob: str = "p") -> DataFrame:
    """Evaluation per alpha, from one pass over the test rows, each read once.

    A label enters the set where the quantile reaches 1 - p, so along the sorted quantiles a row is told by the places at which its
    labels enter. Rows with equal places are counted together, and the grid meets these counts, not the rows.
    """
    q = cut_lineage(calibrate(scores(calibration, prob), alphas))
    grid = q.agg(F.array_sort(F.collect_set("quantile"))).scalar()

    def entry(p: Column, grid: Column) -> Column:
        """How many quantiles are too small for a label of this probability."""
        return F.size(F.filter(grid, lambda x: ~(p >= F.lit(1.0) - x - TOL)))

    k = len(CLASSES)
    p = F.col(prob)
    rows = test.select("y_true", p.alias("p"), grid.alias("_grid"))
    own = F.array_position(labels_array(), F.col("y_true"))
    enter = F.transform("p", lambda x: entry(x, F.col("_grid")))
    told = rows.select(
        F.array_sort(enter).alias("enter"), F.coalesce(top_label(F.col("p")) == F.col("y_true"), F.lit(False)).alias("right"),
        F.when(own > 0, F.get(enter, (own - 1).cast("int"))).alias("own"),
    ).groupBy("enter", "right", "own").agg(F.count(F.lit(1)).alias("n"))
    placed = q.select("alpha", F.array_position(grid, F.col("quantile")).alias("at"))
    met = told.crossJoin(F.broadcast(placed))  # as many rows as alphas
    inside = F.size(F.filter("enter", lambda e: e < F.col("at")))
    # Nothing inside: the set is the first maximum.
    size = F.greatest(inside, F.lit(1))
    hit = F.when(inside == 0, F.col("right")).otherwise(F.coalesce(F.col("own") < F.col("at"), F.lit(False)))
    n, abstains = F.col("n"), size > 1
    total = F.sum("n")

    def share(where: Column) -> Column:
        return F.sum(F.when(where, n).otherwise(0)) / total

    sure = F.sum(F.when(~abstains, n))
    out = met.groupBy("alpha").agg(
        total.alias("n_test"), share(hit).alias("empirical_coverage"), share(abstains).alias("abstain_rate"),
        F.sum(F.when(abstains, n).otherwise(0)).alias("n_abstained"), F.sum(F.when(~abstains, n).otherwise(0)).alias("n_confident"),
        (F.sum(F.when(~abstains & F.col("right"), n).otherwise(0)) / sure).alias("conditional_accuracy"),
        (F.sum(n * size) / total).alias("average_set_size"),
    )
    return out.withColumn("target_coverage", F.lit(1.0) - F.col("alpha")).withColumn(
        "coverage_gap", F.col("empirical_coverage") - F.col("target_coverage")
    )


def level(n: int, alpha: float) -> float:
    """The clipped quantile level, for tests."""
    return 1.0 if n == 0 else min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)


__all__ = [
    "alpha_sweep", "calibrate", "evaluate", "evaluate_by_class", "level", "predict", "prediction_set", "quantile_of",
    "score_summary", "scores",
]
