"""Sweeps over the stage-1 healthy threshold.

A row's decision changes at most once along the grid, so rows are reduced to counts per (truth,
decision on either side, number of thresholds passed); the grid is applied to those few counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.numeric import add_all
from runlens.functions.probs import top_label
from runlens.operators.cascade import compose_probabilities, hard_commit
from runlens.operators.metrics import COST_WEIGHTS, cost_columns, summary
from runlens.vocab import CLASSES, FAULTY, HEALTHY, LEAKAGE, STAGE1, to_stage1

# The candidate thresholds.
GRID = (0.50, 0.55, 0.60, 0.62, 0.65, 0.68, 0.70, 0.72, 0.75, 0.78, 0.80, 0.85, 0.90)


def _passed(p: Column, grid) -> Column:
    return add_all([(p >= F.lit(float(t))).cast("int") for t in grid])


def _spread(cells: DataFrame, grid, keep: list[str]) -> DataFrame:
    points = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(i).alias("i")) for i, t in enumerate(grid)])
    return cells.select(*keep, "k", "n", F.explode(points).alias("g")).select(
        *keep, "n", "g.threshold", (F.col("k") > F.col("g.i")).alias("healthy")
    )


def binary_sweep(df: DataFrame, by: list[str] | None = None, p: str = "p_healthy", grid=GRID, weights=COST_WEIGHTS) -> DataFrame:
    """Per (by, threshold): healthy/faulty report, error costs and leakage loss of the decision p >= t."""
    by = by or []
    sorted_grid = tuple(sorted(grid))
    cells = df.groupBy(*by, "y_true", _passed(F.col(p), sorted_grid).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    at = _spread(cells, sorted_grid, [*by, "y_true"]).withColumn("pred", F.when(F.col("healthy"), HEALTHY).otherwise(FAULTY))
    keys = [*by, "threshold"]
    binary = at.select(*keys, to_stage1(F.col("y_true"), strict=False).alias("y_true"), "pred", "n")
    binary = binary.groupBy(*keys, "y_true", "pred").agg(F.sum("n").alias("n"))
    rep = summary(binary, keys, STAGE1).drop("leakage_f1")
    n_l = F.sum(F.when(F.col("y_true") == LEAKAGE, F.col("n")).otherwise(0))
    n_h = F.sum(F.when(F.col("y_true") == HEALTHY, F.col("n")).otherwise(0))
    cost = at.groupBy(*keys).agg(
        *[c.alias(k) for k, c in cost_columns(weights).items()], n_l.alias("n_leakage"), n_h.alias("n_healthy")
    )
    one = F.lit(1)
    return rep.join(cost, keys).withColumns(
        {
            "leakage_recall_loss": F.col("leakage_to_healthy") / F.greatest(one, F.col("n_leakage")),
            "healthy_false_alarm": F.col("healthy_to_faulty") / F.greatest(one, F.col("n_healthy")),
        }
    )


def cascade_sweep(df: DataFrame, by: list[str] | None = None, stage: str = "stage_probs", grid=GRID, weights=COST_WEIGHTS, commit: bool = True) -> DataFrame:
    """Per (by, threshold): six-class report and error costs of the whole cascade."""
    by = by or []
    sorted_grid = tuple(sorted(grid))
    s = F.col(stage)
    healthy_pred = top_label(compose_probabilities(s, F.lit(False)))
    full = compose_probabilities(s, None)
    faulty_pred = top_label(hard_commit(full, F.lit(FAULTY)) if commit else full)
    cells = df.select(
        *by, "y_true", healthy_pred.alias("ph"), faulty_pred.alias("pf"), _passed(F.get(s, F.lit(0)), sorted_grid).alias("k")
    ).groupBy(*by, "y_true", "ph", "pf", "k").agg(F.count(F.lit(1)).alias("n"))
    at = _spread(cells, sorted_grid, [*by, "y_true", "ph", "pf"])
    keys = [*by, "threshold"]
    conf = at.groupBy(*keys, "y_true", F.when(F.col("healthy"), F.col("ph")).otherwise(F.col("pf")).alias("pred")).agg(
        F.sum("n").alias("n")
    )
    cost = conf.groupBy(*keys).agg(*[c.alias(k) for k, c in cost_columns(weights).items()])
    return summary(conf, keys, CLASSES).join(cost, keys)


def _first_best(sweep: DataFrame, score: Column, where: Column | None = None) -> Column:
    rows = F.struct(score.alias("s"), F.col("threshold").alias("t"))
    return F.min_by("threshold", rows if where is None else F.when(where, rows))


def choose_threshold(sweep: DataFrame, by: list[str] | None = None, max_false_alarm: float = 0.5, w_leak: float = 1.0, w_alarm: float = 1.0) -> DataFrame:
    """The chosen threshold per rule; the lowest one wins ties.

    min cost, max macro-F1, least leakage loss within the false-alarm limit (0.5 when none fits), least
    weighted cost.
    """
    feasible = F.col("healthy_false_alarm") <= max_false_alarm
    weighted = F.col("leakage_recall_loss") * w_leak + F.col("healthy_false_alarm") * w_alarm
    return sweep.groupBy(*(by or [])).agg(
        _first_best(sweep, F.col("total_cost")).alias("by_total_cost"),
        _first_best(sweep, -F.col("macro_f1")).alias("by_macro_f1"),
        F.coalesce(_first_best(sweep, F.col("leakage_recall_loss"), feasible), F.lit(0.5)).alias("by_leakage_loss"),
        _first_best(sweep, weighted).alias("by_weighted_cost"),
    )
