import numpy as np
import pytest

from runlens.operators import resample
from runlens.vocab import CLASSES


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = []
    for i in range(400):
        y = CLASSES[rng.integers(6)]
        a = y if rng.random() < 0.6 else CLASSES[rng.integers(6)]
        b = y if rng.random() < 0.9 else CLASSES[rng.integers(6)]
        out.append((i % 40 if i > 130 else 0, y, a, b))
    return spark.createDataFrame(out, "g int, y_true string, pred_a string, pred_b string")


def test_interval_contains_point(rows):
    for metric in ("macro_f1", "weighted_f1", "accuracy"):
        r = resample.metric_interval(rows, metric=metric, pred="pred_a", n_bootstrap=200).first()
        assert r["ci_low"] <= r["point_estimate"] <= r["ci_high"] and r["n"] == 400


def test_better_model_is_found(rows):
    r = resample.delta_interval(rows, metric="accuracy", n_bootstrap=200, n_comparisons=2).first()
    assert r["delta_ci_low"] > 0 and r["p_b_better"] == 1.0 and r["significant"] and r["cohen_h"] > 0
    assert r["alpha_bonferroni"] == 0.025


def test_same_predictions_give_zero(rows):
    r = resample.delta_interval(rows, a="pred_a", b="pred_a", n_bootstrap=100).first()
    assert r["delta_point"] == r["delta_ci_low"] == r["delta_ci_high"] == 0 and r["p_b_better"] == 0


def test_grouped(rows):
    r = resample.grouped_delta_interval(rows, "g", n_bootstrap=100).first()
    assert r["n_groups"] == 40 and r["delta_ci_low"] <= r["delta_point"] <= r["delta_ci_high"]
    again = resample.grouped_delta_interval(rows, "g", n_bootstrap=100).first()
    assert r == again


def test_rows_without_group_are_one_group(rows):
    from pyspark.sql import functions as F

    some = rows.withColumn("g", F.when(F.col("g") != 3, F.col("g")))
    r = resample.grouped_delta_interval(some, "g", n_bootstrap=60).first()
    assert r["n_groups"] == 40 and r["n"] == 400 and r["delta_ci_low"] <= r["delta_point"] <= r["delta_ci_high"]
    none = resample.grouped_delta_interval(rows.withColumn("g", F.lit(None).cast("int")), "g", n_bootstrap=20).first()
    assert none["n_groups"] == 1 and none["delta_ci_low"] == pytest.approx(none["delta_point"])


def test_draws_are_the_multinomial_over_groups(spark):
    """Each of 64 groups is one row; drawn rows have the mean and spread of draws with replacement."""
    df = spark.createDataFrame([(i, CLASSES[0], CLASSES[0], CLASSES[i % 2]) for i in range(64)], "g int, y_true string, pred_a string, pred_b string")
    r = resample.grouped_delta_interval(df, "g", metric="accuracy", n_bootstrap=800).first()
    assert r["delta_point"] == pytest.approx(-0.5)
    half = 1.96 * np.sqrt(0.25 / 64)
    assert r["delta_ci_low"] == pytest.approx(-0.5 - half, abs=0.04) and r["delta_ci_high"] == pytest.approx(-0.5 + half, abs=0.04)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.999), ("b", 0.98), ("c", 0.90), ("d", 0.995)], "comparison string, p_b_better double")
    got = {r["comparison"]: r for r in resample.holm(df).collect()}
    assert [got[c]["rank"] for c in "adbc"] == [1, 2, 3, 4]
    assert [got[c]["significant"] for c in "adbc"] == [True, True, True, False]
