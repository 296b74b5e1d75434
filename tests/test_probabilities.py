import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.functions import probs
from runlens.operators import cascade, cleaning, conformal, metrics
from runlens.vocab import CLASSES, taxonomy, taxonomy_problems, to_stage1


def frame(spark, rows, cols="p array<double>"):
    floats = [(None if p is None else [None if v is None else float(v) for v in p],) for (p,) in rows]
    return spark.createDataFrame(floats, cols)


def test_normalise_is_per_row(spark):
    df = frame(spark, [([0.0] * 6,), ([2.0, 0, 0, 0, 0, -1.0],)])
    got = [r["q"] for r in df.select(probs.normalise(probs.items(F.col("p"), 6)).alias("q")).collect()]
    assert got[0] == pytest.approx([1 / 6] * 6) and got[1] == [1, 0, 0, 0, 0, 0]


def test_first_maximum_wins(spark):
    df = frame(spark, [([0.1, 0.4, 0.4, 0.1, 0.0, 0.0],)])
    assert df.select(probs.top_label(F.col("p")).alias("l")).first()["l"] == "overfitting"


def test_bin_edges(spark):
    df = spark.createDataFrame([(0.3,), (1.0,), (0.0,), (0.1,), (0.7,)], "c double")
    got = [r["b"] for r in df.select(metrics.confidence_bin(F.col("c")).alias("b")).collect()]
    edges = np.linspace(0, 1, 11)
    want = [min(9, int(np.searchsorted(edges, c, side="right")) - 1) for c in (0.3, 1.0, 0.0, 0.1, 0.7)]
    assert got == want and got[0] == 2


def test_cascade_zero_branch(spark):
    df = frame(spark, [([0.2, 0.8, 0.0, 0.0, 0.5, 0.5, 0.2, 0.3, 0.5],)])
    p = df.select(cascade.compose_probabilities(F.col("p"), None).alias("q")).first()["q"]
    assert p == pytest.approx([0.2, 0.16, 0.24, 0.0, 0.0, 0.4])


def test_probability_check(spark):
    df = frame(spark, [([1.0, 0, 0, 0, 0, 0],), ([0.9, 0, 0, 0, 0, 0],), ([None, 1.0, 0, 0, 0, 0],), (None,)])
    assert cleaning.invalid_probabilities(df).count() == 3


def test_taxonomy(spark):
    assert taxonomy_problems(taxonomy(spark)).count() == 0
    assert taxonomy_problems(taxonomy(spark).where("primary <> 'leakage'")).count() == 1
    with pytest.raises(Exception, match="unknown primary label"):
        spark.createDataFrame([("odd",)], "l string").select(to_stage1(F.col("l"))).collect()


@pytest.mark.parametrize("n", [0, 1, 5, 37, 200])
@pytest.mark.parametrize("alpha", [0.001, 0.05, 0.1])
def test_conformal_quantile(spark, n, alpha):
    s = np.random.default_rng(n).random(n)
    df = spark.createDataFrame([(float(v),) for v in s], "score double")
    got = conformal.calibrate(df, (alpha,)).first()
    if n == 0:
        assert got["quantile"] == 1.0 and got["n_calibration"] == 0
    else:
        level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)
        assert got["quantile"] == np.quantile(s, level, method="higher")


def test_conformal_coverage(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(700):
        y = int(rng.integers(6))
        a = np.ones(6)
        a[y] += 3
        rows.append((i, CLASSES[y], [float(v) for v in rng.dirichlet(a)]))
    df = spark.createDataFrame(rows, "i int, y_true string, p array<double>")
    cal = conformal.calibrate(conformal.scores(df.where("i < 500")), (0.1,))
    ev = conformal.evaluate(conformal.predict(df.where("i >= 500"), conformal.quantile_of(cal)), 0.1).first()
    assert ev["empirical_coverage"] >= 0.85 and ev["n_test"] == 200


def test_report_counts_unknown_labels(spark):
    rows = [("healthy", "healthy"), ("leakage", "healthy"), ("other", "other"), ("leakage", "leakage")]
    df = spark.createDataFrame(rows, "y_true string, pred string")
    s = metrics.summary(metrics.confusion_cells(df, []), []).first()
    assert s["accuracy"] == 0.75 and s["n_samples"] == 4
    assert s["macro_f1"] == pytest.approx((2 / 3 + 2 / 3) / 6)
