import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import cascade, training, zoo
from runlens.operators.folds import assign_folds, holdout
from runlens.operators.stacking import META_FEATURES, meta_features
from runlens.session import cut_lineage
from runlens.vocab import CLASSES


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        c = i % 6
        x = rng.normal(size=8) * 0.5
        x[c] += 3
        rows.append((f"r{i}", CLASSES[c], [float(v) for v in x]))
    return cut_lineage(spark.createDataFrame(rows, "run_id string, y string, x array<double>"))


def test_folds_are_stratified(data):
    sizes = assign_folds(data, "y", 5).groupBy("y", "fold").count().collect()
    assert len(sizes) == 30 and {r["count"] for r in sizes} == {8}
    train, test = holdout(data, "y")
    assert train.count() == 192 and test.count() == 48


@pytest.mark.parametrize("kind,options", [("logistic", {}), ("random_forest", {"trees": 15, "depth": 5}), ("boosted", {"rounds": 3}), ("entropy_tree", {})])
def test_models_learn(data, kind, options):
    train, test = (cut_lineage(p) for p in holdout(data, "y"))
    model = zoo.fit(train, CLASSES, kind=kind, **options)
    acc = model.predict(test).agg(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0]
    assert acc > 0.85
    assert len(model.importances()) == 8
    sums = model.probabilities(test).select(F.aggregate("p", F.lit(0.0), lambda a, v: a + v).alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in sums)


def test_cascade_round_trip(spark, data, tmp_path):
    fitted = training.train_cascade(data, kind="entropy_tree", depth=4)
    assert set(fitted.stages) == set(training.STAGES)
    del fitted.stages["stage3_data"]
    training.save_cascade(fitted, str(tmp_path / "c"))
    loaded = training.load_cascade(spark, str(tmp_path / "c"))
    assert set(loaded.stages) == set(fitted.stages)
    a, b = (cascade.flatten(cascade.diagnose(m.score(data))).orderBy("run_id").collect() for m in (fitted, loaded))
    assert a == b
    right = cascade.diagnose(training.train_cascade(data, kind="entropy_tree", depth=4).score(data))
    assert right.agg(F.avg((F.col("final_class") == F.col("y")).cast("double"))).first()[0] > 0.8


def test_oof_and_meta_features(data):
    oof = cut_lineage(training.with_no_arbitrator(training.oof_predictions(data, k=2, kind="entropy_tree", depth=3)))
    check = training.check_oof(data, oof).first()
    assert check["n_present"] == 240 and check["n_lost"] == check["n_duplicate"] == check["n_incomplete"] == 0
    m = meta_features(oof)
    assert m.columns == ["run_id", *META_FEATURES] and len(META_FEATURES) == 33
    nulls = m.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in META_FEATURES]).first()
    assert not any(nulls)
