"""Whole groups in folds, winners of stages, features of fitted stages."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runlens.operators import evidence, training
from runlens.operators.folds import group_folds, group_holdout
from runlens.operators.stacking import META_FEATURES
from runlens.vocab import CLASSES

ROWS = "run_id string, entry string, y string, x array<double>, slice string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(900):
        c = rng.randrange(6)
        # One entry holds a third of all rows, another has no name.
        entry = "hot" if rng.random() < 0.33 else None if rng.random() < 0.05 else f"e{rng.randrange(150)}"
        out.append((f"r{i}", entry, CLASSES[c], [float(c == k) + rng.gauss(0, 0.4) for k in range(6)], "core" if i % 3 else "extended"))
    return spark.createDataFrame(out, ROWS).repartition(4)


def test_groups_stay_whole_and_labels_even(rows):
    got = group_folds(rows, "entry", "y").select("run_id", "entry", "y", "fold").collect()
    assert len(got) == 900 and all(0 <= r["fold"] < 5 for r in got)
    folds_of = {}
    for r in got:
        folds_of.setdefault(r["entry"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in folds_of.values())
    hot = folds_of["hot"].pop()
    rest = Counter(r["fold"] for r in got if r["fold"] != hot)
    assert max(rest.values()) < 1.6 * min(rest.values())
    train, test = group_holdout(rows, "entry", "y")
    assert train.count() + test.count() == 900
    assert train.join(test.select("entry").distinct(), F.expr("1 = 1") & train["entry"].eqNullSafe(test["entry"])).count() == 0


def test_winners_are_refitted_and_judged_on_slices(rows):
    train, test = rows.where("run_id < 'r7'"), rows.where("run_id >= 'r7'")
    options = {"boosted": {"rounds": 2, "rate": 0.5}, "entropy_tree": {"depth": 1}}
    models = training.select_models(train, ("entropy_tree", "boosted"), k=2, options=options, columns=tuple("abcdef"))
    scores = models.scores.collect()
    n = train.count()
    for stage in ("flat", *training.STAGES):
        mine = [r for r in scores if r["stage"] == stage]
        best = max(mine, key=lambda r: r["macro_f1"])
        assert len(mine) == 2 and [r["kind"] for r in mine if r["chosen"]] == [best["kind"]]
        assert {r["n_folds"] for r in mine} == {2}
    assert {r["n_samples"] for r in scores if r["stage"] in ("flat", "stage1")} == {n}
    assert set(models.cascade.importances()) == set(training.STAGES) and set(models.flat.importances()) == set("abcdef")
    rep = {(r["model"], r["slice"]): r for r in training.slice_reports(training.holdout_predictions(models, test, ("run_id", "y", "slice"))).collect()}
    for model in ("flat", "cascade"):
        assert rep[model, "full"]["n_samples"] == rep[model, "core"]["n_samples"] + rep[model, "extended"]["n_samples"] == test.count()
        assert rep[model, "full"]["accuracy"] > 0.5


def test_features_of_fitted_stages(spark):
    table = spark.createDataFrame([("r1", 2.0, -3.0, None), ("r2", 0.0, 0.0, 0.0)], "run_id string, a double, b double, c double")
    top = evidence.feature_evidence({"stage1": {"a": 0.5, "b": 0.2, "c": 0.9}, "stage2": {"b": 1.0}}, 2)
    got = {r["run_id"]: [tuple(x) for x in r["top"]] for r in table.select("run_id", top.alias("top")).collect()}
    assert got["r1"] == [("stage1", "a", 2.0, 1.0), ("stage1", "b", -3.0, pytest.approx(0.6)), ("stage2", "b", -3.0, 3.0)]
    # Nothing weighs anything: the importances decide.
    assert got["r2"] == [("stage1", "c", 0.0, 0.9), ("stage1", "a", 0.0, 0.5), ("stage2", "b", 0.0, 1.0)]


def test_boosted_meta_model_scores_rows_it_did_not_see(spark):
    rng = random.Random(9)
    out = []
    for i in range(240):
        c = rng.randrange(6)
        p = [0.5 if k == c else 0.1 for k in range(6)]
        noise = rng.randrange(6)
        out.append((f"r{i}", CLASSES[c], i % 4, p, [0.5 if k == noise else 0.1 for k in range(6)], [0.5] * 9))
    oof = training.with_no_arbitrator(spark.createDataFrame(out, "run_id string, y string, fold int, flat array<double>, cascade array<double>, stage_probs array<double>"))
    meta = training.train_meta(oof.where("fold < 3"), kind="boosted", k=2, rounds=3, rate=0.5)
    got = meta.predict(oof.where("fold = 3"), ("run_id", "y")).collect()
    assert len(got) == 60 and sum(r["final_label"] == r["y"] for r in got) > 50
    assert all(len(r["top_features"]) == 3 and r["top_features"][0]["column"] in META_FEATURES for r in got)
