import json

import pytest
from pyspark.sql import functions as F

from runlens.sources import manifests, run_files, stores, trackers


@pytest.fixture(scope="module")
def fleet(tmp_path_factory):
    root = tmp_path_factory.mktemp("fleet")
    files = {
        "a": ("epoch,train_loss,val_loss,train_acc,val_acc\n1,2.0,2.1,0.1,0.2\n2,,nan,0.3,junk\n3,inf,1.0,0.5,0.6\n", {"run_id": "A", "labels": ["leakage", None], "dataset": "d1"}),
        "b": ('val_accuracy,"loss",epoch\n0.5,1.0,1\n\n0.6,0.9,2\n', {"label": "healthy", "config": {"t": {"dataset": "d2"}}, "severity": " Mild "}),
        "c": ("", {"label": 5}),
    }
    for name, (csv, meta) in files.items():
        (root / name).mkdir()
        (root / name / "history.csv").write_text(csv)
        (root / name / "meta.json").write_text(json.dumps(meta))
    manifest = {"corpus_id": "m", "entries": [{"entry_id": "e1", "run_ids": ["a"], "primary_label": "overfitting", "severity": "Severe", "fault_plan": ["x", "y"]}, {"entry_id": "e2", "run_ids": ["b", "c"]}]}
    (root / "corpus.manifest.json").write_text(json.dumps(manifest))
    return str(root)


def test_history_headers_differ_per_file(spark, fleet):
    h = run_files.parse_history(run_files.read_history_lines(spark, fleet))
    rows = {(manifest_name(r["run_dir"]), r["pos"]): r for r in h.collect()}
    assert len(rows) == 5
    assert rows[("a", 0)]["val_acc"] == 0.2 and rows[("b", 1)]["val_acc"] == 0.6
    assert rows[("b", 0)]["train_loss"] == 1.0 and rows[("b", 0)]["val_loss"] is None
    assert rows[("a", 1)]["train_loss"] != rows[("a", 1)]["train_loss"]  # blank is NaN, not absent
    assert rows[("a", 2)]["train_loss"] == float("inf")


def manifest_name(path):
    return path.rstrip("/").split("/")[-1]


def test_run_table_from_files(spark, fleet):
    meta = run_files.parse_meta(run_files.read_meta(spark, fleet))
    assert meta.where("error is not null").count() == 0
    docs = manifests.read_documents(spark, fleet)
    runs = manifests.parse_manifests(docs, strict=True)
    assert {r["run_key"] for r in runs.collect()} == {"a", "b", "c"}
    h = run_files.parse_history(run_files.read_history_lines(spark, fleet))
    sizes = h.groupBy("run_dir").agg(F.count(F.lit(1)).alias("n_history_rows"))
    table = run_files.load_runs(run_files.promote_meta(meta.where("error is null")), runs, sizes)
    good, bad = run_files.split_broken(table)
    got = {manifest_name(r["run_dir"]): r for r in good.collect()}
    assert set(got) == {"a", "b"} and bad.count() == 1
    assert got["a"]["run_id"] == "A" and got["a"]["primary_label"] == "overfitting" and got["a"]["severity"] == "severe" and got["a"]["is_multi_label"]
    assert got["b"]["dataset"] == "d2" and got["b"]["severity"] == "mild" and got["b"]["primary_label"] == "healthy"
    with pytest.raises(Exception, match="history is empty"):
        run_files.split_broken(table, skip_broken=False)[0].collect()


def test_directory_without_manifest(spark, fleet):
    found = manifests.runs_from_directory(manifests.list_files(spark, fleet)).collect()
    # Spark does not list empty files, so a run with an empty history has none.
    assert {r["run_key"] for r in found} == {"a", "b"}


def test_strict_manifest_fails(spark):
    docs = spark.createDataFrame([("/x", '{"runs": []}')], "corpus_path string, content string")
    with pytest.raises(Exception, match="non-empty"):
        manifests.parse_manifests(docs, strict=True).collect()


def test_user_map_wins(spark):
    m = spark.createDataFrame([("r", "loss"), ("r", "custom")], "run_id string, metric string")
    got = {r["column"]: r["metric"] for r in trackers.resolve_metrics(m, user_map={"train_loss": "custom"}).collect()}
    assert got == {"train_loss": "custom"}


def test_feature_adapter_needs_run_id(spark):
    with pytest.raises(ValueError):
        stores.adapt_features(spark.range(1), spark.range(1))
