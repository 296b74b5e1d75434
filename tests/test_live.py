"""Live runs: curve states against the batch features, late and repeated epochs, state that goes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import linear_stages
from runlens.operators.curves import CURVES, curve_features
from runlens.plans import REGISTRY
from runlens.plans.live_queries import WEIGHTS
from runlens.sources.driver_tables import Tables
from runlens.streaming import live
from runlens.streaming.curve_state import LIVE_FEATURES, CurveSummary, closed_runs

HOUR = 3_600
SCHEMA = "run_id string, epoch long, t long, finish boolean, " + ", ".join(f"{c} double" for c in CURVES)


def curve_rows(seed, n):
    rng = random.Random(seed)
    odd = [None, float("nan"), float("inf")]
    absent = {c for c in CURVES if rng.random() < 0.2}
    return [[None if c in absent else rng.choice(odd) if rng.random() < 0.2 else rng.random() for c in CURVES] for _ in range(n)]


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)))


def test_folded_curves_have_the_features_of_whole_ones(spark):
    runs = {f"r{k}": curve_rows(k, k) for k in range(1, 25)}
    rows = [(run, i, *v) for run, curve in runs.items() for i, v in enumerate(curve)]
    df = spark.createDataFrame(rows, "run_id string, pos long, " + ", ".join(f"{c} double" for c in CURVES))
    for found in curve_features(df).collect():
        state = CurveSummary()
        for i, v in enumerate(runs[found["run_id"]]):
            # What is stored between batches is enough to go on.
            state = CurveSummary(state.cells)
            state.fold(i, v)
        got = state.features()
        wrong = {f: (found[f], got[f]) for f in LIVE_FEATURES if not same(found[f], got[f])}
        assert not wrong, (found["run_id"], wrong)


class Folder:
    """Files that a stream takes one by one, in order."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0

    def add(self, rows):
        df = self.spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t")).drop("t").coalesce(1)
        df.write.mode("append").parquet(self.path)
        self.n += 1

    def stream(self):
        schema = self.spark.read.parquet(self.path).schema
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.path)


@pytest.mark.parametrize("files", [1, 3])
def test_scored_runs_from_a_table_of_one_or_many_files(spark, tmp_path, files):
    rows = [(i, [float((i * 7 + j) % 5 - 2) for j in range(64)], i % 6) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(files)
    df.write.parquet(str(tmp_path / "many"))
    if files == 1:
        next((tmp_path / "many").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    else:
        (tmp_path / "many").rename(tmp_path / "embeddings.parquet")
    # Another table of the folder is no part of the stream.
    df.limit(3).write.parquet(str(tmp_path / "other_embeddings.parquet"))
    got = REGISTRY["live_scored_diagnoses"].build(Tables(spark, str(tmp_path))).collect()
    assert sorted(r["run_id"] for r in got) == sorted(f"v{i}" for i in range(30))


def row(run, epoch, hour, loss, finish=False):
    return (run, epoch, int(hour * HOUR), finish, loss, loss + 0.5, 0.5, 0.4)


def test_late_and_repeated_epochs_and_state_that_goes(spark, tmp_path):
    files = Folder(spark, tmp_path / "epochs")
    # Out of order within the delay; epoch 1 twice; run b finishes and is silent after that.
    files.add([row("a", 2, 2.0, 0.7), row("a", 1, 1.5, 0.8), row("a", 1, 1.6, 99.0), row("b", 0, 1.0, 0.3), row("b", 1, 1.2, 0.1, True)])
    files.add([row("a", 0, 1.2, 0.9), row("b", 1, 1.25, 50.0), row("c", 0, 4.0, 1.0)])
    # The watermark has passed hour 3: these two come too late; run a is silent until it opens anew.
    files.add([row("a", 3, 1.0, 77.0), row("c", 1, 20.0, 2.0)])
    files.add([row("a", 9, 30.0, 5.0), row("a", 10, 30.5, 4.0)])
    files.add([row("d", 0, 60.0, 1.0)])
    found, left = live.run_closed(closed_runs(files.stream(), 6 * HOUR), lambda f: linear_stages.score(f, WEIGHTS), "test")
    rows = sorted((r["run_id"], r["opened_us"] // 10**6 / HOUR, r["closed_us"] // 10**6 / HOUR, r["reason"]) for r in found.collect())
    assert rows == [
        ("a", 1.2, 2.0, "silent"), ("a", 30.0, 30.5, "silent"), ("b", 1.0, 1.2, "finished"), ("c", 4.0, 4.0, "silent"), ("c", 20.0, 20.0, "silent"),
    ]
    assert left <= 4  # the value, timers of the one run that is still open
    closed = {(r["run_id"], r["opened_us"]): r for r in live.run_append(closed_runs(files.stream(), 6 * HOUR), "again", rocksdb=True).collect()}
    first = closed["a", int(1.2 * HOUR) * 10**6]
    assert (first["n_epochs"], first["train_loss_max"], first["train_loss_final"]) == (3.0, 0.9, 0.7)
    assert math.isclose(first["train_loss_slope"], -0.1)


def test_a_session_over_at_the_very_watermark_and_states_handed_over_together(spark, tmp_path):
    files = Folder(spark, tmp_path / "epochs")
    files.add([row("a", 0, 1.0, 0.9), row("a", 1, 1.0 + 1e-3, 0.8), row("b", 0, 1.0, 0.3)])
    files.add([row("c", 0, 8.0, 1.0)])
    stream = closed_runs(files.stream(), 6 * HOUR)
    # A state is no object with calls of its own for each run.
    assert "TransformWithState" not in stream._jdf.queryExecution().analyzed().toString()
    rows = live.run_append(stream, "edge", rocksdb=True).collect()
    assert [(r["run_id"], r["n_epochs"], r["reason"]) for r in rows] == [("b", 1.0, "silent")]


def test_a_late_run_joins_its_stored_summary(spark, tmp_path):
    rng = random.Random(3)
    rows = [row(run, 10 * day + e, 24 * day + e / 10, rng.random()) for run, days in (("a", (0, 9)), ("b", (1,)), ("c", (9,))) for day in days for e in range(5)]
    store = str(tmp_path / "store")
    for k, part in enumerate((rows[:5] + rows[10:15], rows[5:10] + rows[15:])):
        files = Folder(spark, tmp_path / f"in{k}")
        for r in part:
            files.add([r])
        stream = files.stream().select("run_id", "epoch", "ts", F.col("train_loss").alias("value"))
        left = live.store_summaries(live.window_summaries(stream), store, str(tmp_path / f"state{k}"))
        assert left <= 2
    got = {r["run_id"]: r for r in live.merge_summaries(live.read_summaries(spark, store)).collect()}
    whole = spark.createDataFrame(rows, SCHEMA).select("run_id", "epoch", F.col("train_loss").alias("value"))
    for want in live.running_features(whole).collect():
        have = got[want["run_id"]]
        for c in ("n_finite", "minimum", "maximum", "mean", "std", "slope", "last", "best_epoch"):
            assert same(float(want[c]), float(have[c])), c


def test_weights_are_stored_and_stage1_is_required(spark, tmp_path):
    linear_stages.save(spark, WEIGHTS, str(tmp_path / "w"))
    assert linear_stages.load(spark, str(tmp_path / "w")) == WEIGHTS
    linear_stages.save(spark, {k: v for k, v in WEIGHTS.items() if k[0] != "stage1"}, str(tmp_path / "x"))
    with pytest.raises(ValueError, match="stage1"):
        linear_stages.load(spark, str(tmp_path / "x"))
