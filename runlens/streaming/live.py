"""Live runs: epoch ingest, lifecycle, running features, diagnosis of finished runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.numeric import finite
from runlens.operators.cascade import diagnose, flatten
from runlens.session import new_table_path


def read_epochs(spark: SparkSession, folder: str, schema, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder, one file or a folder of files, as a stream."""
    # As a pattern the path may be either; a plain path has to be a folder.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")


def ingest(epochs: DataFrame, finished: DataFrame | None = None, delay: str = "1 hour") -> DataFrame:
    """Accepted epoch rows: with an epoch number, once per (run, epoch), not after the run was finalised.

    epochs: run_id, epoch, ts TIMESTAMP, value; finished: run_id, finalized_at (a stored table).
    """
    rows = epochs.where("epoch is not null").withColumn("value", finite(F.col("value")))
    if finished is not None:
        rows = rows.join(finished, "run_id", "left").where("finalized_at is null or ts <= finalized_at").drop("finalized_at")
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "epoch"])


def lifecycle(epochs: DataFrame, silence: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """One row per closed run session: epochs logged, duration, status.

    A session closes after ``silence``; it is completed when a row carried that status, else interrupted.
    """
    per = epochs.withWatermark("ts", delay).groupBy("run_id", F.session_window("ts", silence).alias("w")).agg(
        F.count(F.lit(1)).alias("n_epochs_logged"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max((F.col("status") == "completed").cast("int")).alias("done"),
        F.max((F.col("status") == "failed").cast("int")).alias("failed"),
    )
    return per.select(
        "run_id", F.col("w.start").alias("started_at"), "n_epochs_logged",
        (F.unix_micros("last_ts") - F.unix_micros("first_ts")).alias("duration_us"),
        F.when(F.col("failed") == 1, "failed").when(F.col("done") == 1, "completed").otherwise("interrupted").alias("status"),
    )


def running_features(epochs: DataFrame) -> DataFrame:
    """Curve features that can be kept incrementally (mergeable aggregates as streaming state)."""
    x, t = finite(F.col("value")), F.col("epoch").cast("double")
    return epochs.groupBy("run_id").agg(
        F.count(x).alias("n_finite"),
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.coalesce(F.regr_slope(x, t), F.lit(0.0)).alias("slope"),
        F.max_by("value", F.col("epoch")).alias("last"),
        F.min_by("epoch", F.when(x.isNotNull(), F.struct(x, F.col("epoch")))).alias("best_epoch"),
    )


#: Mergeable parts of the running features; floating moments are kept around their own means.
_PARTS = {
    "n": lambda x, t: F.count(x),
    "mean_x": lambda x, t: F.avg(x),
    "mean_t": lambda x, t: F.avg(F.when(x.isNotNull(), t)),
    "m2_x": lambda x, t: F.var_pop(x) * F.count(x),
    "m2_t": lambda x, t: F.var_pop(F.when(x.isNotNull(), t)) * F.count(x),
    "cross": lambda x, t: F.covar_pop(x, t) * F.count(x),
    "minimum": lambda x, t: F.min(x),
    "maximum": lambda x, t: F.max(x),
    "last": lambda x, t: F.max(F.struct(F.col("epoch"), F.col("value"))),
    "best": lambda x, t: F.min(F.when(x.isNotNull(), F.struct(x.alias("x"), F.col("epoch")))),
}


def window_summaries(epochs: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Mergeable summaries of each run's time windows, as a stream.

    Spark drops a window's state as soon as the watermark has passed it, so state is bounded by the runs that were active within
    ``width`` and ``delay``. A silent run costs nothing; when it speaks again, its new windows join the stored ones.
    """
    x, t = finite(F.col("value")), F.col("epoch").cast("double")
    windows = epochs.withWatermark("ts", delay).groupBy("run_id", F.window("ts", width).alias("w"))
    parts = windows.agg(*[make(x, t).alias(name) for name, make in _PARTS.items()])
    return parts.withColumn("window_us", F.unix_micros("w.start")).drop("w")


def merge_summaries(parts: DataFrame) -> DataFrame:
    """The running features of each run from its windows' summaries (one row per run and window)."""
    n = F.sum("n")
    whole = parts.groupBy("run_id").agg(
        n.alias("n_finite"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
        (F.sum(F.col("n") * F.col("mean_x")) / n).alias("mean"), (F.sum(F.col("n") * F.col("mean_t")) / n).alias("at"),
        F.max("last").alias("last"), F.min("best").alias("best"),
    )
    around = parts.select("run_id", "n", "mean_x", "mean_t", "m2_x", "m2_t", "cross").join(whole.select("run_id", "mean", "at"), "run_id")
    dx, dt, w = F.col("mean_x") - F.col("mean"), F.col("mean_t") - F.col("at"), F.col("n")
    moments = around.groupBy("run_id").agg(
        F.sum(F.col("m2_x") + w * dx * dx).alias("xx"), F.sum(F.col("m2_t") + w * dt * dt).alias("tt"), F.sum(F.col("cross") + w * dx * dt).alias("xt"),
    )
    return whole.join(moments, "run_id").select(
        "run_id", "n_finite", "minimum", "maximum", "mean", F.sqrt(F.col("xx") / F.col("n_finite")).alias("std"),
        F.coalesce(F.try_divide("xt", "tt"), F.lit(0.0)).alias("slope"), F.col("last.value").alias("last"), F.col("best.epoch").alias("best_epoch"),
    )


def store_summaries(stream: DataFrame, store: str, state: str) -> int:
    """Run the available epochs' window summaries into ``store``, a folder a batch; the rows of state left after the last batch.

    ``store`` may hold summaries of earlier streams (other state folders); batches are named by stream, so none is overwritten.
    """
    name = uuid.uuid5(uuid.NAMESPACE_URL, state).hex

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/stream={name}/batch_id={batch_id}")

    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", state).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    return state_rows(q)


def read_summaries(spark: SparkSession, store: str) -> DataFrame:
    """The newest summary of each (stream, run, window)."""
    rows = spark.read.parquet(store)
    keys = ["stream", "run_id", "window_us"]
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("s"))
    return newest.select(*keys, "s.*")


def state_rows(query) -> int:
    """Rows of state that a query holds after its last batch."""
    progress = query.lastProgress
    return sum(int(o["numRowsTotal"]) for o in progress["stateOperators"]) if progress else 0


def diagnose_finished(path: str, threshold: float = 0.5) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that diagnoses a micro-batch of scored runs and writes the rows below ``path``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # One folder per batch id: a retried batch overwrites its own output.
        flatten(diagnose(batch, healthy_threshold=threshold)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return handle


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder inside the application's own, which goes when the application ends."""
    return f"{new_table_path(spark)}-{name}"


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, rocksdb: bool = True) -> Iterator[None]:
    """Start queries on Spark's RocksDB state store, which holds many runs outside the heap; other queries keep the session's."""
    before = spark.conf.get(_STORE)
    if rocksdb:
        spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def run_append(stream: DataFrame, name: str, rocksdb: bool = False) -> DataFrame:
    """Process everything available into Parquet files and read them back."""
    spark = stream.sparkSession
    out, state = new_folder(spark, name), new_folder(spark, f"{name}-state")
    with state_store(spark, rocksdb):
        q = (
            stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out)
            .outputMode("append").trigger(availableNow=True).start()
        )
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_update(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Process everything available in update mode; the newest row per key."""
    spark = stream.sparkSession
    out, state = new_folder(spark, name), new_folder(spark, f"{name}-state")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", state).outputMode("update")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    rows = spark.read.parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in rest])


def run_diagnoses(stream: DataFrame, name: str, threshold: float = 0.5) -> DataFrame:
    """Diagnose every available micro-batch of scored runs (run_id, stage_probs)."""
    spark = stream.sparkSession
    out, state = new_folder(spark, name), new_folder(spark, f"{name}-state")
    q = (
        stream.writeStream.foreachBatch(diagnose_finished(out, threshold)).option("checkpointLocation", state)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


def run_closed(closed: DataFrame, score: Callable[[DataFrame], DataFrame], name: str, threshold: float = 0.5) -> tuple[DataFrame, int]:
    """Score and diagnose every run that closes in the available epochs; the diagnoses, and the rows of state left.

    closed: ``curve_state.closed_runs`` of a stream; score adds ``stage_probs`` (a loaded cascade, linear stages). The state of
    many runs is held by Spark's RocksDB store, which is set for this query only.
    """
    spark = closed.sparkSession
    out, state = new_folder(spark, name), new_folder(spark, f"{name}-state")
    kept = ["run_id", "opened_us", "closed_us", "reason"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        found = diagnose(score(batch), healthy_threshold=threshold).withColumn("run_id", F.struct(*kept))
        flat = flatten(found)
        flat.select("run_id.*", *[c for c in flat.columns if c != "run_id"]).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with state_store(spark):
        q = (
            closed.writeStream.foreachBatch(handle).option("checkpointLocation", state).outputMode("append")
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
    return spark.read.parquet(out).drop("batch_id"), state_rows(q)
