"""Stored tables: precomputed features, out-of-fold predictions, diagnoses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.probs import items
from runlens.vocab import CLASSES, STAGE_COLUMNS


def adapt_features(table: DataFrame, runs: DataFrame) -> DataFrame:
    """A ready-made feature table: run_id and numeric columns only, label joined from the run table."""
    if "run_id" not in table.columns:
        raise ValueError("feature table has no run_id column")
    numeric = [f.name for f in table.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != "run_id"]
    kept = table.select(F.col("run_id").cast("string").alias("run_id"), *[F.col(c).cast("double").alias(c) for c in numeric])
    return kept.join(runs.select("run_id", "primary_label"), "run_id", "left")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by file ending (CSV columns that are fully numeric become numbers)."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.parquet(path)


def write_oof(oof: DataFrame, path: str) -> None:
    """Nested columns flat, cascade, stage_probs, arbitrator, meta, partitioned by fold."""
    def struct(col: str, names: tuple[str, ...]):
        return F.struct(*[v.alias(n) for n, v in zip(names, items(F.col(col), len(names)))]).alias(col)

    oof.select(
        "run_id", struct("flat", CLASSES), struct("cascade", CLASSES), struct("stage_probs", STAGE_COLUMNS), struct("arbitrator", CLASSES),
        F.struct("arb_triggered", "arb_confidence").alias("meta"), "fold",
    ).write.mode("overwrite").partitionBy("fold").parquet(path)


def read_oof(spark: SparkSession, path: str) -> DataFrame:
    """Back to arrays; missing probabilities fail the read."""
    t = spark.read.parquet(path)

    def array(col: str, names: tuple[str, ...]):
        return F.array(*[F.col(f"{col}.{n}") for n in names]).alias(col)

    return t.select(
        "run_id", array("flat", CLASSES), array("cascade", CLASSES), array("stage_probs", STAGE_COLUMNS), array("arbitrator", CLASSES),
        F.col("meta.arb_triggered").alias("arb_triggered"), F.col("meta.arb_confidence").alias("arb_confidence"), "fold",
    )


def write_diagnoses(flat: DataFrame, path: str, fmt: str = "json", partition: str | None = None) -> None:
    """Flattened diagnoses as JSON lines, CSV or Parquet."""
    w = flat.write.mode("overwrite")
    if partition:
        w = w.partitionBy(partition)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
