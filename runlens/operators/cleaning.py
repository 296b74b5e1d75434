"""Projection, imputation and probability-table checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.numeric import finite
from runlens.functions.ordering import exact_quantiles
from runlens.functions.probs import items, normalise, sums_to_one
from runlens.vocab import CLASSES


def align_columns(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """keys + exactly ``columns`` in order: missing ones null, extra ones dropped, non-finite values null."""
    have = set(df.columns)
    return df.select(
        *keys,
        *[
            (finite(F.col(c).cast("double")) if c in have else F.lit(None).cast("double")).alias(c)
            for c in columns
        ],
    )


def missing_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in df.columns]


def long_features(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """keys + (feature, x): one row per finite cell."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), finite(F.col(c).cast("double")).alias("x")) for c in columns])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.feature", "p.x").where("x is not null")


def column_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of exact medians over finite values, 0.0 for a column without any.

    Rows pass through one exact-quantile job keyed by feature; nothing is collected.
    """
    med = exact_quantiles(long_features(df, columns, []), ["feature"], "x", {"median": 0.5})
    return med.agg(
        *[F.coalesce(F.max(F.when(F.col("feature") == c, F.col("median"))), F.lit(0.0)).alias(c) for c in columns]
    )


def impute_medians(df: DataFrame, columns: list[str], medians: DataFrame | None = None) -> DataFrame:
    """Fill non-finite cells with the medians (fitted on ``df`` unless given, e.g. from training rows)."""
    medians = column_medians(df, columns) if medians is None else medians
    packed = medians.select(F.struct(*columns).alias("_m")).scalar()
    rest = [c for c in df.columns if c not in columns]
    out = df.withColumn("_m", packed)
    return out.select(
        *rest, *[F.coalesce(finite(F.col(c).cast("double")), F.col(f"_m.{c}")).alias(c) for c in columns]
    )


def drop_unlabelled(df: DataFrame, label: str = "primary_label") -> DataFrame:
    return df.dropna(subset=[label])


def drop_by_prefix(df: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(tuple(prefixes))])


def log_value(text: Column) -> Column:
    """A logged value as the history file stores it: true/false to 1/0; NaN, inf, None to null."""
    low = F.lower(F.trim(text))
    as_bool = F.when(low == "true", "1").when(low == "false", "0")
    gone = low.isNull() | low.isin("nan", "inf", "-inf", "+inf", "infinity", "-infinity", "none", "null", "")
    return F.when(gone, F.lit(None).cast("string")).otherwise(F.coalesce(as_bool, F.trim(text)))


def invalid_probabilities(df: DataFrame, prob: str = "p", n: int = len(CLASSES), atol: float = 1e-3) -> DataFrame:
    """Rows whose vector has a null or NaN or does not sum to one."""
    bad_size = F.coalesce(F.size(prob) != n, F.lit(True))
    return df.where(bad_size | ~sums_to_one(F.col(prob), n, atol))


def renormalise(df: DataFrame, prob: str, n: int = len(CLASSES)) -> DataFrame:
    return df.withColumn(prob, normalise(items(F.col(prob), n)))
