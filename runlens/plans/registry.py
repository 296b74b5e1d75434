"""Named queries: each builds a DataFrame from the tables and may carry its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.sources.driver_tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def register(build):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, ids, build, sql)
        return build

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column, so that two engines can be compared by value."""
    return df.select(
        *[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )
