"""Merged isotonic fits against the max-min formula."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import isotonic


def plain(points):
    """(x, fitted) of one key by the max-min formula over distinct x."""
    cells = {}
    for x, y in points:
        s, w = cells.get(x, (0.0, 0))
        cells[x] = (s + y, w + 1)
    xs = sorted(cells)

    def mean(j, k):
        return sum(cells[x][0] for x in xs[j : k + 1]) / sum(cells[x][1] for x in xs[j : k + 1])

    return {x: max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("parts", [1, 5, 70])
def test_any_number_of_ranges_gives_the_same_fit(spark, parts):
    rng = random.Random(parts)
    rows = [(k, float(rng.randint(0, 40)) / 3 - 2, float(rng.random() < 0.1 + 0.02 * k)) for k in range(3) for _ in range(150)]
    rows += [(3, float(i), float(i)) for i in range(30)] + [(4, float(i), float(-i)) for i in range(30)] + [(5, 1.0, 1.0)]
    odd = [(0, None, 1.0), (0, float("nan"), 1.0), (1, 2.0, None)]
    df = spark.createDataFrame(rows + odd, "key long, x double, y double").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        blocks = isotonic.fit_blocks(df)
        got = {(r["key"], r["x"]): r["fitted"] for r in isotonic.fitted_values(df, blocks).where("y is not null").collect()}
        sizes = {r["key"]: r["n"] for r in blocks.groupBy("key").agg(F.count("*").alias("n")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k in range(6):
        want = plain([(x, y) for key, x, y in rows if key == k])
        for x, value in want.items():
            assert got[k, x] == pytest.approx(value)
        assert sizes[k] == len(set(round(v, 12) for v in want.values()))


@pytest.mark.parametrize("parts", [3, 12, 70])
def test_ranges_that_are_not_joined_beforehand(spark, parts):
    rng = random.Random(parts)
    rows = [(k, float(rng.randint(0, 40)) / 3, float(rng.random() < 0.3 + 0.001 * i)) for k in range(2) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, x double, y double").repartition(4)
    settings = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = {(r["key"], r["x"]): r["fitted"] for r in isotonic.fitted_values(df, isotonic.fit_blocks(df)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for k in range(2):
        for x, value in plain([(x, y) for key, x, y in rows if key == k]).items():
            assert got[k, x] == pytest.approx(value)


def test_no_points(spark):
    assert isotonic.fit_blocks(spark.createDataFrame([], "key long, x double, y double")).count() == 0
