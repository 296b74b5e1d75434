import numpy as np
import pytest

from runlens.operators import prototypes


def brute(a, b):
    n, m = len(a), len(b)
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = abs(a[i - 1] - b[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[n, m] / (n + m)


@pytest.mark.parametrize("block", [3, 4096])
def test_dtw_matches_brute_force(spark, block):
    rng = np.random.default_rng(5)
    curves = {f"r{i}": rng.random(int(rng.integers(1, 60))) for i in range(6)}
    curves["gaps"] = np.array([0.1, np.nan, 0.5, 0.2])
    curves["empty"] = np.array([np.nan])
    rows = [(r, i, float(v)) for r, c in curves.items() for i, v in enumerate(c)]
    history = spark.createDataFrame(rows, "run_id string, pos long, val_loss double")
    protos = {"healthy": rng.random(7), "leakage": rng.random(4)}
    table = spark.createDataFrame([(c, i, float(v)) for c, p in protos.items() for i, v in enumerate(p)], "class string, pos long, value double")
    for r in prototypes.dtw_distances(history, table, block=block).collect():
        a = curves[r["run_id"]]
        a = a[np.isfinite(a)]
        for c, p in protos.items():
            got = r[f"proto_dtw_{c}"]
            assert got is None if a.size == 0 else got == pytest.approx(brute(a, p))


def test_dtw_memory_follows_the_prototype(spark):
    """A long run against a long prototype: the frontier is as long as the prototype."""
    history = spark.range(6000).selectExpr("'long' AS run_id", "id AS pos", "sin(id / 50.0D) AS val_loss")
    table = spark.range(2000).selectExpr("'healthy' AS class", "id AS pos", "sin(id / 17.0D) AS value")
    r = prototypes.dtw_distances(history, table, block=256).first()
    a, b = np.sin(np.arange(6000) / 50.0), np.sin(np.arange(2000) / 17.0)
    state = np.full((1, 2001), np.inf)
    state[0, 0] = 0.0
    assert r["proto_dtw_healthy"] == pytest.approx(prototypes._advance(state, a, b)[0, -1] / 8000)
