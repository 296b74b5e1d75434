"""Curve features and proxies against small numpy twins, including awkward curves."""

import math

import numpy as np
import pytest

from runlens.operators import curves

NAN, INF = float("nan"), float("inf")

CASES = {
    "smooth": dict(train_loss=[2, 1.5, 1.1, 0.9, 0.8, 0.7], val_loss=[2.1, 1.4, 1.2, 1.3, 1.4, 1.6], train_acc=[0.3, 0.5, 0.6, 0.7, 0.8, 0.9], val_acc=[0.3, 0.5, 0.55, 0.6, 0.58, 0.57]),
    "one": dict(train_loss=[1.0], val_loss=[1.2], train_acc=[0.5], val_acc=[0.4]),
    "two": dict(train_loss=[1.0, 0.5], val_loss=[1.2, 1.2], train_acc=[0.5, 0.6], val_acc=[0.4, 0.4]),
    "constant": dict(train_loss=[2.0] * 8, val_loss=[2.0] * 8, train_acc=[0.1] * 8, val_acc=[0.1] * 8),
    "all_nan": dict(train_loss=[NAN] * 5, val_loss=[NAN] * 5, train_acc=[0.2] * 5, val_acc=[0.1, 0.2, 0.3, 0.4, 0.5]),
    "spike": dict(train_loss=[1, INF, 0.5, 0.4], val_loss=[1, 0.9, 0.9, 0.8], train_acc=[0.1, 0.2, 0.3, 0.4], val_acc=[0.1, 0.2, NAN, 0.4]),
    "nan_last": dict(train_loss=[1, 0.8, NAN], val_loss=[1, 0.7, 0.9], train_acc=[0.4, 0.5, 0.6], val_acc=[0.3, 0.4, NAN]),
    "no_val": dict(train_loss=[1, 0.8, 0.7, 0.6], val_loss=None, train_acc=[0.4, 0.5, 0.6, 0.7], val_acc=None),
    "two_minima": dict(train_loss=[3, 2, 1, 2, 1], val_loss=[3, 1, 2, 1, 2], train_acc=[0.1] * 5, val_acc=[0.5, 0.6, 0.5, 0.6, 0.5]),
}


def rows():
    out = []
    for run, c in CASES.items():
        n = len(c["train_loss"])
        for i in range(n):
            out.append((run, i, *[None if c[k] is None else float(c[k][i]) for k in curves.CURVES]))
    return out


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame(rows(), "run_id string, pos long, " + ", ".join(f"{c} double" for c in curves.CURVES))


def slope(y, offset=0):
    x = np.arange(len(y)) + offset
    ok = np.isfinite(y)
    return 0.0 if ok.sum() < 2 else float(np.polyfit(x[ok], y[ok], 1)[0])


def twin(v):
    if v is None:
        return {s: None for s in curves.CURVE_STATS} | {"n_nan": 0.0}
    v = np.array(v, float)
    ok, n, half = v[np.isfinite(v)], len(v), max(1, len(v) // 2)
    x = np.where(np.isfinite(v), v, NAN)
    jumps = np.abs(np.diff(x))
    jumps = jumps[np.isfinite(jumps)]
    return {
        "final": None if np.isnan(v[-1]) else v[-1],
        "min": ok.min() if ok.size else None,
        "max": ok.max() if ok.size else None,
        "mean": ok.mean() if ok.size else None,
        "std": ok.std() if ok.size else None,
        "slope": slope(v),
        "slope_first_half": slope(v[:half]),
        "slope_second_half": slope(v[half:]),
        "max_jump": 0.0 if n == 1 else (jumps.max() if jumps.size else None),
        "n_nan": float(n - ok.size),
    }


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or a == b


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_curve_features_match_numpy(history, block):
    got = {r["run_id"]: r for r in curves.curve_features(history, block).collect()}
    assert set(got) == set(CASES)
    for run, c in CASES.items():
        assert got[run]["n_epochs"] == len(c["train_loss"])
        lost = any(c[k] is not None and np.isnan(c[k]).any() for k in ("train_loss", "val_loss"))
        assert got[run]["diverged"] == float(lost)
        for curve in curves.CURVES:
            for stat, want in twin(c[curve]).items():
                assert close(got[run][f"{curve}_{stat}"], want), (run, curve, stat, got[run][f"{curve}_{stat}"], want)
    assert got["two_minima"]["val_loss_argmin_frac"] == 0.25
    assert got["no_val"]["val_loss_argmin_frac"] is None
    assert close(got["smooth"]["acc_final_gap"], 0.9 - 0.57)
    assert got["nan_last"]["acc_final_gap"] is None


@pytest.mark.parametrize("block", [2, 4096])
def test_proxies(history, block):
    got = {r["run_id"]: r for r in curves.integrity_proxies(history, block).collect()}
    s = got["smooth"]
    ta, va = np.array(CASES["smooth"]["train_acc"]), np.array(CASES["smooth"]["val_acc"])
    assert close(s["di_proxy_acc_lockstep_corr"], np.corrcoef(ta, va)[0, 1])
    assert close(s["di_proxy_early_val_flatness"], np.std([2.1, 1.4]))
    assert close(s["di_proxy_epoch_to_90pct_val_acc_frac"], 2 / 5)
    assert close(s["di_proxy_best_minus_final_val_acc"], 0.6 - 0.57)
    assert close(s["di_proxy_val_loss_uniqueness"], 5 / 6)
    assert got["constant"]["di_proxy_acc_lockstep_corr"] is None
    assert got["one"]["di_proxy_val_above_train_acc_frac"] is None
    assert got["no_val"]["di_proxy_saturation"] is None
