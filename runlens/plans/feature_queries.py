"""Curve features, integrity proxies, grouping, prototypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import curves, integrity
from runlens.operators.curves import BASE_FEATURES, KEPT_PROXIES, PROXY_FEATURES
from runlens.plans.oracle import curve_feature_exprs, features_sql, proxy_exprs, rcols, with_ctes
from runlens.plans.registry import query, rounded
from runlens.sources import driver_tables as D

BASE = curve_feature_exprs()
PROXY = proxy_exprs()


def _feature_sql(source: str, names) -> str:
    ctes, extra = features_sql(source, {n: {**BASE, **PROXY}[n] for n in names})
    return with_ctes(ctes, f"SELECT run_id, {rcols(names)} FROM feats", extra)


@query("curve_features", "F1 F2 F3 F4 F5 F6 F7 F8 F9 F10", _feature_sql("history", BASE_FEATURES))
def _(t):
    return rounded(curves.curve_features(D.history(t)).select("run_id", *BASE_FEATURES))


@query("curve_features_with_gaps", "F2 F3 F4 F7 F8", _feature_sql("history_gaps", BASE_FEATURES))
def _(t):
    return rounded(curves.curve_features(D.history_with_gaps(t)).select("run_id", *BASE_FEATURES))


@query("integrity_proxies", "I2 I3a I3b I3c I3d I3e I3f", _feature_sql("history", PROXY_FEATURES))
def _(t):
    return rounded(curves.integrity_proxies(D.history(t)))


@query("integrity_proxies_with_gaps", "I2 I3a I3b I3c I3d I3e I3f", _feature_sql("history_gaps", PROXY_FEATURES))
def _(t):
    return rounded(curves.integrity_proxies(D.history_with_gaps(t)))


@query("feature_table", "F12 F11", with_ctes(
    ["history", "runs_small"],
    f"""SELECT run_id, primary_label, {rcols([*BASE_FEATURES, *KEPT_PROXIES])}, round(k / 1e3, 6) + 0.0 AS meta_lr
        FROM feats JOIN runs_small USING (run_id)
        JOIN (SELECT 'u' || user_id AS run_id, json_extract_string(arg_min(props, (ts, event_id)), '$.k')::DOUBLE AS k
              FROM events GROUP BY user_id) USING (run_id)""",
    features_sql("history", {n: {**BASE, **PROXY}[n] for n in [*BASE_FEATURES, *KEPT_PROXIES]})[1],
))
def _(t):
    meta = D.meta(t).select("run_id", F.to_json(F.struct((F.get_json_object("meta_json", "$.k").cast("double") / 1000.0).alias("lr"))).alias("meta_json"))
    out = integrity.build_feature_table(D.history(t), meta, D.runs_small(t).select("run_id", "primary_label"))
    return rounded(out.select("run_id", "primary_label", *BASE_FEATURES, *KEPT_PROXIES, "meta_lr"))
