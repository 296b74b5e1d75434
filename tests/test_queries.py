"""Registered queries against their SQL twins on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import canonical, connect, difference

from runlens.plans import REGISTRY

ROOT = "/root/testdata/sf0.001"
FAST = (
    "curve_features", "integrity_proxies_with_gaps", "manifest_runs", "history_from_text", "run_table", "partition_bulk",
    "coverage_gaps", "group_majority", "group_stability", "prototype_distances", "cascade_diagnoses", "policy_dispatch", "arbitrated_resolution",
    "meta_features", "conformal_sets", "report_bulk", "calibration_errors_bulk", "stage_reports", "attribution_summary",
    "stage1_threshold_sweep", "evidence", "recommended_actions", "validated_parameters", "patch_outcomes", "narrative_en",
    "report_contract", "live_ingest", "live_lifecycle", "isotonic_curves", "patch_meta_delta", "evidence_features", "conformal_alpha_sweep",
)


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(tables, con, name):
    q = REGISTRY[name]
    df = q.build(tables)
    cur = con.execute(q.sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    assert difference(canonical(df.columns, [tuple(r) for r in df.collect()]), want) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
