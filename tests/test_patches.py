"""Metadata before and after a patch."""

import json

from runlens.operators import patches
from runlens.operators.actions import ACTIONS


def test_metadata_of_every_action_by_literal_paths(spark):
    old = {"lr": 0.1, "seed": 3, "patience": None, "weight_decay": "0.1", "dropout": {"p": 1}}
    new = {"lr": 0.1, "seed": 4, "patience": 2, "weight_decay": "0.1"}
    meta = spark.createDataFrame([("a", json.dumps(old)), ("b", json.dumps(new)), ("c", None)], "run_id string, meta_json string")
    names = [n for n, *_ in ACTIONS]
    cases = [(f"{n}-{b}{a}", b, a, n) for n in [*names, "unheard_of"] for b, a in (("a", "b"), ("b", "c"), ("a", "x"))]
    found = patches.meta_delta(spark.createDataFrame(cases, "case_id string, before string, after string, action string"), meta)
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
    want = set()
    for name, _, keys, _ in ACTIONS:
        for case, one, two in ((f"{name}-ab", old, new), (f"{name}-bc", new, {})):
            for key in keys:
                b, a = text(one.get(key)), text(two.get(key))
                want.add((case, key, b, a, b != a))
    assert {tuple(r) for r in found.collect()} == want
    # A path put together for a row is parsed for that row.
    assert "concat($." not in found._jdf.queryExecution().analyzed().toString()
