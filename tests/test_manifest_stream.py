"""Manifests cut at any byte give the rows of one parse of the whole document."""

import json
import random

import pytest

from runlens.sources import manifest_stream, manifests

ODD = ['a,b', 'say "hi", then', "[{", "}],", "back\\slash", "\\\\", 'end\\"', "tab\t", "é, 日本", ""]


def document(rng, kind):
    text = lambda: rng.choice(ODD) + str(rng.randint(0, 99))
    doc = {"name": text(), "note": {"a": [1, 2, {"b": [text()]}]}, "n": 3}
    if kind == "runs":
        doc["runs"] = [text() if rng.random() < 0.5 else {rng.choice(["path", "run_id"]): text(), "more": [text(), {"x": 1}]} for _ in range(60)]
    if kind in ("entries", "both"):
        doc["entries"] = [
            {"entry_id": text(), "run_ids": [text() for _ in range(rng.randint(0, 3))], "primary_label": text(), "severity": None, "fault_plan": [text()] * rng.randint(0, 2)}
            for _ in range(50)
        ]
    if kind == "both":
        doc["runs"] = [text()]
    doc["splits"] = {"train": [text()]}
    if rng.random() < 0.5:
        doc = dict(reversed(doc.items()))
    return json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)


@pytest.mark.parametrize("size", ["200b", "3k", "128m"])
def test_same_rows_at_any_cut(spark, tmp_path, size):
    rng = random.Random(len(size))
    for i, kind in enumerate(["runs", "entries", "both", "entries", "runs"]):
        (tmp_path / f"c{i}").mkdir()
        (tmp_path / f"c{i}" / "corpus.manifest.json").write_text(document(rng, kind), encoding="utf-8")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "corpus.manifest.json").write_text('{"name": "x", "runs": ["a", "b"')
    settings = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = manifest_stream.elements(spark, str(tmp_path))
        got = manifest_stream.parse_elements(found).collect()
        broken = [r["corpus_path"] for r in found.where("section is null").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = manifests.parse_manifests(manifests.read_documents(spark, str(tmp_path))).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert len(want) > 100 and sorted(got, key=key) == sorted(want, key=key)
    assert [b.rsplit("/", 1)[1] for b in broken] == ["broken"]


def test_elements_are_put_together_once(spark, tmp_path):
    (tmp_path / "corpus.manifest.json").write_text(document(random.Random(1), "entries"), encoding="utf-8")
    plan = manifest_stream.parse_elements(manifest_stream.elements(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
