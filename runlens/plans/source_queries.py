"""Manifests, run metadata, histories as text, tracker exports, silver labels.

The documents and CSV lines are written by Spark from the tables, then read by the same parsers
that handle files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.plans.oracle import CURVES, curve_cte, r, rcols, with_ctes
from runlens.plans.registry import query, rounded
from runlens.session import cut_lineage, new_table_path
from runlens.sources import driver_tables as D
from runlens.sources import manifest_stream, manifests, run_files, trackers


def manifest_documents(t):
    """Per order: an entries-form, a runs-form, or a broken manifest."""
    b = D.runs_bulk(t)
    k = F.col("ord")
    key = k.cast("string")
    entry = F.struct(
        F.col("entry_id"),
        F.array("run_id", F.concat("run_id", F.lit("b"))).alias("run_ids"),
        F.col("primary_label"),
        F.col("severity"),
        F.when(k % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("fault_plan"),
    )
    splits = F.create_map(F.lit("train"), F.array("run_id"), F.lit("test"), F.array(F.concat("run_id", F.lit("b"))))
    entries_doc = F.to_json(
        F.struct(F.concat(F.lit("c"), key).alias("corpus_id"), F.array(entry).alias("entries"), splits.alias("splits"))
    )
    runs_doc = F.concat(
        F.lit('{"name": "n'), key, F.lit('", "runs": ["'), F.col("run_id"), F.lit('", {"path": "/abs/'), F.col("run_id"),
        F.lit('p"}, {"run_dir": "sub/'), F.col("run_id"), F.lit('d"}, {"run_id": "'), F.col("run_id"), F.lit('i"}]}'),
    )
    broken = (
        F.when(k % 4 == 0, F.lit('{"name": "x"}')).when(k % 4 == 1, F.lit('{"runs": []}'))
        .when(k % 4 == 2, F.lit("[1]")).otherwise(F.lit('{"runs": [{"other": 1}]}'))
    )
    content = F.when(k % 3 == 0, entries_doc).when(k % 3 == 1, runs_doc).otherwise(broken)
    return b.select(F.concat(F.lit("/corpus/"), key).alias("corpus_path"), content.alias("content"))


@query("manifest_runs", "S1 S2", with_ctes(["runs_bulk"], """
    SELECT 'c' || ord AS corpus, '/corpus/' || ord || '/' || run_id || sfx AS run_dir, run_id || sfx AS run_key, entry_id, primary_label,
           severity, 1 + (ord % 2) AS n_faults, ord % 2 = 1 AS is_multi_label
    FROM runs_bulk, (VALUES (''), ('b')) s(sfx) WHERE ord % 3 = 0
    UNION ALL
    SELECT 'n' || ord, CASE kind WHEN '' THEN '/corpus/' || ord || '/' || run_id WHEN 'p' THEN '/abs/' || run_id || 'p'
           WHEN 'd' THEN '/corpus/' || ord || '/sub/' || run_id || 'd' ELSE '/corpus/' || ord || '/' || run_id || 'i' END,
           run_id || kind, NULL, NULL, NULL, NULL, NULL
    FROM runs_bulk, (VALUES (''), ('p'), ('d'), ('i')) s(kind) WHERE ord % 3 = 1"""))
def _(t):
    return manifests.parse_manifests(manifest_documents(t)).withColumn("n_faults", F.col("n_faults").cast("long"))


@query("large_manifest_runs", "S1", with_ctes(["runs_bulk"], """
    SELECT 'big, ' || (ord % 8) AS corpus, run_id AS run_key, 'e"' || ord || '"],' AS entry_id, primary_label, severity, (ord % 3)::BIGINT AS n_faults, ord % 3 > 1 AS is_multi_label FROM runs_bulk"""))
def _(t):
    """All runs in eight manifests, each one JSON array in one file, cut into entries by brackets and quotes."""
    k = F.col("ord")
    faults = F.slice(F.array(F.lit("a, }"), F.lit('b"]')), F.lit(1), (k % 3).cast("int"))
    entry = F.to_json(F.struct(
        F.concat(F.lit('e"'), k.cast("string"), F.lit('"],')).alias("entry_id"), F.array("run_id").alias("run_ids"), "primary_label", "severity", faults.alias("fault_plan"),
    ))
    entries = D.runs_bulk(t).select((k % 8).alias("bucket"), F.lit(1).alias("part"), F.concat(F.lit(","), entry).alias("value"))
    ends = t.spark.range(8).select(F.col("id").alias("bucket"), F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit('{"name": "big, '), F.col("id").cast("string"), F.lit('", "entries": [{"entry_id": "none", "run_ids": []}')).alias("value")),
        F.struct(F.lit(2).alias("part"), F.lit("]}").alias("value")),
    )).alias("e")).select("bucket", "e.*")
    path = new_table_path(t.spark)
    rows = entries.unionByName(ends).repartition("bucket").sortWithinPartitions("bucket", "part")
    rows.select("bucket", "value").write.partitionBy("bucket").text(path)
    found = manifest_stream.parse_elements(manifest_stream.elements(t.spark, path, "*.txt"))
    return found.select("corpus", "run_key", "entry_id", "primary_label", "severity", F.col("n_faults").cast("long").alias("n_faults"), "is_multi_label")


@query("manifest_errors", "S1", with_ctes(["runs_bulk"], """
    SELECT '/corpus/' || ord AS corpus_path, CASE ord % 4 WHEN 0 THEN 'manifest has neither runs nor entries'
      WHEN 1 THEN 'runs must be a non-empty list' WHEN 2 THEN 'manifest is not a JSON object' ELSE 'unsupported run entry' END AS error
    FROM runs_bulk WHERE ord % 3 = 2"""))
def _(t):
    return manifests.manifest_errors(manifest_documents(t))


@query("manifest_splits", "S3", with_ctes(["runs_bulk"], """
    SELECT 'c' || ord AS corpus, s.split, run_id || s.sfx AS run_id FROM runs_bulk,
      (VALUES ('train', ''), ('test', 'b')) s(split, sfx) WHERE ord % 3 = 0"""))
def _(t):
    return manifests.parse_splits(manifest_documents(t))


@query("runs_from_directory", "S4", with_ctes(["runs_bulk"], """
    SELECT dataset || '_' || run_id || '_singlerun' AS corpus, '/fleet/' || dataset || '/' || run_id AS run_dir, run_id AS run_key
    FROM runs_bulk WHERE n_history_rows > 0 AND ord % 10 <> 7"""))
def _(t):
    b = D.runs_bulk(t)
    root = F.concat_ws("/", F.lit("/fleet"), "dataset", "run_id")
    meta = b.where("ord % 10 <> 7").select(F.concat(root, F.lit("/meta.json")).alias("path"))
    hist = b.where("n_history_rows > 0").select(F.concat(root, F.lit("/history.csv")).alias("path"))
    return manifests.runs_from_directory(meta.unionByName(hist))


def meta_documents(t):
    """Per order: metadata with labels, dataset, severity and multi-label flag in varying places."""
    b = D.runs_bulk(t)
    k = F.col("ord")
    lab = F.col("primary_label")
    quoted = F.concat(F.lit('"'), lab, F.lit('"'))
    label_part = (
        F.when(lab.isNull(), F.lit('"labels": null'))
        .when(k % 4 == 0, F.concat(F.lit('"labels": ['), quoted, F.lit(', null, "extra"]')))
        .when(k % 4 == 1, F.concat(F.lit('"labels": [], "diagnosis": '), quoted))
        .when(k % 4 == 2, F.concat(F.lit('"fault_labels": ['), quoted, F.lit("]")))
        .otherwise(F.concat(F.lit('"label": '), quoted))
    )
    ds = F.col("dataset")
    dataset_part = (
        F.when(k % 5 == 0, F.concat(F.lit(', "dataset": "'), ds, F.lit('"')))
        .when(k % 5 == 1, F.concat(F.lit(', "dataset": 7, "dataset_name": "'), ds, F.lit('"')))
        .when(k % 5 == 2, F.concat(F.lit(', "task": "t1", "config": {"t0": {"dataset": "no"}, "t1": {"dataset": "'), ds, F.lit('"}}')))
        .when(k % 5 == 3, F.concat(F.lit(', "config": {"a": 1, "b": {"dataset": "'), ds, F.lit('"}}')))
        .otherwise(F.lit(""))
    )
    sev_part = F.when(
        F.col("severity").isNotNull(), F.concat(F.lit(', "severity": " '), F.initcap("severity"), F.lit(' "'))
    ).otherwise(F.lit(', "fault_severity": "unknown"'))
    multi = F.when(F.col("is_multi_label"), F.lit(', "multi_label": true')).otherwise(F.lit(""))
    text = F.concat(F.lit("{"), label_part, dataset_part, sev_part, multi, F.lit("}"))
    content = F.when(k % 97 == 0, F.lit("not json")).otherwise(text)
    return b.select(F.concat(F.lit("/fleet/"), F.col("run_id")).alias("run_dir"), content.alias("content"))


_META_SQL = """
    SELECT run_id, '/fleet/' || run_id AS run_dir, CASE WHEN ord % 5 <> 4 THEN dataset END AS dataset, primary_label,
      CASE WHEN primary_label IS NULL THEN '' WHEN ord % 4 = 0 THEN primary_label || ',extra' ELSE primary_label END AS labels,
      coalesce(severity, 'unknown') AS severity,
      is_multi_label OR (primary_label IS NOT NULL AND ord % 4 = 0) AS is_multi_label FROM runs_bulk WHERE ord % 97 <> 0"""


@query("meta_documents", "S5 S10", with_ctes(["runs_bulk"], """
    SELECT coalesce(CASE WHEN ord % 97 = 0 THEN 'meta is not a JSON object' END, 'ok') AS status, count(*) AS n
    FROM runs_bulk GROUP BY 1"""))
def _(t):
    parsed = run_files.parse_meta(meta_documents(t))
    return parsed.groupBy(F.coalesce("error", F.lit("ok")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("meta_promoted", "S7 S8 S9", with_ctes(["runs_bulk"], _META_SQL))
def _(t):
    meta = run_files.parse_meta(meta_documents(t)).where("error is null")
    p = run_files.promote_meta(meta)
    return p.select(
        "run_id", "run_dir", "dataset", F.get("labels", 0).alias("primary_label"),
        F.concat_ws(",", "labels").alias("labels"), "severity", "is_multi_label",
    )


def _run_table(t):
    meta = run_files.parse_meta(meta_documents(t))
    b = D.runs_bulk(t)
    manifest = b.where("ord % 2 = 0").select(
        F.col("run_id").alias("run_key"), "entry_id",
        F.when(F.col("ord") % 8 == 0, F.lit("leakage")).alias("primary_label"),
        F.when(F.col("ord") % 8 == 2, F.lit(" Severe ")).alias("severity"),
        (F.col("ord") % 3 == 0).alias("is_multi_label"),
    )
    sizes = b.where("n_history_rows > 0").select(F.concat(F.lit("/fleet/"), F.col("run_id")).alias("run_dir"), "n_history_rows")
    return run_files.split_broken(run_files.load_runs(run_files.promote_meta(meta), manifest, sizes))


@query("run_table", "S7 S10 J1 J2", with_ctes(["runs_bulk"], """
    SELECT p.run_id, p.run_dir, p.dataset, CASE WHEN ord % 8 = 0 THEN 'leakage' ELSE p.primary_label END AS primary_label,
      CASE WHEN ord % 8 = 0 THEN 'leakage' ELSE p.labels END AS labels,
      CASE WHEN ord % 2 = 0 THEN ord % 3 = 0 ELSE p.is_multi_label END AS is_multi_label,
      CASE WHEN ord % 8 = 2 THEN 'severe' ELSE p.severity END AS severity, b.n_history_rows,
      CASE WHEN ord % 2 = 0 THEN b.entry_id END AS entry_id
    FROM promoted p JOIN runs_bulk b USING (run_id) WHERE b.n_history_rows > 0""", [("promoted", _META_SQL)]))
def _(t):
    good, _bad = _run_table(t)
    return good.select(
        "run_id", "run_dir", "dataset", "primary_label", F.concat_ws(",", "labels").alias("labels"),
        "is_multi_label", "severity", "n_history_rows", "entry_id",
    )


@query("run_table_quarantine", "S10", with_ctes(["runs_bulk"], """
    SELECT '/fleet/' || run_id AS run_dir, CASE WHEN ord % 97 = 0 THEN 'meta is not a JSON object' ELSE 'history is empty or missing' END AS error
    FROM runs_bulk WHERE n_history_rows = 0 OR ord % 97 = 0"""))
def _(t):
    return _run_table(t)[1]


def history_lines(t):
    """CSV lines of every user's history: two header layouts, cut into blocks of five lines."""
    h = D.history(t)
    even = F.regexp_extract("run_id", r"(\d+)", 1).cast("long") % 2 == 0

    def text(*cols):
        return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])

    h = h.withColumn("epoch", F.col("pos") + 1)
    body = F.when(even, text("epoch", "train_loss", "val_loss", "train_acc", "val_acc")).otherwise(
        text("val_acc", "epoch", "train_loss", "val_loss", "train_acc", "grad_norm")
    )
    rows = h.select("run_id", (F.col("pos") + 1).alias("n"), body.alias("line"))
    header = F.when(even, F.lit("epoch,train_loss,val_loss,train_acc,val_acc")).otherwise(
        F.lit('"val_accuracy", epoch,loss,test_loss,acc,grad_norm')
    )
    heads = h.where("pos = 0").select("run_id", F.lit(0).cast("long").alias("n"), header.alias("line"))
    return rows.unionByName(heads).select(
        F.concat(F.lit("/fleet/"), F.col("run_id")).alias("run_dir"),
        (F.floor(F.col("n") / 5) * 1000).alias("block"),
        F.col("n").alias("ord"),
        "line",
    )


@query("history_from_text", "S6 P1", with_ctes(["history"], f"""
    SELECT '/fleet/' || run_id AS run_dir, pos, (pos + 1)::DOUBLE AS epoch, {rcols(CURVES)},
      CASE WHEN substr(run_id, 2)::BIGINT % 2 = 1 THEN {r('grad_norm')} END AS grad_norm FROM history"""))
def _(t):
    h = run_files.parse_history(history_lines(t))
    cols = ("epoch", *CURVES, "grad_norm")
    return rounded(h.select("run_dir", "pos", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols]))


@query("history_quoted", "S6", with_ctes(["history"], f"""
    SELECT '/fleet/' || run_id AS run_dir, pos, (pos + 1)::DOUBLE AS epoch, {rcols(CURVES)},
      CASE WHEN substr(run_id, 2)::BIGINT % 2 = 1 THEN {r('grad_norm')} END AS grad_norm FROM history"""))
def _(t):
    # Every cell in quotes, and a first column of quoted text with commas and doubled quotes.
    line = F.regexp_replace(F.replace(F.col("line"), F.lit('"'), F.lit("")), "([^,]+)", '"$1"')
    note = F.lit('"a ""b"", c",')
    h = run_files.parse_history(history_lines(t).withColumn("line", F.when(F.trim("line") != "", F.concat(note, line)).otherwise(F.col("line"))))
    cols = ("epoch", *CURVES, "grad_norm")
    return rounded(h.select("run_dir", "pos", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols]))


def tracker_export(t):
    """Metric rows under tracker names, with duplicates and series that lost their step numbers."""
    m = D.metrics(t)
    u = F.regexp_extract("run_id", r"(\d+)", 1).cast("long")
    renamed = (
        F.when((u % 2 == 0) & (F.col("metric") == "train_loss"), "Loss/train")
        .when((u % 2 == 0) & (F.col("metric") == "val_acc"), "validation_accuracy")
        .otherwise(F.col("metric"))
    )
    step = F.when((u % 7 == 3) & (F.col("step") == 0), F.lit(None)).otherwise(F.col("step"))
    base = m.select("run_id", renamed.alias("metric"), step.cast("long").alias("step"), "ts", "seq", "value")
    decoy = base.where((u % 5 == 0) & (F.col("metric") == "val_loss")).withColumn("metric", F.lit("valid_loss")).withColumn("value", F.col("value") * 2)
    again = base.where((F.col("metric") == "train_acc") & (F.col("step") == 2)).withColumn("seq", F.col("seq") + 10_000_000).withColumn("value", F.col("value") / 2)
    # An export is a stored table: write the derived one once before it is read several times.
    return cut_lineage(base.unionByName(decoy).unionByName(again))


_EXPORT_SQL = [
    ("base", """SELECT run_id, CASE WHEN u % 2 = 0 AND metric = 'train_loss' THEN 'Loss/train'
        WHEN u % 2 = 0 AND metric = 'val_acc' THEN 'validation_accuracy' ELSE metric END AS metric,
        CASE WHEN u % 7 = 3 AND step = 0 THEN NULL ELSE step END AS step, ts, seq, value, u
        FROM (SELECT *, substr(run_id, 2)::BIGINT AS u FROM metrics)"""),
    ("export", """SELECT * FROM base UNION ALL SELECT run_id, 'valid_loss', step, ts, seq, value * 2, u FROM base WHERE u % 5 = 0 AND metric = 'val_loss'
        UNION ALL SELECT run_id, metric, step, ts, seq + 10000000, value / 2, u FROM base WHERE metric = 'train_acc' AND step = 2"""),
    ("repaired", """SELECT run_id, metric, value, ts, seq, CASE WHEN bool_or(step IS NULL) OVER s
        THEN row_number() OVER (PARTITION BY run_id, metric ORDER BY ts, seq) - 1 ELSE step END AS step
        FROM export WINDOW s AS (PARTITION BY run_id, metric)"""),
    ("stepped", "SELECT run_id, metric, step, arg_max(value, (ts, seq)) AS value FROM repaired GROUP BY ALL"),
    ("aligned", """SELECT run_id, step, max(value) FILTER (WHERE metric IN ('train_loss', 'Loss/train')) AS train_loss,
        max(value) FILTER (WHERE metric = 'val_loss') AS val_loss, max(value) FILTER (WHERE metric = 'train_acc') AS train_acc,
        max(value) FILTER (WHERE metric IN ('val_acc', 'validation_accuracy')) AS val_acc, max(value) FILTER (WHERE metric = 'grad_norm') AS grad_norm
        FROM stepped WHERE metric <> 'valid_loss' GROUP BY run_id, step"""),
]


@query("tracker_history", "S13 S14", with_ctes(["metrics"], f"""
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS pos,
      row_number() OVER (PARTITION BY run_id ORDER BY step) AS epoch, {rcols([*CURVES, 'grad_norm'])} FROM aligned""", _EXPORT_SQL))
def _(t):
    return rounded(trackers.to_history(tracker_export(t)).select("run_id", "pos", "epoch", *CURVES, "grad_norm"))


@query("tracker_metric_mapping", "S13", with_ctes(["metrics"], """
    SELECT DISTINCT run_id, CASE metric WHEN 'Loss/train' THEN 'train_loss' WHEN 'validation_accuracy' THEN 'val_acc' ELSE metric END AS "column", metric
    FROM export WHERE metric <> 'valid_loss'""", _EXPORT_SQL))
def _(t):
    return trackers.resolve_metrics(tracker_export(t))


@query("steps_without_timestamps", "S14", with_ctes(["metrics"], """
    SELECT run_id, metric, row_number() OVER (PARTITION BY run_id, metric ORDER BY ts NULLS FIRST, seq) - 1 AS step, seq FROM (
      SELECT run_id, metric, seq, CASE WHEN seq % 3 <> 0 THEN ts END AS ts FROM metrics)"""))
def _(t):
    m = D.metrics(t).withColumns({"ts": F.when(F.col("seq") % 3 != 0, F.col("ts")), "step": F.lit(None).cast("long")})
    return trackers.repair_steps(cut_lineage(m)).select("run_id", "metric", F.col("step").cast("long").alias("step"), "seq")


@query("event_file_history", "S13", with_ctes(["metrics"], f"""
    SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS pos, row_number() OVER (PARTITION BY run_id ORDER BY step) AS epoch,
      {rcols([*CURVES, 'grad_norm'])} FROM (
      SELECT run_id, step, max(value) FILTER (WHERE metric = 'train_loss') AS train_loss, max(value) FILTER (WHERE metric = 'val_loss') AS val_loss,
        max(value) FILTER (WHERE metric = 'train_acc') AS train_acc, max(value) FILTER (WHERE metric = 'val_acc') AS val_acc,
        max(value) FILTER (WHERE metric = 'grad_norm') AS grad_norm FROM metrics GROUP BY run_id, step)"""))
def _(t):
    tag = F.col("metric")
    tags = F.when(tag == "train_loss", "Loss_train").when(tag == "val_loss", "epoch_val_loss").when(tag == "train_acc", "epoch_accuracy").otherwise(tag)
    m = cut_lineage(D.metrics(t).withColumn("metric", tags))
    return rounded(trackers.to_history(m, trackers.EVENT_TAGS).select("run_id", "pos", "epoch", *CURVES, "grad_norm"))


@query("lifted_params", "S15", """
    SELECT 'o' || o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS dataset_name, o_orderstatus AS model_name,
      CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 1000) / 1e3 WHEN o_orderkey % 3 = 1 THEN NULL ELSE 5e-1 END AS learning_rate,
      CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS batch_size, o_orderkey AS seed FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    pairs = F.array(
        F.when(k % 2 == 0, F.struct(F.lit("data").alias("k"), F.col("o_orderpriority").alias("v"))),
        F.struct(F.lit("architecture").alias("k"), F.col("o_orderstatus").alias("v")),
        F.when(k % 3 == 0, F.struct(F.lit("lr").alias("k"), ((k % 1000) / 1000.0).cast("string").alias("v")))
        .when(k % 3 == 1, F.struct(F.lit("learning_rate").alias("k"), F.lit("fast").alias("v")))
        .otherwise(F.struct(F.lit("initial_lr").alias("k"), F.lit("0.5").alias("v"))),
        F.struct(F.lit("batchsize").alias("k"), F.when(k % 4 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string")).alias("v")),
        F.struct(F.lit("random_seed").alias("k"), k.cast("string").alias("v")),
    )
    params = t.orders.select(
        F.concat(F.lit("o"), k.cast("string")).alias("run_id"), F.map_from_entries(F.array_compact(pairs)).alias("params")
    )
    return trackers.lift_params(params).select("run_id", "dataset_name", "model_name", "learning_rate", "batch_size", "seed")


_KEYWORD_SQL = """CASE WHEN contains(txt, 'leak') THEN 'leakage' WHEN contains(txt, 'overfit') THEN 'overfitting'
    WHEN contains(txt, 'unstable') OR contains(txt, 'instability') OR contains(txt, 'diverg') THEN 'instability'
    WHEN contains(txt, 'noise') OR contains(txt, 'noisy_label') THEN 'label_noise' ELSE 'unlabeled' END"""


@query("silver_labels_text", "S16", f"""
    SELECT label, count(*) AS n_runs FROM (SELECT {_KEYWORD_SQL} AS label FROM
      (SELECT lower(text || ' source ' || source) AS txt FROM documents)) GROUP BY label""")
def _(t):
    runs = t.documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("run_id"),
        F.col("text").alias("run_name"),
        F.concat(F.lit("source "), F.col("source")).alias("tags"),
    )
    none = runs.select("run_id").where(F.lit(False))
    for c, kind in {
        "n_rows": "long", "has_val": "boolean", "has_train": "boolean", "val_final": "double", "train_final": "double",
        "train_first": "double", "val_std_last10": "double",
    }.items():
        none = none.withColumn(c, F.lit(None).cast(kind))
    return trackers.silver_summary(trackers.silver_labels(runs, none))


@query("silver_labels_curves", "S16", with_ctes(["history"], """
    SELECT run_id, CASE WHEN n < 3 OR NOT hv THEN 'unlabeled'
      WHEN coalesce(vf >= 0.85 AND tf >= 0.95 AND abs(tf - vf) < 0.05, false) THEN 'healthy'
      WHEN coalesce(tf - vf > 0.20, false) THEN 'overfitting' WHEN coalesce(sd > 0.10, false) THEN 'instability'
      WHEN coalesce(vf < 0.65 AND (NOT ht OR coalesce(vf - t0 < 0.10, false)), false) THEN 'underfitting' ELSE 'unlabeled' END AS label
    FROM (SELECT run_id, max(n) AS n, bool_or(val_acc IS NOT NULL) AS hv, bool_or(train_acc IS NOT NULL) AS ht,
      max(CASE WHEN pos = n - 1 THEN x_val_acc END) AS vf, max(CASE WHEN pos = n - 1 THEN x_train_acc END) AS tf,
      max(CASE WHEN pos = 0 THEN x_train_acc END) AS t0, stddev_pop(CASE WHEN pos >= n - 10 THEN x_val_acc END) AS sd
      FROM epochs GROUP BY run_id)""", [curve_cte("history")]))
def _(t):
    h = D.history(t)
    runs = h.select("run_id").distinct().select("run_id", F.col("run_id").alias("run_name"), F.lit("").alias("tags"))
    return trackers.silver_labels(runs, trackers.silver_curve_stats(h))


