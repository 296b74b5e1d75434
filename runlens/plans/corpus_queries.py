"""Cleaning, partition, inventory, joins, grouped and prototype features."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions.numeric import coerce_scalar
from runlens.functions.ordering import exact_quantiles
from runlens.functions.probs import items, normalise
from runlens.operators import cleaning, curves, grouped, integrity, inventory, prototypes
from runlens.operators.integrity import INTEGRITY_META
from runlens.operators.partition import PartitionRules, evaluation_slices, partition_runs, reason_summary, slice_summary
from runlens.plans.oracle import (
    CLASSES, STAGE1_OF, STAGE2_OF, STAGE3_OF, curve_feature_exprs, features_sql, mapped, proxy_exprs, r, rcols,
    with_ctes,
)
from runlens.plans.registry import query, rounded
from runlens.session import cut_lineage
from runlens.sources import driver_tables as D
from runlens.sources.run_files import last_by_key
from runlens.vocab import taxonomy, taxonomy_problems

BASE = curve_feature_exprs()
STAB = grouped.STABILITY_COLUMNS


# --- cleaning ------------------------------------------------------------------------------------


@query("aligned_features", "P2", with_ctes(["history_gaps"], f"""
    SELECT run_id, pos, {r('CASE WHEN isfinite(val_acc) THEN val_acc END', 'val_acc')}, NULL::DOUBLE AS lr,
      {r('CASE WHEN isfinite(train_loss) THEN train_loss END', 'train_loss')} FROM history_gaps"""))
def _(t):
    return rounded(cleaning.align_columns(D.history_with_gaps(t), ["val_acc", "lr", "train_loss"], ["run_id", "pos"]))


_IMPUTE = ("val_loss_final", "val_acc_max", "loss_final_gap", "train_acc_slope")


@query("median_imputation", "P3 P4", with_ctes(
    ["history_gaps", "runs_small"],
    "SELECT run_id, primary_label, " + ", ".join(r(f"coalesce({c}, med_{c}, 0)", c) for c in _IMPUTE)
    + " FROM lab, (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in _IMPUTE) + " FROM lab)",
    [*features_sql("history_gaps", {c: BASE[c] for c in _IMPUTE})[1],
     ("lab", "SELECT * FROM feats JOIN runs_small USING (run_id) WHERE primary_label IS NOT NULL")],
))
def _(t):
    f = cut_lineage(curves.curve_features(D.history_with_gaps(t)).select("run_id", *_IMPUTE))
    lab = cleaning.drop_unlabelled(f.join(D.runs_small(t).select("run_id", "primary_label"), "run_id"))
    return rounded(cleaning.impute_medians(lab, list(_IMPUTE)))


@query("numeric_features_without_prefix", "P5", with_ctes(
    ["history"], f"SELECT run_id, {rcols(['train_loss_final', 'acc_final_gap'])} FROM feats",
    features_sql("history", {c: BASE[c] for c in ("train_loss_final", "acc_final_gap")})[1]))
def _(t):
    f = curves.full_features(D.history(t)).select("run_id", "train_loss_final", "acc_final_gap", "val_loss_min", "di_proxy_saturation")
    return rounded(cleaning.drop_by_prefix(f, ("di_proxy_", "val_")))


@query("stage_labels", "P6", with_ctes(["runs_bulk"], f"""
    SELECT run_id, primary_label, {mapped('primary_label', STAGE1_OF)} AS stage1, {mapped('primary_label', STAGE2_OF)} AS stage2,
      {mapped('primary_label', STAGE3_OF)} AS stage3 FROM runs_bulk"""))
def _(t):
    return inventory.stages_of(D.runs_bulk(t))


@query("taxonomy_check", "P7", with_ctes(["taxonomy", "runs_bulk"], """
    SELECT label, ord::BIGINT AS ord, stage1, stage2, stage3, (SELECT count(*) FROM runs_bulk WHERE primary_label = label) AS n, 0::BIGINT AS n_problems
    FROM taxonomy"""))
def _(t):
    dim = taxonomy(t.spark)
    problems = taxonomy_problems(dim).agg(F.count(F.lit(1))).scalar()
    return inventory.class_counts(D.runs_bulk(t)).select(
        F.col("primary").alias("label"), F.col("ord").cast("long").alias("ord"), "stage1", "stage2", "stage3", "n",
        problems.alias("n_problems"),
    )


@query("coerced_scalars", "P8", """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN value > 50 THEN 1e0 ELSE 0e0 END WHEN 1 THEN round(value, 6) + 0.0
      WHEN 2 THEN json_extract_string(props, '$.k')::DOUBLE ELSE NULL END AS x FROM events""")
def _(t):
    v, k = F.col("value"), F.col("event_id") % 5
    text = (
        F.when(k == 0, F.when(v > 50, "True").otherwise("false")).when(k == 1, v.cast("string"))
        .when(k == 2, F.get_json_object("props", "$.k")).when(k == 3, F.col("event_type"))
    )
    return rounded(t.events.select("event_id", coerce_scalar(text).alias("x")))


@query("normalised_log_values", "P9", """
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN value > 50 THEN '1' ELSE '0' END WHEN 1 THEN event_type ELSE NULL END AS logged FROM events""")
def _(t):
    v, k = F.col("value"), F.col("event_id") % 6
    text = (
        F.when(k == 0, F.when(v > 50, "true").otherwise("False")).when(k == 1, F.col("event_type")).when(k == 2, "NaN")
        .when(k == 3, "-inf").when(k == 4, "None")
    )
    return t.events.select("event_id", cleaning.log_value(text).alias("logged"))


@query("invalid_probability_rows", "P10", with_ctes(["preds"], """
    SELECT run_id FROM preds WHERE vec_id % 10 IN (3, 4)"""))
def _(t):
    p = D.predictions(t)
    k, f = F.col("vec_id") % 10, items(F.col("flat"), 6)
    broken = F.when(k == 3, F.array(*f[:5], F.lit(None).cast("double"))).when(k == 4, F.array(f[0] + 0.01, *f[1:])).when(
        k == 5, F.array(f[0] + 0.0001, *f[1:])
    ).otherwise(F.col("flat"))
    return cleaning.invalid_probabilities(p.withColumn("p", broken), "p").select("run_id")


@query("renormalised_rows", "P11", with_ctes(["vec"], "SELECT 'v' || vec_id AS run_id, " + ", ".join(
    r(f"CASE WHEN s <= 0 THEN 1 / 6e0 ELSE greatest(x[{i + 1}], 0) / s END", f"p{i}") for i in range(6)
) + " FROM (SELECT *, list_sum(list_transform(x, lambda v: greatest(v, 0))) AS s FROM (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN list_transform(e[1:6], lambda v: -abs(v)) ELSE e[1:6] END AS x FROM vec))"))
def _(t):
    e = [F.get("e", F.lit(i)) for i in range(6)]
    x = [F.when(F.col("vec_id") % 9 == 0, -F.abs(v)).otherwise(v) for v in e]
    p = normalise(x)
    out = D.vectors(t).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("run_id"), p.alias("p"))
    return rounded(out.select("run_id", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(6)]))


# --- declared integrity values, joins ------------------------------------------------------------


def _declared_meta(t):
    """Per order: a metadata document with the integrity values under varying synonyms."""
    k = F.col("o_orderkey")
    part = [
        F.when(k % 3 == 0, F.concat(F.lit('"trainval_overlap": '), ((k % 100) / 1000.0).cast("string"))),
        F.when(k % 3 == 1, F.lit('"train_val_overlap": "junk", "duplicate_overlap_ratio": true')),
        F.when(k % 4 == 0, F.concat(F.lit('"noise_ratio": "'), ((k % 50) / 100.0).cast("string"), F.lit('"'))),
        F.concat(F.lit('"data_split_seed": '), (k % 17).cast("string")),
    ]
    doc = F.concat(F.lit("{"), F.concat_ws(", ", *part), F.lit("}"))
    return t.orders.select(F.concat(F.lit("o"), k.cast("string")).alias("run_id"), doc.alias("meta_json"))


@query("declared_integrity", "I1", """
    SELECT 'o' || o_orderkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN round((o_orderkey % 100) / 1e3, 6) + 0.0 WHEN 1 THEN 1e0 END AS di_train_val_overlap,
      NULL::DOUBLE AS di_duplicate_index_overlap, NULL::DOUBLE AS di_replay_evidence, NULL::DOUBLE AS di_mi_target_features,
      NULL::DOUBLE AS di_split_hash_collision, CASE WHEN o_orderkey % 4 = 0 THEN round((o_orderkey % 50) / 1e2, 6) + 0.0 END AS di_label_noise_rate_declared,
      (o_orderkey % 17)::DOUBLE AS di_split_seed FROM orders""")
def _(t):
    return rounded(integrity.integrity_meta_features(_declared_meta(t)).select("run_id", *INTEGRITY_META))


_I4 = ("train_loss_final", "di_proxy_saturation", "di_proxy_loss_ratio_mean", "di_proxy_acc_lockstep_corr")


@query("integrity_joined", "I4 J1 J9", with_ctes(
    ["history"], f"SELECT run_id, {rcols(_I4)} FROM feats", features_sql("history", {c: {**BASE, **proxy_exprs()}[c] for c in _I4})[1]))
def _(t):
    h = D.history(t)
    out = integrity.join_integrity(curves.feature_table(h), curves.integrity_proxies(h))
    return rounded(out.select("run_id", *_I4))


_I5 = ("val_loss_final", "acc_final_gap", "di_proxy_saturation")


@query("leakage_healthy_contrast", "I5", with_ctes(
    ["history", "runs_small"],
    "SELECT primary_label, " + ", ".join(
        f"count({c}) AS {c}__count, round(avg({c}), 4) + 0.0 AS {c}__mean, round(stddev_samp({c}), 4) + 0.0 AS {c}__std" for c in _I5)
    + " FROM feats JOIN runs_small USING (run_id) WHERE primary_label IN ('leakage', 'healthy') GROUP BY primary_label",
    features_sql("history", {c: {**BASE, **proxy_exprs()}[c] for c in _I5})[1]))
def _(t):
    f = curves.full_features(D.history(t)).select("run_id", *_I5)
    return integrity.leakage_contrast(f.join(D.runs_small(t).select("run_id", "primary_label"), "run_id"), list(_I5))


# --- partition -----------------------------------------------------------------------------------

SATURATED = PartitionRules(saturated_datasets=("BUILDING", "ds1", "ds5"))
_REASONS = """list_filter([
    CASE WHEN coalesce(primary_label, '') = '' THEN 'unlabeled' END, CASE WHEN is_multi_label THEN 'multi_label' END,
    CASE WHEN severity = 'mild' THEN 'severity_mild' END, CASE WHEN coalesce(severity, '') = '' THEN 'severity_unknown' END,
    CASE WHEN severity = 'none' AND coalesce(primary_label, '') <> 'healthy' THEN 'severity_none_on_faulty' END,
    CASE WHEN coalesce(severity, '') <> '' AND severity NOT IN ('mild', 'moderate', 'severe', 'none') THEN 'severity_out_of_vocabulary' END,
    CASE WHEN n_history_rows < 5 THEN 'short_history_lt_5' END,
    CASE WHEN severity = 'mild' AND dataset IN ('BUILDING', 'ds1', 'ds5') THEN 'mild_on_near_saturated' END], lambda x: x IS NOT NULL)"""


def _parts(source: str):
    return ("parts", f"""SELECT *, CASE WHEN len(rs) = 0 THEN 'core' ELSE 'extended' END AS slice FROM
        (SELECT *, {_REASONS} AS rs FROM {source})""")


@query("partition_bulk", "Q1 Q2", with_ctes(["runs_bulk"], "SELECT run_id, slice, array_to_string(rs, '|') AS reasons FROM parts", [_parts("runs_bulk")]))
def _(t):
    p = partition_runs(D.runs_bulk(t), SATURATED)
    return p.select("run_id", "slice", F.concat_ws("|", "reasons").alias("reasons"))


@query("partition_small", "Q1 Q2", with_ctes(["runs_small"], "SELECT run_id, slice, array_to_string(rs, '|') AS reasons FROM parts", [_parts("runs_small")]))
def _(t):
    p = partition_runs(D.runs_small(t), SATURATED)
    return p.select("run_id", "slice", F.concat_ws("|", "reasons").alias("reasons"))


@query("partition_class_balance", "Q3", with_ctes(["runs_bulk"], "SELECT slice, primary_label, count(*) AS n FROM parts GROUP BY ALL", [_parts("runs_bulk")]))
def _(t):
    return slice_summary(partition_runs(D.runs_bulk(t), SATURATED))


@query("partition_reason_counts", "Q3", with_ctes(["runs_bulk"], "SELECT unnest(rs) AS reason, count(*) AS n FROM parts GROUP BY 1", [_parts("runs_bulk")]))
def _(t):
    return reason_summary(partition_runs(D.runs_bulk(t), SATURATED))


@query("evaluation_slices", "Q4 J4", with_ctes(["runs_bulk"], """
    SELECT s.slice, count(*) AS n, sum(ord)::BIGINT AS ord_sum FROM (
      SELECT 'full' AS slice, ord FROM parts WHERE n_history_rows > 0 AND ord % 5 = 0
      UNION ALL SELECT slice, ord FROM parts WHERE n_history_rows > 0 AND ord % 5 = 0) s GROUP BY 1""", [_parts("runs_bulk")]))
def _(t):
    b = D.runs_bulk(t)
    s = evaluation_slices(partition_runs(b, SATURATED), b.where("n_history_rows > 0"), b.where("ord % 5 = 0"))
    return s.groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.substring("run_id", 2, 30).cast("long")).alias("ord_sum")
    )


# --- inventory -----------------------------------------------------------------------------------

_FILLED = ("filled", "SELECT * REPLACE (coalesce(primary_label, '<unlabeled>') AS primary_label, coalesce(severity, '<unknown>') AS severity, coalesce(dataset, '<unknown>') AS dataset) FROM runs_bulk")


@query("inventory_marginals", "N1", with_ctes(["runs_bulk"], """
    SELECT 'primary_label' AS dimension, primary_label AS value, count(*) AS n FROM filled GROUP BY ALL
    UNION ALL SELECT 'severity', severity, count(*) FROM filled GROUP BY ALL UNION ALL SELECT 'dataset', dataset, count(*) FROM filled GROUP BY ALL""", [_FILLED]))
def _(t):
    return inventory.marginal_counts(D.runs_bulk(t))


@query("label_by_severity", "N2", with_ctes(["runs_bulk"], "SELECT primary_label, severity, count(*) AS n FROM filled GROUP BY ALL", [_FILLED]))
def _(t):
    return inventory.cross_tab(D.runs_bulk(t), "primary_label", "severity")


@query("label_by_severity_by_dataset", "N2", with_ctes(["runs_bulk"], "SELECT primary_label, severity, dataset, count(*) AS n FROM filled GROUP BY ALL", [_FILLED]))
def _(t):
    return inventory.cross_tab(D.runs_bulk(t), "primary_label", "severity", "dataset")


@query("cross_tab_totals", "N3", with_ctes(["runs_bulk"], """
    SELECT coalesce(primary_label, '<total>') AS primary_label, coalesce(severity, '<total>') AS severity, count(*) AS n
    FROM filled GROUP BY CUBE (primary_label, severity)""", [_FILLED]))
def _(t):
    return inventory.cross_tab_with_totals(D.runs_bulk(t), "primary_label", "severity")


@query("inventory_scalars", "N4", with_ctes(["runs_bulk"], """
    SELECT count(*) AS n_runs, count_if(is_multi_label)::BIGINT AS multi_label_count, count_if(n_history_rows < 5)::BIGINT AS short_history_count FROM runs_bulk"""))
def _(t):
    return inventory.scalar_counts(D.runs_bulk(t))


@query("label_distribution", "N5", with_ctes(["runs_bulk", "taxonomy"], """
    SELECT 'stage1' AS level, '' AS parent, stage1 AS label, sum(n)::BIGINT AS n FROM c GROUP BY ALL
    UNION ALL SELECT 'stage2', '', stage2, sum(n)::BIGINT FROM c WHERE stage2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'stage3', stage2, stage3, sum(n)::BIGINT FROM c WHERE stage3 IS NOT NULL GROUP BY ALL""",
    [("c", "SELECT t.*, (SELECT count(*) FROM runs_bulk b WHERE b.primary_label = t.label) AS n FROM taxonomy t")]))
def _(t):
    return inventory.label_distribution(D.runs_bulk(t))


# All runs, with one class renamed and one without strong runs, so that there is something to report.
_MAPPED = """SELECT * REPLACE (CASE WHEN primary_label = 'leakage' THEN 'label_noise' ELSE primary_label END AS primary_label,
    CASE WHEN primary_label = 'instability' THEN 'mild' ELSE severity END AS severity) FROM runs_bulk"""
_GAPS = """SELECT 'taxonomy' AS kind, label, 'blocker' AS severity, n AS support FROM c WHERE n = 0
    UNION ALL SELECT 'branch', stage2, 'blocker', 0 FROM c WHERE stage2 IS NOT NULL GROUP BY stage2 HAVING sum(n) = 0
    UNION ALL SELECT 'stage3_leaf', label, CASE WHEN n > 0 THEN 'warning' ELSE 'blocker' END, n FROM c WHERE stage3 IS NOT NULL AND n < 3000
    UNION ALL SELECT 'severity_dataset', label, 'warning', 0 FROM c WHERE label <> 'healthy' AND strong = 0"""
_GAP_CTES = [
    ("mapped", _MAPPED),
    ("c", """SELECT t.*, (SELECT count(*) FROM mapped b WHERE b.primary_label = t.label) AS n,
        (SELECT count(*) FROM mapped b WHERE b.primary_label = t.label AND b.severity IN ('moderate', 'severe')) AS strong FROM taxonomy t"""),
]


def _mapped_runs(t):
    label = F.col("primary_label")
    severity = F.when(label == "instability", "mild").otherwise(F.col("severity"))
    return D.runs_bulk(t).withColumns({"severity": severity, "primary_label": F.when(label == "leakage", "label_noise").otherwise(label)})


@query("coverage_gaps", "N6", with_ctes(["runs_bulk", "taxonomy"], _GAPS, _GAP_CTES))
def _(t):
    return inventory.coverage_gaps(_mapped_runs(t), min_leaf_support=3000).drop("detail")


@query("inventory_verdict", "N7", with_ctes(["runs_bulk", "taxonomy"], """
    SELECT count_if(severity = 'blocker')::BIGINT AS n_blockers, count_if(severity = 'warning')::BIGINT AS n_warnings,
      count_if(kind = 'taxonomy') = 0 AS taxonomy_complete, count_if(kind IN ('branch', 'stage3_leaf') AND severity = 'blocker') = 0 AS branch_complete,
      count(*) = 0 AS passed FROM g""", [*_GAP_CTES, ("g", _GAPS)]))
def _(t):
    return inventory.inventory_verdict(inventory.coverage_gaps(_mapped_runs(t), min_leaf_support=3000), strict=True)


@query("unknown_labels", "J10", "SELECT DISTINCT event_type || '_x' AS \"primary\" FROM events WHERE event_type <> 'click'")
def _(t):
    e = F.col("event_type")
    lab = F.when(e == "click", "healthy").otherwise(F.concat(e, F.lit("_x")))
    return inventory.unknown_labels(t.events.select(lab.alias("primary_label")))


@query("class_balance", "S22 J13", with_ctes(["runs_bulk"], """
    SELECT primary_label, count(*) AS n, round(count(*) / (SELECT count(*) FROM runs_bulk)::DOUBLE, 6) + 0.0 AS share FROM filled GROUP BY 1""", [_FILLED]))
def _(t):
    return rounded(inventory.class_balance(D.runs_bulk(t)))


@query("largest_entries", "J13", with_ctes(["runs_bulk"], """
    SELECT entry_id, count(*) AS n FROM runs_bulk GROUP BY entry_id ORDER BY n DESC, entry_id LIMIT 20"""))
def _(t):
    n = D.runs_bulk(t).groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "entry_id").limit(20)


# --- joins as the engine uses them ---------------------------------------------------------------


@query("entry_lookup_last_wins", "J2", with_ctes(["runs_bulk"], """
    SELECT b.run_id, s.severity AS entry_severity FROM runs_bulk b LEFT JOIN
      (SELECT entry_id, arg_max_null(severity, ord) AS severity FROM runs_bulk GROUP BY entry_id) s USING (entry_id)"""))
def _(t):
    b = D.runs_bulk(t)
    dim = last_by_key(b.select("entry_id", F.col("severity").alias("entry_severity"), "ord"), ["entry_id"], F.col("ord")).drop("ord")
    return b.select("run_id", "entry_id").join(dim, "entry_id", "left").select("run_id", "entry_severity")


@query("paired_predictions", "J3 J11", with_ctes(["labels2"], f"""
    SELECT run_id, flat_label, {r('flat_conf', 'flat_conf')}, cascade_label, {r('cascade_conf', 'cascade_conf')} FROM labels2"""))
def _(t):
    from runlens.operators.policies import pair_predictions

    p = D.predictions(t)
    paired, lost = pair_predictions(p.select("run_id", "flat"), p.select("run_id", "cascade"))
    return rounded(paired.join(lost, "run_id", "left_anti").select("run_id", "flat_label", "flat_conf", "cascade_label", "cascade_conf"))


@query("train_without_holdout", "J5", with_ctes(["runs_bulk"], """
    SELECT run_id FROM runs_bulk WHERE entry_id NOT IN (SELECT entry_id FROM runs_bulk WHERE ord % 50 = 0)"""))
def _(t):
    b = D.runs_bulk(t)
    return b.join(b.where("ord % 50 = 0").select("entry_id"), "entry_id", "left_anti").select("run_id")


@query("union_of_different_columns", "J8", with_ctes(["runs_bulk", "runs_small"], """
    SELECT 'bulk' AS corpus, dataset, sum(n_history_rows)::BIGINT AS rows, NULL::BIGINT AS multi FROM runs_bulk GROUP BY dataset
    UNION ALL SELECT 'small', dataset, NULL, count_if(is_multi_label)::BIGINT FROM runs_small GROUP BY dataset"""))
def _(t):
    a = D.runs_bulk(t).groupBy("dataset").agg(F.sum("n_history_rows").alias("rows")).withColumn("corpus", F.lit("bulk"))
    b = D.runs_small(t).groupBy("dataset").agg(F.count_if("is_multi_label").alias("multi")).withColumn("corpus", F.lit("small"))
    return a.unionByName(b, allowMissingColumns=True)


# --- grouped features ----------------------------------------------------------------------------

_G_CTE = features_sql("history", {c: BASE[c] for c in STAB})[1]
_KEYED = ("keyed", "SELECT * REPLACE (coalesce(entry_id, '__solo__:' || run_id) AS entry_id) FROM runs_small")


@query("group_keys", "G1", with_ctes(["runs_small"], "SELECT run_id, entry_id FROM keyed", [_KEYED]))
def _(t):
    return grouped.group_key(D.runs_small(t)).select("run_id", "entry_id")


@query("group_aggregates", "G2", with_ctes(
    ["history", "runs_small"],
    "SELECT entry_id, count(*) AS n_runs, " + ", ".join(
        ", ".join((r(f"avg({c})", f"{c}__mean"), r(f"stddev_pop({c})", f"{c}__std"), r(f"min({c})", f"{c}__min"), r(f"max({c})", f"{c}__max"), r(f"max({c}) - min({c})", f"{c}__ptp"))) for c in STAB)
    + " FROM feats JOIN keyed USING (run_id) GROUP BY entry_id", [*_G_CTE, _KEYED]))
def _(t):
    f = curves.curve_features(D.history(t)).select("run_id", *STAB)
    keyed = grouped.group_key(D.runs_small(t)).select("run_id", "entry_id")
    return rounded(grouped.group_aggregates(f.join(keyed, "run_id"), list(STAB)))


@query("group_stability", "G3", with_ctes(
    ["history", "runs_small"],
    "SELECT entry_id, " + ", ".join(
        ", ".join((r(f"var_pop({c})", f"stab_{c}_var"), r(f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", f"stab_{c}_iqr"), r(f"max({c}) - min({c})", f"stab_{c}_range"))) for c in STAB)
    + " FROM feats JOIN keyed USING (run_id) GROUP BY entry_id", [*_G_CTE, _KEYED]))
def _(t):
    f = cut_lineage(curves.curve_features(D.history(t)).select("run_id", *STAB))
    keyed = grouped.group_key(D.runs_small(t)).select("run_id", "entry_id")
    return rounded(grouped.group_stability(f.join(keyed, "run_id")))


@query("group_majority", "G4", with_ctes(["runs_bulk"], """
    SELECT entry_id, arg_max(primary_label, (n, -f)) AS group_label, count(*) AS n_unique_labels FROM
      (SELECT entry_id, primary_label, count(*) AS n, min(ord) AS f FROM runs_bulk WHERE primary_label IS NOT NULL GROUP BY ALL) GROUP BY entry_id"""))
def _(t):
    return grouped.group_labels(D.runs_bulk(t))


@query("group_slices", "G5", with_ctes(["runs_bulk"], """
    SELECT entry_id, CASE WHEN count(DISTINCT slice) > 1 THEN 'mixed' ELSE max(slice) END AS slice FROM parts GROUP BY entry_id""", [_parts("runs_bulk")]))
def _(t):
    return grouped.group_slices(partition_runs(D.runs_bulk(t), SATURATED))


@query("group_slice_members", "G6 J4", with_ctes(["runs_bulk"], """
    SELECT slice, count(*) AS n FROM (SELECT unnest(['full', slice]) AS slice FROM
      (SELECT entry_id, CASE WHEN count(DISTINCT slice) > 1 THEN 'mixed' ELSE max(slice) END AS slice FROM parts GROUP BY entry_id)
      WHERE entry_id IN (SELECT entry_id FROM runs_bulk WHERE ord % 7 = 0)) GROUP BY slice""", [_parts("runs_bulk")]))
def _(t):
    b = D.runs_bulk(t)
    groups = grouped.group_slices(partition_runs(b, SATURATED))
    members = grouped.slice_members(groups, b.where("ord % 7 = 0").select("entry_id").distinct())
    return members.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@query("grouped_feature_table", "G1 G2 G3 G4 G5", with_ctes(
    ["history", "runs_small"], f"""
    SELECT entry_id, n_runs, {r('m', 'val_loss_final__mean')}, {r('iqr', 'stab_val_loss_final_iqr')}, group_label, n_unique_labels, slice FROM
      (SELECT entry_id, count(*) AS n_runs, avg(val_loss_final) AS m, quantile_cont(val_loss_final, 0.75) - quantile_cont(val_loss_final, 0.25) AS iqr
       FROM feats JOIN keyed USING (run_id) GROUP BY entry_id)
      LEFT JOIN (SELECT entry_id, arg_max(primary_label, (n, -f)) AS group_label, count(*) AS n_unique_labels FROM
        (SELECT entry_id, primary_label, count(*) AS n, min(ord) AS f FROM keyed WHERE primary_label IS NOT NULL GROUP BY ALL) GROUP BY entry_id) USING (entry_id)
      LEFT JOIN (SELECT entry_id, CASE WHEN count(DISTINCT slice) > 1 THEN 'mixed' ELSE max(slice) END AS slice FROM parts GROUP BY entry_id) USING (entry_id)""",
    [*features_sql("history", {"val_loss_final": BASE["val_loss_final"]})[1], _KEYED, _parts("keyed")]))
def _(t):
    runs = D.runs_small(t)
    f = cut_lineage(curves.curve_features(D.history(t)).select("run_id", "val_loss_final"))
    out = grouped.grouped_table(f, runs, partition_runs(runs, SATURATED), ["val_loss_final"])
    return rounded(out.select("entry_id", "n_runs", "val_loss_final__mean", "stab_val_loss_final_iqr", "group_label", "n_unique_labels", "slice"))


# --- prototypes ----------------------------------------------------------------------------------

_LONG = ("lng", "SELECT vec_id, (" + "[" + ", ".join(f"'{c}'" for c in CLASSES) + "])[(label % 6) + 1] AS class, unnest(range(0, 64)) AS feature, unnest(e) AS v FROM vec")
_BANK = [
    _LONG,
    ("allf", "SELECT feature, avg(v) AS m, stddev_pop(v) + 1e-9 AS s FROM lng GROUP BY feature"),
    ("bank", "SELECT class, feature, avg(v) AS p, m, s, (avg(v) - m) / s AS z FROM lng JOIN allf USING (feature) GROUP BY class, feature, m, s"),
]


@query("prototype_bank", "R0", with_ctes(["vec"], f"""
    SELECT class, feature, {r('p', 'mean')}, {r('m', 'train_mean')}, {r('s', 'train_std')}, {r('z', 'z')} FROM bank""", _BANK))
def _(t):
    b = prototypes.prototype_bank(D.feature_vectors(t))
    return rounded(b.withColumn("feature", F.col("feature").cast("long")))


@query("prototype_distances", "R1 R2 J6", with_ctes(["vec"], """
    SELECT 'v' || vec_id AS run_id, """ + ", ".join(
        r(f"max(neuc) FILTER (WHERE class = '{c}')", f"proto_neuc_{c}") + ", " + r(f"max(corr) FILTER (WHERE class = '{c}')", f"proto_corr_{c}") for c in CLASSES)
    + " FROM d GROUP BY vec_id", [
        *_BANK,
        ("rm", "SELECT vec_id, avg(v) AS mx FROM lng GROUP BY vec_id"),
        ("pm", "SELECT class, avg(p) AS mp FROM bank GROUP BY class"),
        ("d", """SELECT l.vec_id, b.class, sqrt(sum(((l.v - b.m) / b.s - b.z) ** 2)) AS neuc,
            1 - sum((l.v - mx) * (b.p - mp)) / sqrt(sum((l.v - mx) ** 2) * sum((b.p - mp) ** 2) + 1e-30) AS corr
            FROM lng l JOIN rm USING (vec_id) JOIN bank b USING (feature) JOIN pm ON pm.class = b.class GROUP BY l.vec_id, b.class"""),
    ]))
def _(t):
    x = D.feature_vectors(t)
    return rounded(prototypes.prototype_distances(x, prototypes.prototype_bank(x)))


_CURVE_PROTO = ("curve_protos", """SELECT primary_label AS class, pos, median(CASE WHEN isfinite(val_loss) THEN val_loss END) AS value FROM
    (SELECT *, min(n) OVER (PARTITION BY primary_label) AS m FROM
      (SELECT h.*, primary_label, count(*) OVER (PARTITION BY run_id) AS n FROM history h JOIN runs_small USING (run_id) WHERE primary_label IS NOT NULL))
    WHERE pos < m GROUP BY ALL HAVING value IS NOT NULL""")


@query("curve_prototypes", "R3", with_ctes(["history", "runs_small"], f"SELECT class, pos, {r('value', 'value')} FROM curve_protos", [_CURVE_PROTO]))
def _(t):
    return rounded(prototypes.curve_prototypes(cut_lineage(D.history(t)), D.runs_small(t)))


#: Distances of values with two decimals often end in a five; a factor moves them off the ties of rounding.
_OFF_TIES = 0.9137
# The warping recursion one curve point at a time: a row of costs is the prefix minimum of what can be reached, plus prefix sums.
_DTW = [
    _CURVE_PROTO,
    ("proto_pts", "SELECT class, row_number() OVER (PARTITION BY class ORDER BY pos) AS j, value FROM curve_protos"),
    ("proto_len", "SELECT class, max(j) AS m FROM proto_pts GROUP BY class"),
    ("run_pts", "SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS i, val_loss AS x FROM history WHERE isfinite(val_loss)"),
    ("warp", """SELECT run_id, class, 0::BIGINT AS i, j, CASE WHEN j = 0 THEN 0e0 ELSE 'inf'::DOUBLE END AS cost
        FROM (SELECT DISTINCT run_id FROM run_pts), (SELECT class, j FROM proto_pts UNION ALL SELECT class, 0 FROM proto_len)
      UNION ALL
      SELECT run_id, class, i + 1, j, CASE WHEN j = 0 THEN 'inf'::DOUBLE ELSE total + min(reach - (total - d)) OVER (PARTITION BY run_id, class ORDER BY j) END FROM (
        SELECT *, sum(d) OVER (PARTITION BY run_id, class ORDER BY j) AS total FROM (
          SELECT w.run_id, w.class, w.i, w.j, CASE WHEN w.j = 0 THEN 0e0 ELSE abs(x - value) END AS d,
            least(cost, coalesce(lag(cost) OVER (PARTITION BY w.run_id, w.class ORDER BY w.j), 'inf'::DOUBLE)) AS reach
          FROM warp w JOIN run_pts p ON p.run_id = w.run_id AND p.i = w.i + 1 LEFT JOIN proto_pts q ON q.class = w.class AND q.j = w.j))"""),
    ("warped", """SELECT w.run_id, w.class, w.cost / (n + m) AS d FROM warp w JOIN proto_len l ON l.class = w.class AND l.m = w.j
        JOIN (SELECT run_id, max(i) AS n FROM run_pts GROUP BY run_id) r ON r.run_id = w.run_id AND r.n = w.i"""),
]
_DTW_SQL = with_ctes(["history", "runs_small"], "SELECT run_id, " + ", ".join(
    r(f"max(d) FILTER (WHERE class = '{c}') * {_OFF_TIES}", f"proto_dtw_{c}") for c in CLASSES
) + " FROM (SELECT DISTINCT run_id FROM history) LEFT JOIN warped USING (run_id) GROUP BY run_id", _DTW).replace("WITH ", "WITH RECURSIVE ", 1)


@query("dtw_distances", "R4 J6", _DTW_SQL)
def _(t):
    h = cut_lineage(D.history(t))
    d = prototypes.dtw_distances(h, prototypes.curve_prototypes(h, D.runs_small(t)))
    return rounded(d.select("run_id", *[(F.col(c) * _OFF_TIES).alias(c) for c in d.columns[1:]]))


@query("prototype_feature_table", "R5 J9")
def _(t):
    h, runs = cut_lineage(D.history(t)), D.runs_small(t)
    base = cut_lineage(curves.curve_features(h).select("run_id", "val_loss_final", "val_acc_max"))
    labelled = cleaning.drop_unlabelled(base.join(runs.select("run_id", "primary_label"), "run_id"))
    filled = cleaning.impute_medians(labelled, ["val_loss_final", "val_acc_max"])
    x = filled.select("run_id", F.col("primary_label").alias("y"), F.array("val_loss_final", "val_acc_max").alias("x"))
    dist = prototypes.prototype_distances(x, prototypes.prototype_bank(x))
    dtw = prototypes.dtw_distances(h, prototypes.curve_prototypes(h, runs))
    return rounded(prototypes.assemble(filled, [dist, dtw]))


@query("prototype_block_variants", "R5", with_ctes(["history", "runs_small"], """
    SELECT variant, n::BIGINT AS n_rows, k AS n_features, 0::BIGINT AS n_lost FROM (SELECT count(DISTINCT run_id) AS n FROM history JOIN runs_small USING (run_id) WHERE primary_label IS NOT NULL),
      (VALUES ('base', 2), ('prototypes', 18), ('base+prototypes', 20)) v(variant, k)"""))
def _(t):
    """The three matrices of the prototype experiment: same rows, other blocks."""
    h, runs = cut_lineage(D.history(t)), D.runs_small(t)
    columns = ["val_loss_final", "val_acc_max"]
    labelled = cleaning.drop_unlabelled(curves.curve_features(h).select("run_id", *columns).join(runs.select("run_id", "primary_label"), "run_id"))
    filled = cut_lineage(cleaning.impute_medians(labelled, columns))
    x = filled.select("run_id", F.col("primary_label").alias("y"), F.array(*columns).alias("x"))
    blocks = [prototypes.prototype_distances(x, prototypes.prototype_bank(x)), prototypes.dtw_distances(h, prototypes.curve_prototypes(h, runs))]
    out = None
    for variant in prototypes.VARIANTS:
        m = prototypes.matrix(filled, blocks, variant)
        features = [c for c in m.columns if c not in ("run_id", "primary_label")]
        n = m.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("run_id").isNull()).alias("n_lost")).select(
            F.lit(variant).alias("variant"), "n_rows", F.lit(len(features)).alias("n_features"), "n_lost"
        )
        out = n if out is None else out.unionByName(n)
    return out


@query("exact_quantiles_by_flag", "P3 J14", f"""
    SELECT l_returnflag, {r('quantile_cont(l_extendedprice, 0.25)', 'q25')}, {r('quantile_cont(l_extendedprice, 0.5)', 'q50')},
      {r('quantile_cont(l_extendedprice, 0.95)', 'q95')} FROM lineitem GROUP BY l_returnflag""")
def _(t):
    q = exact_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q95": 0.95})
    return rounded(q)


@query("quantiles_one_key", "P3 J14", f"""
    SELECT {r('quantile_cont(l_extendedprice, 0.25)', 'q25')}, {r('quantile_cont(l_extendedprice, 0.5)', 'q50')},
      {r('quantile_cont(l_extendedprice, 0.95)', 'q95')} FROM lineitem""")
def _(t):
    return rounded(exact_quantiles(t.lineitem, [], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q95": 0.95}))
