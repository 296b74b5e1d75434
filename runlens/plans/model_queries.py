"""Folds, models, cascade training, out-of-fold predictions, stacking, stored tables, live runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions.probs import items
from runlens.operators import cascade, cleaning, conformal, curves, grouped, isotonic, policies, prototypes, thresholds, training, zoo
from runlens.operators.folds import assign_folds, class_weights, group_folds, holdout, safe_fold_count
from runlens.operators.metrics import confusion_cells, summary
from runlens.operators.partition import partition_runs
from runlens.operators.stacking import META_FEATURES
from runlens.plans.diagnose_fleet import diagnose_fleet
from runlens.plans.oracle import CLS, r, rcols, with_ctes
from runlens.plans.registry import query, rounded
from runlens.session import cut_lineage
from runlens.sources import driver_tables as D
from runlens.sources import stores
from runlens.streaming import live
from runlens.vocab import CLASSES, labels_array

P = [f"p_{c}" for c in CLASSES]


def _x(t, separable=True):
    """Feature rows as a stored table."""
    return cut_lineage(D.feature_vectors(t, separable).select("run_id", "y", "x", "entry_id"))


# --- folds ---------------------------------------------------------------------------------------


@query("stratified_folds", "M1", with_ctes(["runs_bulk"], """
    SELECT primary_label, f AS fold, (n - f + 4) // 5 AS n FROM (SELECT primary_label, count(*) AS n FROM runs_bulk WHERE primary_label IS NOT NULL GROUP BY 1), (SELECT unnest(range(5)) AS f)"""))
def _(t):
    b = cut_lineage(D.runs_bulk(t).where("primary_label is not null").select("run_id", "primary_label"))
    f = assign_folds(b, "primary_label", safe_fold_count(b, "primary_label"))
    return f.groupBy("primary_label", F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("fold_leaks", "M1 J5", with_ctes(["runs_bulk"], """
    SELECT entry_id, count(DISTINCT ord % 5) AS n_folds FROM runs_bulk WHERE entry_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT ord % 5) > 1"""))
def _(t):
    # Folds dealt by place split entries; the check must find each of them.
    return training.fold_leaks(D.runs_bulk(t).withColumn("fold", F.col("ord") % 5), "entry_id")


@query("class_weights", "M3", with_ctes(["runs_bulk"], f"""
    SELECT primary_label, n AS n_runs, {r('sum(n) OVER () / (count(*) OVER () * n)', 'weight')} FROM (SELECT primary_label, count(*) AS n FROM runs_bulk WHERE primary_label IS NOT NULL GROUP BY 1)"""))
def _(t):
    w = class_weights(D.runs_bulk(t).where("primary_label is not null"), "primary_label")
    return rounded(w.groupBy("primary_label").agg(F.count(F.lit(1)).alias("n_runs"), F.max("weight").alias("weight")))


@query("stage_subsets", "M5", with_ctes(["runs_bulk"], """
    SELECT 'stage1' AS stage, CASE WHEN primary_label = 'healthy' THEN 'healthy' ELSE 'faulty' END AS stage_y, count(*) AS n FROM runs_bulk WHERE primary_label IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'stage2', CASE WHEN primary_label IN ('leakage', 'label_noise') THEN 'data_related' ELSE 'optimization_or_generalization_related' END, count(*) FROM runs_bulk WHERE primary_label <> 'healthy' GROUP BY ALL
    UNION ALL SELECT CASE WHEN primary_label IN ('leakage', 'label_noise') THEN 'stage3_data' ELSE 'stage3_opt' END, primary_label, count(*) FROM runs_bulk WHERE primary_label <> 'healthy' GROUP BY ALL"""))
def _(t):
    b = D.runs_bulk(t)
    out = None
    for s in training.STAGES:
        n = training.stage_rows(b, s, "primary_label").groupBy(F.lit(s).alias("stage"), "stage_y").agg(F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


# --- models --------------------------------------------------------------------------------------


def _report(model, test, name):
    pred = model.predict(test).select(F.col("y").alias("y_true"), "pred", F.lit(name).alias("model"))
    return summary(confusion_cells(pred, ["model"]), ["model"])


def _register_model(kind: str, ids: str, **options) -> None:
    @query(f"model_{kind}", ids)
    def _(t):
        train, test = (cut_lineage(p) for p in holdout(_x(t), "y"))
        return rounded(_report(zoo.fit(train, CLASSES, kind=kind, **options), test, kind))


_register_model("logistic", "M2 M3")
_register_model("random_forest", "M2")
_register_model("boosted", "M2")
_register_model("entropy_tree", "M9")


_KINDS = ("logistic", "random_forest", "entropy_tree")
_SELECT = {"random_forest": {"trees": 40}}


def _split(t):
    """(train, test) of the separable rows, with a slice by entry."""
    rows = _x(t).withColumn("slice", F.when(F.col("entry_id") % 3 == 0, "extended").otherwise("core"))
    return tuple(cut_lineage(p) for p in holdout(rows, "y"))


@query("model_selection", "M4 M6")
def _(t):
    """Winners of every stage and of the flat model, refitted, judged on one shared holdout over full, core and extended."""
    train, test = _split(t)
    models = training.select_models(train, _KINDS, options=_SELECT)
    rep = training.slice_reports(training.holdout_predictions(models, test, ("run_id", "y", "slice")))
    won = models.scores.where("chosen").groupBy().pivot("stage", ["flat", *training.STAGES]).agg(F.first("kind"))
    return rounded(rep.crossJoin(F.broadcast(won)))  # one row of names


_BY_CLASS = ("by_class", f"SELECT ({CLS})[(label % 6) + 1] AS y, count(*) AS n FROM embeddings GROUP BY 1")
_STAGE_N = """SELECT 'flat' AS stage, sum(n - (n + 4) // 5) AS n FROM by_class UNION ALL SELECT 'stage1', sum(n - (n + 4) // 5) FROM by_class
    UNION ALL SELECT 'stage2', sum(n - (n + 4) // 5) FROM by_class WHERE y <> 'healthy'
    UNION ALL SELECT 'stage3_data', sum(n - (n + 4) // 5) FROM by_class WHERE y IN ('leakage', 'label_noise')
    UNION ALL SELECT 'stage3_opt', sum(n - (n + 4) // 5) FROM by_class WHERE y IN ('overfitting', 'underfitting', 'instability')"""


@query("selection_counts", "M4 M6 J5", with_ctes([], f"""
    SELECT stage, kind, n::BIGINT AS n_samples, 5 AS n_folds, 1::BIGINT AS n_chosen, 0::BIGINT AS n_leaked FROM ({_STAGE_N}), (VALUES ('logistic'), ('entropy_tree')) k(kind)""", [_BY_CLASS]))
def _(t):
    """Every training row of a stage is judged once per kind, one kind wins, and no key is on both sides of the holdout."""
    train, test = _split(t)
    got = training.select_models(train, ("logistic", "entropy_tree"), options={"logistic": {"iterations": 5}}).scores
    chosen = got.groupBy("stage").agg(F.count_if("chosen").alias("n_chosen"))
    leaked = train.select("run_id").intersect(test.select("run_id")).agg(F.count(F.lit(1))).scalar()
    return got.join(chosen, "stage").select("stage", "kind", "n_samples", "n_folds", "n_chosen", leaked.alias("n_leaked"))


@query("holdout_support", "M6", with_ctes([], """
    SELECT model, y, ((n + 4) // 5)::BIGINT AS support, ((n + 4) // 5)::BIGINT AS support_of_slices FROM by_class, (VALUES ('flat'), ('cascade')) m(model)""", [_BY_CLASS]))
def _(t):
    train, test = _split(t)
    models = training.select_models(train, ("entropy_tree",), k=2)
    seen = training.holdout_predictions(models, test, ("run_id", "y", "slice")).where("pred is not null")
    return seen.groupBy("model", "y").agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("slice").isin("core", "extended")).alias("support_of_slices"))


@query("group_fold_checks", "M12 M11 J5", with_ctes(["runs_bulk"], """
    SELECT count(*) AS n_rows, count(DISTINCT entry_id) AS n_groups, 5::BIGINT AS n_folds, 0::BIGINT AS n_leaks, 0::BIGINT AS n_lost, true AS even
    FROM runs_bulk WHERE primary_label IS NOT NULL"""))
def _(t):
    """Whole entries in one fold each; no label's fold differs from its share by more than a fifth."""
    b = cut_lineage(D.runs_bulk(t).where("primary_label is not null").select("run_id", "entry_id", "primary_label"))
    f = cut_lineage(group_folds(b, "entry_id", "primary_label"))
    leaks = training.fold_leaks(f, "entry_id").agg(F.count(F.lit(1))).scalar()
    share = f.groupBy("primary_label", "fold").agg(F.count(F.lit(1)).alias("n")).groupBy("primary_label").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    even = share.agg(F.max(F.col("most") * 5 / F.col("n")) <= 1.2).scalar()
    return f.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entry_id").alias("n_groups"), F.countDistinct("fold").alias("n_folds"),
        leaks.alias("n_leaks"), F.count_if(F.col("fold").isNull()).alias("n_lost"), even.alias("even"),
    )


def _register_calibration(method: str) -> None:
    @query(f"calibrated_{method}", "M7")
    def _(t):
        train, test = (cut_lineage(p) for p in holdout(_x(t), "y"))
        model = zoo.fit_calibrated(train, CLASSES, method=method, kind="entropy_tree")
        out = model.probabilities(test.select("run_id", "y", "x"))
        return rounded(out.select("run_id", "y", *[v.alias(n) for n, v in zip(P, items(F.col("p"), 6))]))


for _method in ("isotonic", "sigmoid"):
    _register_calibration(_method)


# Max-min formula: the fit at a point is the largest, over starts before it, of the least mean from that start to any later end.
_CURVE = [
    ("scored", "SELECT vec_id, c AS key, flat[c + 1] AS x, (y_true = (" + CLS + ")[c + 1])::INT::DOUBLE AS y FROM preds, (SELECT unnest(range(6)) AS c)"),
    ("pts", "SELECT key, x, sum(y) AS s, count(*) AS w, row_number() OVER (PARTITION BY key ORDER BY x) AS i FROM scored GROUP BY key, x"),
    ("cum", "SELECT *, sum(s) OVER (PARTITION BY key ORDER BY i) AS cs, sum(w) OVER (PARTITION BY key ORDER BY i) AS cw FROM pts"),
    ("spans", "SELECT a.key, a.i AS j, b.i AS k, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM cum a JOIN cum b ON b.key = a.key AND b.i >= a.i"),
    ("least", "SELECT key, j, k AS i, min(m) OVER (PARTITION BY key, j ORDER BY k DESC) AS m FROM spans"),
    ("curve", "SELECT key, i, max(m) AS fitted FROM least GROUP BY key, i"),
]


@query("isotonic_curves", "M7", with_ctes(["preds"], f"""
    SELECT 'v' || vec_id AS run_id, key, {r('fitted', 'fitted')} FROM scored JOIN pts USING (key, x) JOIN curve USING (key, i)""", _CURVE))
def _(t):
    each = F.posexplode("flat").alias("key", "x")
    rows = D.predictions(t).select("run_id", "y_true", each).withColumn("key", F.col("key").cast("long"))
    rows = cut_lineage(rows.withColumn("y", (F.col("y_true") == F.get(labels_array(), F.col("key").cast("int"))).cast("double")))
    return rounded(isotonic.fitted_values(rows, isotonic.fit_blocks(rows)).select("run_id", "key", "fitted"))


@query("model_importances", "M10 X1")
def _(t):
    model = zoo.fit(_x(t), CLASSES, kind="random_forest")
    return rounded(t.spark.createDataFrame(list(model.importances().items()), "feature string, importance double"))


@query("trained_cascade_diagnoses", "M6 C2 C5 X16")
def _(t):
    train, test = (cut_lineage(p) for p in holdout(_x(t), "y"))
    scored = training.train_cascade(train).score(test.select("run_id", "y", "x"))
    return rounded(cascade.flatten(cascade.diagnose(scored)))


@query("cascade_saved_and_loaded", "S20")
def _(t):
    train, test = (cut_lineage(p) for p in holdout(_x(t), "y"))
    path = live.new_folder(t.spark, "cascade")
    training.save_cascade(training.train_cascade(train, kind="entropy_tree"), path)
    scored = training.load_cascade(t.spark, path).score(test.select("run_id", "y", "x"))
    return rounded(cascade.flatten(cascade.diagnose(scored)).select("run_id", "final_class", "final_confidence"))


def _oof(t):
    return cut_lineage(training.with_no_arbitrator(training.oof_predictions(_x(t, separable=True), kind="entropy_tree")).drop("x"))


def _meta_split(oof):
    """Rows for the meta model, for calibration, and held-out ones, by the folds the rows have."""
    return oof.where("fold < 3"), oof.where("fold = 3"), oof.where("fold = 4")


@query("oof_predictions", "M8")
def _(t):
    oof = _oof(t)
    return rounded(oof.select("run_id", "y", "fold", *[v.alias(n) for n, v in zip(P, items(F.col("cascade"), 6))]))


@query("oof_checks", "M8", "SELECT count(*) AS n_present, 0::BIGINT AS n_incomplete, count(*) AS n_expected, 0::BIGINT AS n_lost, 0::BIGINT AS n_duplicate FROM embeddings")
def _(t):
    return training.check_oof(D.feature_vectors(t), _oof(t))


@query("oof_threshold_sweep", "E23 E22")
def _(t):
    x = _x(t)
    stage1 = training.stage_rows(x, "stage1").select("run_id", "y", "x", "stage_y")
    scored = zoo.out_of_fold(stage1, ("healthy", "faulty"), k=5, label="stage_y")
    rows = scored.select(F.col("y").alias("y_true"), F.get("p", F.lit(0)).alias("p_healthy"))
    return rounded(thresholds.binary_sweep(rows))


@query("stacking_predictions", "K2 K3")
def _(t):
    """Held-out rows by a meta model that saw none of them, each with its own strongest meta features."""
    train, _, test = _meta_split(_oof(t))
    out = training.train_meta(train).predict(test, ("run_id", "y"))
    top = F.transform("top_features", lambda e: e["column"])
    return rounded(out.select("run_id", "y", "final_label", "final_confidence", F.concat_ws("|", top).alias("top_features")))


def _conformal_rows(t):
    train, calibration, test = _meta_split(_oof(t))
    meta = training.train_meta(train)
    seen = meta.predict(calibration, ("run_id", "y")).select(F.col("y").alias("y_true"), F.col("stacked").alias("p"))
    cal = conformal.calibrate(conformal.scores(cut_lineage(seen)), (0.1,))
    stacked = meta.predict(test, ("run_id", "y"))
    pred = conformal.predict(stacked.withColumn("p", F.col("stacked")), conformal.quantile_of(cal))
    labels = policies.with_labels(test.select("run_id", "flat", "cascade")).select("run_id", "flat_label", "cascade_label")
    path = F.when(F.col("is_abstained"), "conformal_abstained").otherwise("stacking")
    return pred.join(labels, "run_id").withColumn("resolution_path", path)


@query("stacking_conformal_rows", "K4 U7")
def _(t):
    """Meta model, conformal quantile and judged rows come from three disjoint parts."""
    out = _conformal_rows(t)
    return rounded(out.select("run_id", "y", "final_label", "final_confidence", "flat_label", "cascade_label", "resolution_path", "set_size", F.concat_ws("|", "prediction_set").alias("prediction_set")))


@query("stacking_conformal_checks", "K2 K4 U7", with_ctes([], """
    SELECT sum(n // 5)::BIGINT AS n_rows, sum(n // 5)::BIGINT AS n_keys, 0::BIGINT AS n_empty_sets, 0::BIGINT AS n_without_point, 0::BIGINT AS n_wrong_path, true AS covers FROM by_class""", [_BY_CLASS]))
def _(t):
    """Held-out rows once each, sets that hold their point prediction, paths that follow the sets, coverage not far below its target."""
    out = _conformal_rows(t)
    hit = F.array_contains("prediction_set", F.col("y")).cast("double")
    return out.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("run_id").alias("n_keys"), F.count_if(F.size("prediction_set") == 0).alias("n_empty_sets"),
        F.count_if(~F.array_contains("prediction_set", F.col("point_prediction"))).alias("n_without_point"),
        F.count_if((F.size("prediction_set") > 1) != (F.col("resolution_path") == "conformal_abstained")).alias("n_wrong_path"),
        (F.avg(hit) >= 0.75).alias("covers"),
    )


@query("stacking_without_arbitrator", "M11 K2")
def _(t):
    oof = _oof(t)
    rows = []
    for name, drop in (("all", ()), ("no_arbitrator", META_FEATURES[-8:])):
        rows.append((name, training.train_meta(oof, drop=drop).cv_macro_f1))
    return rounded(t.spark.createDataFrame(rows, "variant string, cv_macro_f1 double"))


def _ablation_rows(t):
    """(train, test, variants) over whole entries: base, integrity and prototype blocks; medians and prototypes from the training rows."""
    runs = grouped.group_key(D.runs_small(t)).where("primary_label is not null").select("run_id", "entry_id", F.col("primary_label").alias("y"))
    full = curves.full_features(cut_lineage(D.history(t)))
    proxies = [c for c in curves.PROXY_FEATURES if c not in curves.BASE_FEATURES]
    columns = [*curves.BASE_FEATURES, *proxies]
    folded = cut_lineage(group_folds(cut_lineage(full.select("run_id", *columns).join(runs, "run_id")), "entry_id", "y"))
    train = folded.where("fold <> 0")
    filled = cut_lineage(cleaning.impute_medians(folded, columns, cleaning.column_medians(train, columns)))
    x = filled.select("run_id", "y", "fold", F.array(*curves.BASE_FEATURES).alias("x"))
    near = prototypes.prototype_distances(x, prototypes.prototype_bank(x.where("fold <> 0").select("run_id", "y", "x")))
    blocks = [c for c in near.columns if c.startswith("proto_")]
    rows = cut_lineage(filled.join(near, "run_id").select("run_id", "entry_id", "y", "fold", F.array(*columns, *[F.coalesce(c, F.lit(0.0)) for c in blocks]).alias("x")))
    base, integrity = list(range(len(curves.BASE_FEATURES))), list(range(len(curves.BASE_FEATURES), len(columns)))
    proto = list(range(len(columns), len(columns) + len(blocks)))
    variants = {"base": base, "base+integrity": base + integrity, "base+prototypes": base + proto, "all": base + integrity + proto}
    return rows.where("fold <> 0"), rows.where("fold = 0"), variants


@query("feature_ablation", "M11 P5")
def _(t):
    """The same trainer on the real blocks, judged on entries that it never saw."""
    train, test, variants = _ablation_rows(t)
    reps = cut_lineage(training.ablation(train, test, variants, kind="entropy_tree"))
    out = reps.select("variant", "n_features", "n_samples", "accuracy", "macro_f1", "leakage_f1")
    verdicts = [F.when(F.col("variant") == v, training.ablation_verdict(reps, "base", v).select("verdict").scalar()) for v in variants if v != "base"]
    return rounded(out.withColumn("verdict", F.coalesce(*verdicts)))


@query("ablation_holdout_checks", "M11 M12 J5", with_ctes(["runs_small"], """
    SELECT count(*) AS n_rows, 0::BIGINT AS n_leaked_entries, 4::BIGINT AS n_variants, 73::BIGINT AS n_features FROM
      (SELECT DISTINCT run_id FROM runs_small WHERE primary_label IS NOT NULL)"""))
def _(t):
    train, test, variants = _ablation_rows(t)
    both = train.select("entry_id").intersect(test.select("entry_id")).agg(F.count(F.lit(1))).scalar()
    return train.unionByName(test).agg(
        F.count(F.lit(1)).alias("n_rows"), both.alias("n_leaked_entries"), F.lit(len(variants)).cast("long").alias("n_variants"),
        F.max(F.size("x")).cast("long").alias("n_features"),
    )


@query("grouped_baseline", "M12")
def _(t):
    """One row per entry; held-out entries over full and their slices."""
    runs = D.runs_small(t)
    columns = ["val_loss_final", "val_acc_max", "loss_mean_gap", "train_acc_slope"]
    f = cut_lineage(curves.curve_features(D.history(t)).select("run_id", *columns))
    table = grouped.grouped_table(f, runs, partition_runs(runs), columns).where("group_label is not null")
    numbers = [c for c, kind in table.dtypes if kind == "double"]
    rows = cut_lineage(table.select(F.col("entry_id").alias("run_id"), F.col("group_label").alias("y"), "slice", *numbers))
    train, test = (cut_lineage(p) for p in holdout(rows, "y"))
    medians = cleaning.column_medians(train, numbers)
    train, test = (cut_lineage(cleaning.impute_medians(p, numbers, medians).withColumn("x", F.array(*numbers)).select("run_id", "y", "slice", "x")) for p in (train, test))
    model = zoo.fit(train, CLASSES, kind="entropy_tree")
    seen = model.predict(test).withColumn("model", F.lit("grouped_entropy_tree"))
    return rounded(training.slice_reports(seen))


@query("fleet_diagnosis", "X16")
def _(t):
    """Curves of every user to evidence and actions, with stages trained on the labelled runs."""

    h = cut_lineage(D.history(t))
    out = diagnose_fleet(h, D.meta(t), D.runs_small(t).select("run_id", "primary_label"), kind="entropy_tree")
    return rounded(out.select("run_id", "final_class", "final_confidence", "stage1_pred", "summary", F.concat_ws(",", "actions").alias("actions")))


# --- stored tables -------------------------------------------------------------------------------


@query("adapted_features", "S11 J1", with_ctes(["runs_bulk"], """
    SELECT 'o' || o_orderkey AS run_id, o_custkey::DOUBLE AS o_custkey, o_totalprice, primary_label FROM orders JOIN runs_bulk ON ord = o_orderkey"""))
def _(t):
    table = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("run_id"), "o_custkey", "o_totalprice", "o_orderstatus")
    path = live.new_folder(t.spark, "features")
    table.write.parquet(path)
    return stores.adapt_features(stores.read_features(t.spark, path), D.runs_bulk(t))


@query("oof_store", "S12", with_ctes(["preds"], f"SELECT run_id, vec_id % 5 AS fold, {r('flat[2]', 'flat_overfitting')}, {r('cascade[6]', 'cascade_instability')}, {r('stage_probs[9]', 'stage_last')}, 0::INT AS arb_triggered FROM preds"))
def _(t):
    p = training.with_no_arbitrator(D.predictions(t)).withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    path = live.new_folder(t.spark, "oof")
    stores.write_oof(p, path)
    o = stores.read_oof(t.spark, path)
    return rounded(o.select(
        "run_id", F.col("fold").cast("long").alias("fold"), F.get("flat", F.lit(1)).alias("flat_overfitting"),
        F.get("cascade", F.lit(5)).alias("cascade_instability"), F.get("stage_probs", F.lit(8)).alias("stage_last"), "arb_triggered",
    ))


_SINK_SQL = with_ctes(["diagnosis"], f"SELECT run_id, final_class, {r('final_confidence', 'final_confidence')}, stage1_pred FROM diagnosis")


def _register_sink(fmt: str) -> None:
    @query(f"diagnosis_sink_{fmt}", "S17", _SINK_SQL)
    def _(t):
        path = live.new_folder(t.spark, f"diagnoses-{fmt}")
        flat = cascade.flatten(cascade.diagnose(D.predictions(t)))
        stores.write_diagnoses(flat, path, fmt, partition="stage1_pred")
        back = t.spark.read.schema(flat.schema)
        back = back.option("header", True).csv(path) if fmt == "csv" else back.json(path) if fmt == "json" else back.parquet(path)
        return rounded(back.select("run_id", "final_class", "final_confidence", "stage1_pred"))


for _fmt in ("json", "csv", "parquet"):
    _register_sink(_fmt)


# --- live runs -----------------------------------------------------------------------------------


def _epochs(t):
    """``events`` as a stream of epoch rows."""
    s = live.read_epochs(t.spark, t.root, t.events.schema, "events.parquet")
    return s.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"),
        F.when(F.col("event_type") != "error", F.floor(F.col("event_id") / 2)).alias("epoch"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value"),
        F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").alias("status"),
    )


@query("live_ingest", "T1 P9", """
    SELECT run_id, count(*) AS n, max(epoch) AS last_epoch FROM (SELECT DISTINCT 'u' || user_id AS run_id, event_id // 2 AS epoch FROM events
      WHERE event_type <> 'error' AND NOT (user_id % 10 = 0 AND ts > TIMESTAMP '2024-01-15 00:00:00')) GROUP BY run_id""")
def _(t):
    u = t.events.select("user_id").distinct().where("user_id % 10 = 0")
    finished = u.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), F.to_timestamp(F.lit("2024-01-15 00:00:00")).alias("finalized_at"))
    rows = live.run_append(live.ingest(_epochs(t), finished), "ingest")
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("last_epoch"))


@query("live_lifecycle", "T2", """
    WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM
      (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL)::INT AS new FROM events))
    SELECT 'u' || user_id AS run_id, count(*) AS n_epochs_logged, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us, epoch_us(min(ts)) AS started_us,
      CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'purchase') THEN 'completed' ELSE 'interrupted' END AS status
    FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    rows = live.run_append(live.lifecycle(_epochs(t)), "lifecycle")
    return rows.select("run_id", "n_epochs_logged", "duration_us", F.unix_micros("started_at").alias("started_us"), "status")


@query("live_scored_diagnoses", "T4", _SINK_SQL)
def _(t):
    s = live.read_epochs(t.spark, t.root, t.embeddings.schema, "embeddings.parquet")

    class Stream:
        embeddings = s

    rows = live.run_diagnoses(D.predictions(Stream()).select("run_id", "stage_probs"), "diagnoses")
    return rounded(rows.select("run_id", "final_class", "final_confidence", "stage1_pred"))


