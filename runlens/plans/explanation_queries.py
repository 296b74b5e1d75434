"""Evidence, actions, patch outcomes, narratives and the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import actions, attribution, cascade, evidence, linear_stages, narrative, patches, policies, reports, training
from runlens.operators.evidence import NOTE_KEYWORDS
from runlens.operators.narrative import MESSAGES
from runlens.plans.oracle import BRANCH_OF, CLASSES, q, r, rcols, top, with_ctes
from runlens.plans.registry import query, rounded
from runlens.sources import driver_tables as D
from runlens.streaming import live

# --- inputs: features per vector -----------------------------------------------------------------

_FEATURES = {
    "n_epochs": ("20e0", lambda e, k: F.lit(20.0)),
    "val_loss_argmin_frac": ("least(abs(e[15]) * 4e0, 1e0)", lambda e, k: F.least(F.abs(e(14)) * 4.0, F.lit(1.0))),
    "acc_final_gap": ("e[16]", lambda e, k: e(15)),
    "acc_max_gap": ("e[16] + 1e-1", lambda e, k: e(15) + 0.1),
    "diverged": ("(vec_id % 9 = 0)::INT::DOUBLE", lambda e, k: (k % 9 == 0).cast("double")),
    "train_loss_final": ("abs(e[17]) * 8e0", lambda e, k: F.abs(e(16)) * 8.0),
    "val_loss_final": ("abs(e[18])", lambda e, k: F.abs(e(17))),
    "val_loss_min": ("abs(e[18]) / 2e0", lambda e, k: F.abs(e(17)) / 2.0),
    "di_train_val_overlap": ("CASE WHEN vec_id % 3 = 0 THEN abs(e[19]) / 5e0 END", lambda e, k: F.when(k % 3 == 0, F.abs(e(18)) / 5.0)),
    "di_label_noise_rate_declared": ("CASE WHEN vec_id % 4 = 0 THEN abs(e[20]) END", lambda e, k: F.when(k % 4 == 0, F.abs(e(19)))),
    "di_proxy_saturation": ("9e-1 + abs(e[21])", lambda e, k: F.lit(0.9) + F.abs(e(20))),
    "di_proxy_train_val_lockstep": ("abs(e[22]) * 1e1", lambda e, k: F.abs(e(21)) * 10.0),
}
_FEAT = ("feat", "SELECT 'v' || vec_id AS run_id, " + ", ".join(f"{s} AS {n}" for n, (s, _) in _FEATURES.items()) + " FROM vec")


def features(t):
    def e(i):
        return F.get("e", F.lit(i))

    return D.vectors(t).select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("run_id"),
        *[fn(e, F.col("vec_id")).alias(n) for n, (_, fn) in _FEATURES.items()],
    )


def _evidence(t):
    return evidence.build_evidence(cascade.diagnose(D.predictions(t)), features(t))


# --- evidence ------------------------------------------------------------------------------------

_IMPORTANCE = {
    s: {n: ((i * 7 + j * 3) % 11) / 10.0 for i, n in enumerate(_FEATURES)} for j, s in enumerate(("stage1", "stage2", "stage3_data"))
}
_IMP_ROWS = ", ".join(f"('{s}', '{n}', {i}, {w!r}::DOUBLE)" for s, d in _IMPORTANCE.items() for i, (n, w) in enumerate(d.items()))


@query("top_features", "X1 E19 M10", with_ctes(["vec"], f"""
    SELECT run_id, stage, rank::INT AS rank, "column", {r('value', 'value')}, {r('score', 'score')} FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY score DESC, ord) AS rank FROM (
        SELECT run_id, stage, "column", ord, value, CASE WHEN max(coalesce(abs(value) * w, 0)) OVER (PARTITION BY run_id, stage) > 0 THEN coalesce(abs(value) * w, 0) ELSE w END AS score
        FROM lng JOIN (VALUES {_IMP_ROWS}) i(stage, "column", ord, w) USING ("column"))) WHERE rank <= 5""",
    [_FEAT, ("lng", " UNION ALL ".join(f"SELECT run_id, '{n}' AS \"column\", {n} AS value FROM feat" for n in _FEATURES))]))
def _(t):
    return rounded(evidence.top_features(features(t), _IMPORTANCE))


#: A stored cascade over the same columns; what is loaded again decides the features of the evidence.
_STORED: linear_stages.Weights = {
    (stage, label): {n: ((i * 5 + j * 3 + 1) % 7 - 3) / 4.0 for i, n in enumerate(_FEATURES)}
    for j, (stage, label) in enumerate((s, x) for s, labels in training.STAGES.items() for x in labels)
}


def _loaded_importances(t):
    path = live.new_folder(t.spark, "weights")
    linear_stages.save(t.spark, _STORED, path)
    return linear_stages.importances(linear_stages.load(t.spark, path))


_STORED_ROWS = ", ".join(f"('{s}', '{n}', {i}, {w!r}::DOUBLE)" for s, d in linear_stages.importances(_STORED).items() for i, (n, w) in enumerate(d.items()))
_FITTED = [
    _FEAT, ("lng", " UNION ALL ".join(f"SELECT run_id, '{n}' AS \"column\", {n}::DOUBLE AS value FROM feat" for n in _FEATURES)),
    ("weighed", f"""SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY score DESC, ord) AS rank FROM (
        SELECT run_id, stage, "column", ord, value, CASE WHEN max(coalesce(abs(value) * w, 0)) OVER (PARTITION BY run_id, stage) > 0 THEN coalesce(abs(value) * w, 0) ELSE w END AS score
        FROM lng JOIN (VALUES {_STORED_ROWS}) i(stage, "column", ord, w) USING ("column"))"""),
]


@query("evidence_features", "X7 X16", with_ctes(["vec", "diagnosis"], f"""
    SELECT run_id, final_class, stage, "column", {r('value', 'value')}, {r('score', 'importance')} FROM weighed JOIN diagnosis USING (run_id) WHERE rank <= 5""", _FITTED))
def _(t):
    ev = evidence.build_evidence(cascade.diagnose(D.predictions(t)), features(t), _loaded_importances(t))
    return rounded(ev.select("run_id", "final_class", F.explode("top_features").alias("f")).select("run_id", "final_class", "f.stage", "f.column", "f.value", "f.importance"))


@query("disagreement_features", "E19", with_ctes(["vec", "diagnosis"], f"""
    SELECT run_id, CASE WHEN fl = y_true THEN 'flat' ELSE 'cascade' END AS winner, "column", {r('value', 'value')}, {r('score', 'importance')}
    FROM (SELECT *, {top('flat')} AS fl FROM diagnosis) JOIN weighed USING (run_id)
    WHERE fl <> final_class AND ((fl = y_true) <> (final_class = y_true)) AND stage = 'stage1' AND rank <= 3""", _FITTED))
def _(t):
    p = D.predictions(t)
    rows = attribution.disagreements(cascade.diagnose(p), policies.with_labels(p), features(t), _loaded_importances(t), k=3)
    return rounded(rows.select("run_id", "winner", F.explode("top_evidence").alias("f")).select("run_id", "winner", "f.column", "f.value", "f.importance"))


_CURVE_NOTES = """list_filter([
    CASE WHEN val_loss_argmin_frac >= 0 AND val_loss_argmin_frac < 5e-1 THEN 'val_loss minimum reached at ' || printf('%.0f', val_loss_argmin_frac * 100) || '% of training — early-overfitting fingerprint.' END,
    CASE WHEN acc_final_gap > 15e-2 THEN printf('final train/val accuracy gap = %+.3f — overfitting evidence.', acc_final_gap) END,
    CASE WHEN abs(acc_final_gap) < 1e-2 THEN 'near-zero train/val gap — could indicate either healthy convergence or leakage.' END,
    CASE WHEN diverged > 0 THEN 'history contains NaN/inf in train_loss or val_loss — training diverged.' END], lambda x: x IS NOT NULL)"""
_INTEGRITY_NOTES = """list_filter([
    CASE WHEN di_train_val_overlap > 1e-2 THEN printf('train/val overlap = %.3f — direct leakage signal.', di_train_val_overlap) END,
    CASE WHEN di_proxy_saturation > 95e-2 AND di_proxy_train_val_lockstep > 95e-2 THEN
      printf('saturation=%.3f with high train/val lockstep (%.3f) — strong leakage proxy.', di_proxy_saturation, di_proxy_train_val_lockstep) END], lambda x: x IS NOT NULL)"""
_OWN_NOTES = """list_filter([
    CASE WHEN final_confidence < 5e-1 THEN printf('low final confidence (%.3f) — treat the diagnosis as tentative.', final_confidence) END,
    CASE WHEN stage1_conf < 6e-1 THEN 'Stage 1 (healthy/faulty) is itself uncertain.' END,
    CASE WHEN stage2_conf < 6e-1 THEN 'Stage 2 branch decision is uncertain — both branches are plausible.' END,
    CASE WHEN alt1_p > 25e-2 THEN printf('strong alternative: `%s` (p=%.3f).', alt1, alt1_p) END], lambda x: x IS NOT NULL)"""


@query("curve_notes", "X2", with_ctes(["vec"], f"SELECT run_id, array_to_string({_CURVE_NOTES}, ' | ') AS notes FROM feat", [_FEAT]))
def _(t):
    return features(t).select("run_id", F.concat_ws(" | ", evidence.curve_notes()).alias("notes"))


@query("integrity_notes", "X3", with_ctes(["vec"], f"SELECT run_id, array_to_string({_INTEGRITY_NOTES}, ' | ') AS notes FROM feat", [_FEAT]))
def _(t):
    return features(t).select("run_id", F.concat_ws(" | ", evidence.integrity_notes()).alias("notes"))


_OTHER = f"CASE WHEN stage2_pred = 'data_related' THEN 'optimization_or_generalization_related' ELSE 'data_related' END"


@query("rejected_hypotheses", "X4", with_ctes(["diagnosis"], f"""
    SELECT run_id, string_agg(label || '=' || printf('%.4f', p), ',' ORDER BY p DESC, i) AS rejected FROM (
      SELECT run_id, i, (list_value({', '.join(map(q, CLASSES))}))[i] AS label, class_probs[i] AS p, (list_value({', '.join(q(BRANCH_OF.get(c)) for c in CLASSES)}))[i] AS br, stage1_pred, stage2_pred, {_OTHER} AS loser
      FROM diagnosis, (SELECT unnest(range(1, 7)) AS i))
    WHERE (i = 1 AND stage1_pred = 'faulty') OR (i > 1 AND (stage1_pred = 'healthy' OR br = loser)) GROUP BY run_id"""))
def _(t):
    d = cascade.diagnose(D.predictions(t))
    text = F.transform(evidence.rejected_hypotheses(), lambda e: F.concat(e["label"], F.lit("="), F.format_string("%.4f", e["p"])))
    return d.select("run_id", F.concat_ws(",", text).alias("rejected"))


_DIAG = ("dg", """SELECT d.*, a1.label AS alt1, a1.p AS alt1_p, alts FROM diagnosis d JOIN (SELECT * FROM alternatives WHERE rk = 1) a1 USING (run_id)
    JOIN (SELECT run_id, string_agg('`' || label || '`=' || printf('%.3f', p), ', ' ORDER BY rk) AS alts FROM alternatives WHERE rk <= 3 GROUP BY run_id) USING (run_id)""")


@query("confidence_notes", "X5", with_ctes(["diagnosis", "alternatives"], f"SELECT run_id, array_to_string({_OWN_NOTES}, ' | ') AS notes FROM dg", [_DIAG]))
def _(t):
    return cascade.diagnose(D.predictions(t)).select("run_id", F.concat_ws(" | ", evidence.global_notes()).alias("notes"))


def _supports(note: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({note}), '{k}') THEN '{c}'" for k, c in NOTE_KEYWORDS) + " END"


_EV = [
    _FEAT, _DIAG,
    ("ev0", f"SELECT dg.*, feat.* EXCLUDE (run_id), {_CURVE_NOTES} AS cn, {_INTEGRITY_NOTES} AS inn, {_OWN_NOTES} AS own FROM dg JOIN feat USING (run_id)"),
    ("ev", "SELECT *, list_concat(list_concat(own, cn), inn) AS dn, list_concat(list_concat(cn, inn), list_concat(list_concat(own, cn), inn)) AS al FROM ev0"),
    ("nt", f"SELECT run_id, final_class, i, note, coalesce({_supports('note')} <> final_class, false) AS other FROM (SELECT run_id, final_class, unnest(al) AS note, unnest(range(1, len(al) + 1)) AS i FROM ev)"),
    ("sp", "SELECT run_id, string_agg(note, ' ' ORDER BY i) FILTER (WHERE NOT other) AS dec, string_agg(note, ' ' ORDER BY i) FILTER (WHERE other) AS sec FROM nt GROUP BY run_id"),
]


@query("note_classification", "X6", with_ctes(["diagnosis", "alternatives"], """
    SELECT run_id, coalesce(string_agg(note, ' | ' ORDER BY i) FILTER (WHERE NOT other), '') AS decisive, coalesce(string_agg(note, ' | ' ORDER BY i) FILTER (WHERE other), '') AS secondary
    FROM ev LEFT JOIN nt USING (run_id) GROUP BY run_id""", _EV))
def _(t):
    ev = _evidence(t)
    dec, sec = evidence.split_notes(F.concat("curve_notes", "integrity_notes", "diagnostic_notes"), F.col("final_class"))
    return ev.select("run_id", F.concat_ws(" | ", dec).alias("decisive"), F.concat_ws(" | ", sec).alias("secondary"))


@query("evidence", "X7", with_ctes(["diagnosis", "alternatives"], f"""
    SELECT run_id, final_class, {r('final_confidence', 'final_confidence')}, 'stage1=' || stage1_pred || coalesce(',stage2=' || stage2_pred, '') || coalesce(',stage3=' || stage3_pred, '') AS trace,
      {r('train_loss_final', 'final_train_loss')}, {r('acc_final_gap', 'final_acc_gap')}, diverged > 0 AS diverged, {r('di_train_val_overlap', 'overlap')}, array_to_string(dn, ' | ') AS notes FROM ev""", _EV))
def _(t):
    trace = F.transform("stage_trace", lambda s: F.concat(s["stage"], F.lit("="), s["predicted"]))
    return rounded(_evidence(t).select(
        "run_id", "final_class", "final_confidence", F.concat_ws(",", trace).alias("trace"),
        F.col("curve_evidence.final_train_loss").alias("final_train_loss"), F.col("curve_evidence.final_acc_gap").alias("final_acc_gap"),
        F.col("curve_evidence.diverged").alias("diverged"), F.col("integrity_evidence.di_train_val_overlap").alias("overlap"),
        F.concat_ws(" | ", "diagnostic_notes").alias("notes"),
    ))


# --- actions -------------------------------------------------------------------------------------

_APPLIES = {
    "reduce_lr": "final_class = 'instability' OR diverged > 0",
    "increase_capacity": "final_class = 'underfitting' OR train_loss_final > 1",
    "add_regularization": "final_class = 'overfitting' OR acc_final_gap > 1e-1",
    "early_stop": "final_class = 'overfitting' OR acc_final_gap > 1e-1",
    "clean_label_noise": "final_class = 'label_noise' OR coalesce(di_label_noise_rate_declared > 5e-2, false)",
    "fix_split": "final_class = 'leakage' OR coalesce(di_train_val_overlap > 1e-2, false)",
    "retrain_with_seed": "true",
    "observe_only": "true",
}
_TARGETS = {n: t for n, t, _, _ in actions.ACTIONS}


@query("action_applicability", "X8", with_ctes(["diagnosis", "alternatives"], "SELECT run_id, " + ", ".join(f"({c}) AS applies_{n}" for n, c in _APPLIES.items()) + " FROM ev", _EV))
def _(t):
    return actions.with_applicability(_evidence(t)).select("run_id", *[f"applies_{n}" for n in actions.NAMES])


_RANKED = ("ranked", "SELECT run_id, final_class, action, row_number() OVER (PARTITION BY run_id ORDER BY miss, ord) AS priority FROM (" + " UNION ALL ".join(
    f"SELECT run_id, final_class, '{n}' AS action, {i} AS ord, CASE WHEN final_class IN ({', '.join(map(q, _TARGETS[n]))}) THEN 0 ELSE 1 END AS miss FROM ev WHERE {c}"
    for i, (n, c) in enumerate(_APPLIES.items())) + ")")


@query("recommended_actions", "X9", with_ctes(["diagnosis", "alternatives"], "SELECT run_id, priority::INT AS priority, action FROM ranked WHERE priority <= 3", [*_EV, _RANKED]))
def _(t):
    return actions.recommend(_evidence(t))


def _parameter_requests(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")

    def entry(name, value, when):
        return F.when(when, F.struct(F.lit(name).alias("k"), value.alias("v")))

    action = F.get(F.array(*map(F.lit, (*actions.NAMES, "reboot"))), (k % 9).cast("int"))
    m = k % 9
    pairs = F.array_compact(F.array(
        entry("factor", (size / 40.0).cast("string"), (m == 0) & (k % 2 == 0)),
        entry("scale", F.lit("big"), (m == 1) & (k % 2 == 0)),
        entry("dropout", (size / 50.0).cast("string"), m == 2),
        entry("patience", F.when(k % 2 == 0, (size * 3).cast("string")).otherwise(F.lit("2.5")), m == 3),
        entry("removed_fraction", (size / 80.0).cast("string"), m == 4),
        entry("dedup", F.lit("no"), m == 5),
        entry("colour", F.lit("red"), (m == 6) & (k % 4 == 0)),
    ))
    return t.part.select(F.col("p_partkey"), action.alias("action"), F.map_from_entries(pairs).alias("params"), none.alias("unused")).drop("unused")


_PARAM_SQL = """
    SELECT p_partkey, action, CASE WHEN errors = '' THEN params END AS parameters, errors FROM (SELECT p_partkey,
      (['reduce_lr', 'increase_capacity', 'add_regularization', 'early_stop', 'clean_label_noise', 'fix_split', 'retrain_with_seed', 'observe_only', 'reboot'])[m + 1] AS action,
      CASE m WHEN 0 THEN 'factor=' || printf('%.4f', CASE WHEN p_partkey % 2 = 0 THEN p_size / 4e1 ELSE 1e-1 END) WHEN 1 THEN 'scale=2.0000'
        WHEN 2 THEN 'dropout=' || printf('%.4f', p_size / 5e1) || ',weight_decay=0.0001' WHEN 3 THEN 'patience=' || printf('%.4f', p_size * 3e0) WHEN 4 THEN 'removed_fraction=' || printf('%.4f', p_size / 8e1)
        WHEN 5 THEN 'dedup=0.0000,split_seed=0.0000' WHEN 6 THEN 'seed=1.0000' ELSE '' END AS params,
      CASE m WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 AND p_size / 4e1 > 1 THEN 'factor above 1' ELSE '' END
        WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'scale must be float' ELSE '' END WHEN 2 THEN CASE WHEN p_size / 5e1 > 95e-2 THEN 'dropout above 0.95' ELSE '' END
        WHEN 3 THEN CASE WHEN p_partkey % 2 = 1 THEN 'patience must be int' WHEN p_size * 3 > 100 THEN 'patience above 100' ELSE '' END
        WHEN 4 THEN CASE WHEN p_size / 8e1 > 5e-1 THEN 'removed_fraction above 0.5' ELSE '' END WHEN 6 THEN CASE WHEN p_partkey % 4 = 0 THEN 'unknown parameter: colour' ELSE '' END
        WHEN 8 THEN 'unknown action' ELSE '' END AS errors
      FROM (SELECT *, p_partkey % 9 AS m FROM part))"""


def _param_text(col):
    return F.concat_ws(",", F.array_sort(F.transform(F.map_entries(col), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])))))


@query("validated_parameters", "X10", _PARAM_SQL)
def _(t):
    out = actions.validate_parameters(_parameter_requests(t), ["p_partkey"])
    text = F.when(F.col("parameters").isNotNull(), _param_text(F.col("parameters")))
    return out.select("p_partkey", "action", text.alias("parameters"), F.concat_ws(",", "errors").alias("errors"))


def _advice(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 10 == 0, F.lit('{"recommendations": "none"}')).otherwise(F.concat(
        F.lit('{"recommendations": [{"action_name": "reduce_lr", "parameters": {"factor": '), (size / 40.0).cast("string"),
        F.lit('}, "priority": 2}, {"action_name": "reboot"}, {"action_name": "early_stop", "priority": "soon"}, '),
        F.lit('{"action_name": "fix_split", "parameters": {"dedup": true}, "priority": 0}, {"action_name": "observe_only"}]}')))
    return t.part.select(F.concat(F.lit("p"), k.cast("string")).alias("run_id"), text.alias("response_json"))


@query("vetted_advice", "X11", """
    SELECT 'p' || p_partkey AS run_id, item, action, priority FROM part, (VALUES (0, 'reduce_lr', 2), (2, 'early_stop', 3), (3, 'fix_split', 1), (4, 'observe_only', 5)) a(item, action, priority)
    WHERE p_partkey % 10 <> 0 AND NOT (item = 0 AND p_size / 4e1 > 1) AND NOT (item = 4 AND p_size / 4e1 <= 1)""")
def _(t):
    return actions.vet_advice(_advice(t))[0].select("run_id", "item", "action", "priority")


@query("advice_warnings", "X11", """
    SELECT 'p' || p_partkey AS run_id, item, CASE item WHEN -1 THEN 'no recommendations list' WHEN 0 THEN 'factor above 1' ELSE 'unknown action' END AS errors
    FROM part, (VALUES (-1), (0), (1)) a(item) WHERE (item = -1 AND p_partkey % 10 = 0) OR (p_partkey % 10 <> 0 AND (item = 1 OR (item = 0 AND p_size / 4e1 > 1)))""")
def _(t):
    w = actions.vet_advice(_advice(t))[1]
    return w.select("run_id", "item", F.concat_ws(",", "errors").alias("errors"))


# --- patches -------------------------------------------------------------------------------------


def _cases(t):
    k = F.col("vec_id")
    return t.embeddings.where("vec_id >= 1").select(
        F.concat(F.lit("case"), k.cast("string")).alias("case_id"),
        F.concat(F.lit("v"), k.cast("string")).alias("before"),
        F.concat(F.lit("v"), (k - 1).cast("string")).alias("after"),
        F.get(F.array(*map(F.lit, actions.NAMES)), (k % 8).cast("int")).alias("action"),
    )


_CASES = [
    ("cases", f"SELECT 'case' || vec_id AS case_id, 'v' || vec_id AS before, 'v' || (vec_id - 1) AS after, ([{', '.join(map(q, actions.NAMES))}])[(vec_id % 8) + 1] AS action FROM embeddings WHERE vec_id >= 1"),
    ("pairs", f"""SELECT c.*, b.final_class AS bc, a.final_class AS ac, a.class_probs[1] - b.class_probs[1] AS dh,
        CASE WHEN a.final_class = 'healthy' THEN 0 ELSE list_max(a.class_probs) END - CASE WHEN b.final_class = 'healthy' THEN 0 ELSE list_max(b.class_probs) END AS df
        FROM cases c JOIN diagnosis b ON b.run_id = before JOIN diagnosis a ON a.run_id = after"""),
    ("outcomes", """SELECT *, CASE WHEN action = 'observe_only' THEN 'observe_only' WHEN bc <> 'healthy' AND ac = 'healthy' THEN 'improved' WHEN dh >= 1e-1 AND df <= -5e-2 THEN 'improved'
        WHEN bc = 'healthy' AND ac <> 'healthy' THEN 'degraded' WHEN dh <= -1e-1 THEN 'degraded' WHEN bc <> 'healthy' AND ac <> 'healthy' AND (dh >= 5e-2 OR df <= -5e-2) THEN 'partial' ELSE 'neutral' END AS status FROM pairs"""),
]
_WHY = """CASE WHEN action = 'observe_only' THEN 'action is observe_only — interpreting `after` as a replication. ' || CASE WHEN bc = ac THEN 'classes match → consistent diagnosis under replication.' ELSE 'classes differ (before=' || bc || ', after=' || ac || ') → unstable diagnosis.' END
    WHEN bc <> 'healthy' AND ac = 'healthy' THEN 'before was faulty (' || bc || '); after is healthy.' WHEN dh >= 1e-1 AND df <= -5e-2 THEN printf('P(healthy) increased by %+.3f and P(%s) dropped by %.3f.', dh, bc, -df)
    WHEN bc = 'healthy' AND ac <> 'healthy' THEN 'before was healthy; after became ' || ac || '.' WHEN dh <= -1e-1 THEN printf('P(healthy) decreased by %.3f.', -dh)
    WHEN status = 'partial' THEN 'still faulty, but materially closer to healthy on the cascade.' || CASE WHEN bc <> ac THEN ' faulty class also moved from `' || bc || '` to `' || ac || '`.' ELSE '' END
    ELSE printf('Δ P(healthy) = %+.3f, Δ P(%s) = %+.3f — below material thresholds.', dh, bc, df) END"""


@query("patch_outcomes", "X12 J7", with_ctes(["diagnosis"], f"""
    SELECT case_id, action, bc AS before_class, ac AS after_class, {r('dh', 'delta_p_healthy')}, {r('df', 'delta_p_faulty_chosen')}, status, {_WHY} AS rationale FROM outcomes""", _CASES))
def _(t):
    out = patches.classify(patches.join_cases(_cases(t), cascade.diagnose(D.predictions(t))))
    return rounded(out.select("case_id", "action", "before_class", "after_class", "delta_p_healthy", "delta_p_faulty_chosen", "status", "rationale"))


_META_KEYS = ", ".join(f"({i}, {q(key)})" for i, (_, _, keys, _) in enumerate(actions.ACTIONS) for key in keys)


@query("patch_meta_delta", "X13", f"""
    WITH o AS (SELECT o_orderkey % 3 AS lr, o_orderkey % 2 AS seed, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 END AS patience, o_orderkey FROM orders),
    v AS (SELECT o_orderkey, key, CASE key WHEN 'lr' THEN lr::VARCHAR WHEN 'seed' THEN seed::VARCHAR WHEN 'patience' THEN patience::VARCHAR WHEN 'weight_decay' THEN '0.' || lr WHEN 'dropout' THEN '0.' || seed END AS before_value,
      CASE key WHEN 'lr' THEN '1' WHEN 'seed' THEN '1' WHEN 'patience' THEN '2' WHEN 'weight_decay' THEN '0.1' WHEN 'dropout' THEN '0.1' END AS after_value
      FROM o, (VALUES {_META_KEYS}) a(m, key) WHERE o_orderkey % 8 = m)
    SELECT 'c' || o_orderkey AS case_id, key, before_value, after_value, before_value IS DISTINCT FROM after_value AS changed FROM v""")
def _(t):
    k = F.col("o_orderkey")
    values = F.struct(
        (k % 3).alias("lr"), (k % 2).alias("seed"), F.when(k % 5 != 0, k % 4).alias("patience"),
        F.concat(F.lit("0."), (k % 3).cast("string")).alias("weight_decay"), F.concat(F.lit("0."), (k % 2).cast("string")).alias("dropout"),
    )
    meta = t.orders.select(F.concat(F.lit("o"), k.cast("string")).alias("run_id"), F.to_json(values).alias("meta_json"))
    target = t.spark.range(1).select(
        F.lit("base").alias("run_id"), F.lit('{"lr": 1, "seed": 1, "patience": 2, "weight_decay": "0.1", "dropout": "0.1"}').alias("meta_json")
    )
    cases = t.orders.select(
        F.concat(F.lit("c"), k.cast("string")).alias("case_id"), F.concat(F.lit("o"), k.cast("string")).alias("before"), F.lit("base").alias("after"),
        F.get(F.array(*map(F.lit, actions.NAMES)), (k % 8).cast("int")).alias("action"),
    )
    return patches.meta_delta(cases, meta.unionByName(target))


@query("patch_report", "X14", with_ctes(["diagnosis", "alternatives"], "SELECT case_id, action, status, (" + "CASE action " + " ".join(
    f"WHEN '{n}' THEN final_class IN ({', '.join(map(q, _TARGETS[n]))})" for n in actions.NAMES) + " END) AS in_target, (CASE action " + " ".join(
    f"WHEN '{n}' THEN ({c})" for n, c in _APPLIES.items()) + " END) AS applicable FROM outcomes JOIN ev ON ev.run_id = before", [*_EV, *_CASES]))
def _(t):
    ev = _evidence(t)
    return patches.patch_report(_cases(t), ev, ev).select("case_id", "action", "status", "in_target", "applicable")


# --- narrative -----------------------------------------------------------------------------------


def _msg(lang: str, key: str, **values: str) -> str:
    from string import Formatter

    parts = []
    for text, field, spec, _ in Formatter().parse(MESSAGES[lang][key]):
        if text:
            parts.append("'" + text.replace("'", "''") + "'")
        if field:
            parts.append(f"printf('%{spec}', {values[field]})" if spec else values[field])
    return "(" + " || ".join(parts) + ")"


def _narrative_sql(lang: str) -> str:
    c, p = "final_class", "final_confidence"
    summary = f"CASE WHEN {c} = 'healthy' AND sec IS NOT NULL THEN {_msg(lang, 'summary_healthy_with_secondary', conf=p)} WHEN {c} = 'healthy' THEN {_msg(lang, 'summary_healthy_clean', conf=p)} ELSE {_msg(lang, 'summary_faulty', cls=c, conf=p)} END"
    names = "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {n} IS NOT NULL THEN '{n}' END" for n in ("di_train_val_overlap", "di_label_noise_rate_declared", "di_proxy_saturation", "di_proxy_train_val_lockstep")) + "], lambda x: x IS NOT NULL), ', ')"
    expl = " || ".join([
        _msg(lang, "expl_cascade_class", cls=c, conf=p), _msg(lang, "expl_stage1", pred="stage1_pred", conf="stage1_conf"),
        f"coalesce({_msg(lang, 'expl_stage2', pred='stage2_pred', conf='stage2_conf')}, '')", f"coalesce({_msg(lang, 'expl_stage3', pred='stage3_pred', conf='stage3_conf')}, '')",
        f"coalesce({_msg(lang, 'expl_decisive_signals')} || dec || ' ', '')",
        f"coalesce(CASE WHEN {c} = 'healthy' THEN {_msg(lang, 'expl_secondary_healthy')} ELSE {_msg(lang, 'expl_secondary_faulty')} END || sec || ' ', '')",
        f"{_msg(lang, 'expl_integrity_avail')} || {names} || '. '", f"{_msg(lang, 'expl_alt_hypotheses')} || alts || '.'",
    ])

    def stage(s: str) -> str:
        role = (
            f"CASE WHEN stage1_pred = 'healthy' THEN {_msg(lang, 'stage1_healthy_end')} ELSE {_msg(lang, 'stage1_faulty_continue')} END"
            if s == "stage1" else _msg(lang, f"{s}_role")
        )
        name = f"'{s}'"
        return f"{_msg(lang, 'stage_predicted', name=name, pred=f'{s}_pred', conf=f'{s}_conf')} || CASE WHEN {s}_conf < 6e-1 THEN ' ' || {_msg(lang, 'stage_low_conf')} ELSE '' END || ' ' || {role}"

    stages = f"{stage('stage1')} || coalesce(' # ' || {stage('stage2')}, '') || coalesce(' # ' || {stage('stage3')}, '')"
    notes = f"""array_to_string(list_filter([CASE WHEN {p} < 5e-1 THEN {_msg(lang, 'low_composed_conf', conf=p)} END, CASE WHEN stage1_conf < 6e-1 THEN {_msg(lang, 'stage1_low_conf')} END,
        CASE WHEN stage2_conf < 6e-1 THEN {_msg(lang, 'stage2_low_conf')} END, CASE WHEN alt1_p > 25e-2 THEN {_msg(lang, 'strongest_alt', cls='alt1', p='alt1_p')} END], lambda x: x IS NOT NULL), ' # ')"""
    symptoms = f"""(SELECT coalesce(string_agg(txt, ' # ' ORDER BY other, fi), '') FROM (SELECT other, min(i) AS fi, CASE WHEN other THEN {_msg(lang, 'secondary_signal_prefix')} ELSE '' END || note AS txt FROM nt WHERE nt.run_id = ev.run_id GROUP BY other, note))"""
    return with_ctes(["diagnosis", "alternatives"], f"SELECT run_id, {summary} AS summary, {expl} AS explanation, {stages} AS stage_texts, {symptoms} AS symptoms, {notes} AS confidence_notes FROM ev LEFT JOIN sp USING (run_id)", _EV)


def _register_narrative(lang: str) -> None:
    @query(f"narrative_{lang}", "X15", _narrative_sql(lang))
    def _(t):
        n = narrative.narrate(_evidence(t), lang)
        return n.select(
            "run_id", "summary", "explanation", F.concat_ws(" # ", F.transform("stage_texts", lambda s: s["text"])).alias("stage_texts"),
            F.concat_ws(" # ", "symptoms").alias("symptoms"), F.concat_ws(" # ", "confidence_notes").alias("confidence_notes"),
        )


for _lang in ("en", "ru"):
    _register_narrative(_lang)


@query("recommendation_rationales", "X15 X9", with_ctes(["diagnosis", "alternatives"], "SELECT run_id, priority::INT AS priority, action, CASE action " + " ".join(
    f"WHEN '{k[4:]}' THEN {_msg('en', k, cls='final_class')}" for k in MESSAGES["en"] if k.startswith("rat_")) + " END AS rationale FROM ranked WHERE priority <= 3", [*_EV, _RANKED]))
def _(t):
    ev = _evidence(t)
    j = actions.recommend(ev).join(ev.select("run_id", "final_class"), "run_id")
    return j.select("run_id", "priority", "action", narrative.rationale("en").alias("rationale"))


# --- report tables -------------------------------------------------------------------------------


@query("report_envelopes", "S17 S18", with_ctes(["diagnosis", "alternatives"], """
    SELECT run_id, kind AS schema_kind, '1.0' AS schema_version, 'runlens' AS system_name, final_class FROM ev,
      (VALUES ('diagnosis'), ('evidence'), ('interpretation'), ('recommendations'), ('case_summary')) k(kind)""", _EV))
def _(t):
    env = reports.report_rows(_evidence(t), language="en")
    return env.select("run_id", "schema_kind", "schema_version", "system_name", F.get_json_object("payload", "$.final_class").alias("final_class"))


@query("report_contract", "S19", with_ctes(["preds"], """
    SELECT run_id, CASE vec_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'missing: evidence' WHEN 2 THEN 'diagnosis: schema_version' WHEN 3 THEN 'recommendations: no payload' ELSE 'inconsistent run_id' END AS errors FROM preds"""))
def _(t):
    p = D.predictions(t).select("run_id", "vec_id")
    kinds = F.explode(F.array(*map(F.lit, reports.KINDS)))
    rows = p.select(F.col("run_id").alias("case_id"), "run_id", "vec_id", kinds.alias("schema_kind"))
    k = F.col("vec_id") % 5
    rows = rows.where(~((k == 1) & (F.col("schema_kind") == "evidence"))).select(
        "case_id", "schema_kind", F.when((k == 2) & (F.col("schema_kind") == "diagnosis"), "0.9").otherwise("1.0").alias("schema_version"),
        F.lit("runlens").alias("system_name"), F.lit("2024-01-01T00:00:00").alias("created_at"),
        F.when((k == 4) & (F.col("schema_kind") == "case_summary"), "stranger").otherwise(F.col("run_id")).alias("run_id"),
        F.when((k == 3) & (F.col("schema_kind") == "recommendations"), F.lit(None)).otherwise(F.lit("{}")).alias("payload"),
    )
    out = reports.check_contract(rows)
    return out.select(F.col("case_id").alias("run_id"), F.concat_ws("; ", "errors").alias("errors"))


@query("result_sources", "S21 E26", """
    SELECT corpus, count(*) AS n_policies, max(CASE WHEN policy = 'flat' THEN accuracy END) AS flat, max(CASE WHEN policy = 'cascade' THEN accuracy END) AS cascade,
      max(CASE WHEN policy = 'stacking' THEN accuracy END) AS stacking FROM (
      SELECT p_brand AS corpus, (['flat', 'cascade', 'stacking'])[(p_partkey % 3) + 1] AS policy, arg_min(round(p_size / 5e1, 6) + 0.0, (p_partkey % 7, p_partkey)) AS accuracy
      FROM part WHERE p_size > 5 GROUP BY ALL) GROUP BY corpus""")
def _(t):
    k = F.col("p_partkey")
    rows = t.part.select(
        F.col("p_brand").alias("corpus"), F.get(F.array(*map(F.lit, ("flat", "cascade", "stacking"))), (k % 3).cast("int")).alias("policy"),
        F.struct((k % 7).alias("a"), k.alias("b")).alias("priority"), F.when(F.col("p_size") > 5, F.round(F.col("p_size") / 50.0, 6)).alias("value"),
    )
    best = reports.first_available(rows, ["corpus", "policy"])
    return best.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("n_policies"), *[F.max(F.when(F.col("policy") == p, F.col("value"))).alias(p) for p in ("flat", "cascade", "stacking")]
    )


@query("cross_corpus_invariants", "E26", f"""
    WITH acc AS (SELECT l_returnflag AS corpus, count(*) AS n, avg((l_linenumber % 6 = trunc(l_quantity)::INT % 6)::INT) AS flat, avg((l_linenumber % 6 = l_suppkey % 6)::INT) AS cascade,
      count_if(l_linenumber % 6 = 3 AND l_suppkey % 6 = 0) + count_if(l_linenumber % 6 = 0 AND l_suppkey % 6 = 3) AS lh, count_if(l_linenumber % 6 <> l_suppkey % 6) AS err,
      avg((l_discount < 9e-2)::INT) AS coverage FROM lineitem GROUP BY 1)
    SELECT corpus, n AS n_test, {rcols(['flat', 'cascade', 'coverage'])}, coverage >= 92e-2 AS coverage_holds, CASE WHEN cascade > flat THEN 'cascade' ELSE 'flat' END AS best_policy,
      cascade >= flat - 5e-4 AS best_beats_flat, {r('lh / err::DOUBLE', 'leakage_healthy_share')}, lh / err::DOUBLE >= 4e-1 AS leakage_healthy_is_main FROM acc""")
def _(t):
    b = D.bulk_predictions(t).withColumn("covered", F.col("confidence") > 0.91)
    return rounded(reports.cross_corpus(b, "slice"))
