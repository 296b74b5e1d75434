"""Cascade scoring, policies, arbitration, conformal sets, metrics, sweeps, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions.probs import items
from runlens.operators import attribution, cascade, conformal, metrics, policies, resample, stacking, thresholds
from runlens.plans.oracle import CLASSES, CLS, STAGE1_OF, STAGE2_OF, compose_sql, mapped, q, r, rcols, top, with_ctes
from runlens.plans.registry import query, rounded
from runlens.sources import driver_tables as D

P = [f"p_{c}" for c in CLASSES]


def _probs(df, col, keep=("run_id",)):
    return df.select(*keep, *[p.alias(n) for n, p in zip(P, items(F.col(col), 6))])


def _probs_sql(lst: str) -> str:
    return ", ".join(r(f"{lst}[{i + 1}]", n) for i, n in enumerate(P))


# --- cascade -------------------------------------------------------------------------------------


@query("cascade_composition", "C3 C7", with_ctes(["preds"], f"SELECT run_id, {_probs_sql('cascade')} FROM preds"))
def _(t):
    return rounded(_probs(D.predictions(t), "cascade"))


_ALTS = ", ".join(f"max(label) FILTER (WHERE rk = {k}) AS alt{k}, {r(f'max(p) FILTER (WHERE rk = {k})', f'alt{k}_p')}" for k in (1, 2, 3))


@query("cascade_diagnoses", "C1 C2 C3 C4 C5 J12", with_ctes(["diagnosis", "alternatives"], f"""
    SELECT run_id, final_class, {r('final_confidence', 'final_confidence')}, stage1_pred, {r('stage1_conf', 'stage1_conf')}, stage2_pred,
      {r('stage2_conf', 'stage2_conf')}, stage3_pred, {r('stage3_conf', 'stage3_conf')}, {_probs_sql('class_probs')}, alt1, alt1_p, alt2, alt2_p, alt3, alt3_p
    FROM diagnosis JOIN (SELECT run_id, {_ALTS} FROM alternatives GROUP BY run_id) USING (run_id)"""))
def _(t):
    return rounded(cascade.flatten(cascade.diagnose(D.predictions(t))))


@query("cascade_hard_commit", "C6", with_ctes(["preds"], "SELECT run_id, " + ", ".join(
    r(f"CASE WHEN stage_probs[1] >= 6e-1 THEN cascade[{i + 1}] ELSE {'0e0' if i == 0 else f'cascade[{i + 1}] / (1 - cascade[1])'} END", n) for i, n in enumerate(P)) + " FROM preds"))
def _(t):
    p = D.predictions(t)
    stage1 = F.when(F.get("stage_probs", F.lit(0)) >= 0.6, "healthy").otherwise("faulty")
    return rounded(_probs(p.withColumn("p", cascade.hard_commit(F.col("cascade"), stage1)), "p"))


@query("cascade_missing_stages", "C3", with_ctes(["preds"], "SELECT run_id, " + ", ".join(
    r(f"(CASE vec_id % 3 WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END)", n) for n, a, b, c in zip(
        P,
        ["stage_probs[1]"] + ["stage_probs[2] / 5e0"] * 5,
        compose_sql([*(f"stage_probs[{i + 1}]" for i in range(4)), "5e-1", "5e-1", *(f"stage_probs[{i + 1}]" for i in range(6, 9))]),
        compose_sql([*(f"stage_probs[{i + 1}]" for i in range(6)), "(1 / 3e0)", "(1 / 3e0)", "(1 / 3e0)"]),
    )) + " FROM preds"))
def _(t):
    p = D.predictions(t)
    k, s = F.col("vec_id") % 3, items(F.col("stage_probs"), 9)
    gone = F.lit(None).cast("double")
    stage = F.when(k == 0, F.array(*s[:2], *[gone] * 7)).when(k == 1, F.array(*s[:4], gone, gone, *s[6:])).otherwise(F.array(*s[:6], gone, gone, gone))
    return rounded(_probs(p.withColumn("p", cascade.compose_probabilities(stage, None)), "p"))


# --- policies ------------------------------------------------------------------------------------

_AVG = "(flat_conf * 5e-1 + cascade_conf * 5e-1)"
_MIX = "[" + ", ".join(f"flat[{i}] * 4e-1 + cascade[{i}] * (1e0 - 4e-1)" for i in range(1, 7)) + "]"
_POLICY_SQL = {
    "agreement_or_cascade": f"SELECT run_id, cascade_label AS final_label, CASE WHEN flat_label = cascade_label THEN {_AVG} ELSE cascade_conf END AS fc, CASE WHEN flat_label = cascade_label THEN 'agreement' ELSE 'cascade_picked' END AS resolution_path FROM labels2",
    "agreement_or_flat": f"SELECT run_id, flat_label AS final_label, CASE WHEN flat_label = cascade_label THEN {_AVG} ELSE flat_conf END AS fc, CASE WHEN flat_label = cascade_label THEN 'agreement' ELSE 'flat_picked' END AS resolution_path FROM labels2",
    "confidence_weighted": f"SELECT run_id, {top('mix')} AS final_label, list_max(mix) AS fc, 'weighted' AS resolution_path FROM (SELECT *, {_MIX} AS mix FROM labels2)",
}


def _register_policy(name: str, ids: str) -> None:
    sql = with_ctes(["labels2"], f"SELECT run_id, final_label, {r('fc', 'final_confidence')}, resolution_path FROM ({_POLICY_SQL[name]})")

    @query(f"policy_{name}", ids, sql)
    def _(t):
        out = policies.resolve(D.predictions(t), name, alpha=0.4)
        return rounded(out.select("run_id", "final_label", "final_confidence", "resolution_path"))


for _name, _ids in (("agreement_or_cascade", "R6"), ("agreement_or_flat", "R7"), ("confidence_weighted", "R8")):
    _register_policy(_name, _ids)


@query("policy_dispatch", "R17", with_ctes(["labels2"], " UNION ALL ".join(
    f"SELECT '{n}' AS policy, run_id, final_label, {r('fc', 'final_confidence')}, resolution_path FROM ({s})" for n, s in _POLICY_SQL.items())))
def _(t):
    out = policies.resolve_all(D.predictions(t), alpha=0.4)
    return rounded(out.select("policy", "run_id", "final_label", "final_confidence", "resolution_path"))


_TRIG = "CASE WHEN flat_label <> cascade_label THEN 'disagreement' WHEN least(flat_conf, cascade_conf) < 4e-1 THEN 'low_conf_agreement' END"


@query("arbitration_requests", "R9", with_ctes(["labels2"], f"""
    SELECT run_id, trigger, flat_label, {r('flat_conf', 'flat_conf')}, cascade_label, {r('cascade_conf', 'cascade_conf')}
    FROM (SELECT *, {_TRIG} AS trigger FROM labels2) WHERE trigger IS NOT NULL"""))
def _(t):
    return rounded(policies.arbitration_requests(D.predictions(t), low_confidence=0.4).drop("request_key"))


def _fmt(lst: str) -> str:
    return " || ',' || ".join(f"printf('%.6f', {lst}[{i}])" for i in range(1, 7))


@query("unanswered_request_keys", "R14", with_ctes(["labels2"], f"""
    SELECT run_id, sha256('m1|' || run_id || '|' || flat_label || '|' || {_fmt('flat')} || '|' || cascade_label || '|' || {_fmt('cascade')} || '|'
      || sha256('note ' || dataset) || '|' || entry_id) AS request_key
    FROM (SELECT *, {_TRIG} AS trigger FROM labels2) WHERE trigger IS NOT NULL AND vec_id % 4 <> 0"""))
def _(t):
    p = D.predictions(t)
    settings = dict(low_confidence=0.4, evidence=F.concat(F.lit("note "), F.col("dataset").cast("string")), model="m1", fold=F.col("entry_id"))
    answered = policies.arbitration_requests(p.where("vec_id % 4 = 0"), **settings)
    return policies.arbitration_requests(p, answered=answered, **settings).select("run_id", "request_key")


def responses(t):
    """Raw arbitrator responses: plain, fenced, truncated, wrapped in prose, with unknown labels."""
    p = D.predictions(t)
    k = F.col("vec_id")
    chosen = F.when(k % 11 == 0, "mystery").otherwise(D.class_at(k % 6))
    source = F.get(F.array(*map(F.lit, ("flat", "cascade", "neither", "both"))), (F.floor(k / 6) % 4).cast("int"))
    body = F.to_json(F.struct(chosen.alias("chosen_label"), source.alias("chosen_source"), (F.col("raw_confidence") + 0.5).alias("confidence")))
    text = (
        F.when(k % 9 == 0, F.substring(body, 1, 20))
        .when(k % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k % 7 == 0, F.concat(F.lit("My answer: "), body, F.lit(" as asked")))
        .otherwise(body)
    )
    return p.where("vec_id % 10 <> 3").select("run_id", text.alias("response"))


_RESP = ("resp", f"""SELECT run_id, vec_id, CASE WHEN error IS NULL THEN lab END AS chosen_label, CASE WHEN error IS NULL THEN src END AS chosen_source,
    CASE WHEN error IS NULL THEN least(greatest(raw_confidence + 5e-1, 0), 1) END AS confidence, error FROM
    (SELECT *, CASE WHEN vec_id % 9 = 0 THEN 'response was not a JSON object' WHEN vec_id % 11 = 0 THEN 'chosen_label outside the vocabulary'
      WHEN src = 'both' THEN 'chosen_source outside flat, cascade, neither' END AS error FROM
      (SELECT *, ({CLS})[(vec_id % 6) + 1] AS lab, (['flat', 'cascade', 'neither', 'both'])[((vec_id // 6) % 4) + 1] AS src FROM preds WHERE vec_id % 10 <> 3))""")
_SNAP = ("snapped", f"""SELECT l.*, {_TRIG} AS trigger, chosen_label, chosen_source, confidence,
    CASE WHEN chosen_label IN (flat_label, cascade_label) THEN chosen_label WHEN chosen_source = 'cascade' THEN cascade_label ELSE flat_label END AS snapped_label,
    CASE WHEN chosen_label IN (flat_label, cascade_label) THEN CASE WHEN chosen_label = flat_label THEN 'flat' ELSE 'cascade' END WHEN chosen_source = 'cascade' THEN 'cascade' ELSE 'flat' END AS snapped_source,
    CASE WHEN chosen_label IN (flat_label, cascade_label) THEN confidence ELSE least(confidence, 5e-1) END AS snapped_confidence
    FROM labels2 l LEFT JOIN (SELECT run_id, chosen_label, chosen_source, confidence FROM resp WHERE error IS NULL) USING (run_id)""")
_ARB = ("arb", f"""SELECT *, CASE WHEN trigger IS NOT NULL AND chosen_label IS NOT NULL THEN snapped_label ELSE flat_label END AS final_label,
    CASE WHEN trigger IS NULL THEN {_AVG} WHEN chosen_label IS NOT NULL THEN snapped_confidence ELSE flat_conf END AS final_confidence,
    CASE WHEN trigger IS NULL THEN 'agreement' WHEN chosen_label IS NOT NULL THEN 'llm_arbitrated' ELSE 'llm_skipped' END AS resolution_path,
    CASE WHEN trigger IS NULL THEN NULL WHEN chosen_label IS NOT NULL THEN snapped_source ELSE 'flat' END AS final_source,
    CASE WHEN trigger IS NOT NULL THEN chosen_label END AS raw_label FROM snapped""")
_ARB_CTES = [_RESP, _SNAP, _ARB]


def _resolved(t):
    return policies.resolve_with_responses(D.predictions(t), policies.parse_responses(responses(t)), 0.4)


@query("parsed_responses", "R11", with_ctes(["preds"], f"SELECT run_id, chosen_label, chosen_source, {r('confidence', 'confidence')}, error FROM resp", [_RESP]))
def _(t):
    return rounded(policies.parse_responses(responses(t)))


@query("snapped_decisions", "R12", with_ctes(["labels2"], f"""
    SELECT run_id, snapped_label, snapped_source, {r('snapped_confidence', 'snapped_confidence')} FROM snapped WHERE chosen_label IS NOT NULL""", [_RESP, _SNAP]))
def _(t):
    good = policies.parse_responses(responses(t)).where("error is null")
    pairs = policies.with_labels(D.predictions(t)).select("run_id", "flat_label", "cascade_label")
    return rounded(policies.snap(good.join(pairs, "run_id")).select("run_id", "snapped_label", "snapped_source", "snapped_confidence"))


@query("arbitrated_resolution", "R10", with_ctes(["labels2"], f"""
    SELECT run_id, final_label, {r('final_confidence', 'final_confidence')}, resolution_path, trigger, final_source AS chosen_source FROM arb""", _ARB_CTES))
def _(t):
    return rounded(_resolved(t).select("run_id", "final_label", "final_confidence", "resolution_path", "trigger", "chosen_source"))


_SOFT = [f"CASE WHEN trigger IS NULL THEN 0e0 WHEN final_label = '{c}' THEN final_confidence ELSE (1 - final_confidence) / 5e0 END" for c in CLASSES]


@query("arbitrator_outputs", "R13", with_ctes(["labels2"], "SELECT run_id, " + ", ".join(r(s, n) for s, n in zip(_SOFT, P)) + f""",
    (trigger IS NOT NULL)::INT AS arb_triggered, {r('CASE WHEN trigger IS NULL THEN 0 ELSE final_confidence END', 'arb_confidence')} FROM arb""", _ARB_CTES))
def _(t):
    out = policies.arbitration_outputs(_resolved(t))
    return rounded(_probs(out, "arbitrator", ("run_id", "arb_triggered", "arb_confidence")))


@query("arbitration_stats", "R15", with_ctes(["labels2"], f"""
    SELECT trigger, resolution_path, final_source AS chosen_source, count(*) AS n_calls, {r('avg((final_label = y_true)::INT)', 'accuracy')},
      {r('avg((flat_label = y_true)::INT)', 'flat_accuracy')}, {r('avg((cascade_label = y_true)::INT)', 'cascade_accuracy')}
    FROM arb WHERE trigger IS NOT NULL GROUP BY ALL""", _ARB_CTES))
def _(t):
    return rounded(policies.arbitration_stats(_resolved(t)))


_TEMPLATE = "CASE WHEN flat_conf > cascade_conf THEN flat_label WHEN cascade_conf > flat_conf THEN cascade_label ELSE least(flat_label, cascade_label) END"


@query("constraint_comparison", "R16", with_ctes(["labels2"], f"""
    SELECT mechanism, count(*) AS n, {r('avg((pred = y_true)::INT)', 'accuracy')}, {r('avg(out::INT)', 'violation_rate')} FROM (
      SELECT y_true, 'hard_snap' AS mechanism, final_label AS pred, false AS out FROM pool
      UNION ALL SELECT y_true, 'raw_label', raw_label, raw_label NOT IN (flat_label, cascade_label) FROM pool
      UNION ALL SELECT y_true, 'template', {_TEMPLATE}, false FROM pool) GROUP BY mechanism""",
    [*_ARB_CTES, ("pool", "SELECT * FROM arb WHERE flat_label <> cascade_label AND raw_label IS NOT NULL")]))
def _(t):
    return rounded(policies.constraint_comparison(_resolved(t)))


# --- stacking features, conformal ----------------------------------------------------------------

_META_SQL = (
    [(n, f"flat[{i + 1}]") for i, n in enumerate(stacking.FLAT_COLUMNS)]
    + [(n, f"cascade[{i + 1}]") for i, n in enumerate(stacking.CASCADE_COLUMNS)]
    + [(n, f"CASE WHEN vec_id % 13 = 0 THEN NULL ELSE stage_probs[{i + 1}] END") for i, n in enumerate(stacking.STAGE_COLUMNS)]
    + [
        ("agreement_bit", "(flat_label = cascade_label)::INT::DOUBLE"),
        ("min_max_proba", "least(flat_conf, cascade_conf)"),
        ("max_max_proba", "greatest(flat_conf, cascade_conf)"),
        ("kl_flat_cascade", " + ".join(
            f"least(greatest(flat[{i}], 1e-9), 1) * (ln(least(greatest(flat[{i}], 1e-9), 1)) - ln(least(greatest(cascade[{i}], 1e-9), 1)))" for i in range(1, 7))),
    ]
    + [(n, s) for n, s in zip(stacking.ARBITRATOR_COLUMNS, _SOFT)]
    + [("arb_triggered_bit", "(trigger IS NOT NULL)::INT::DOUBLE"), ("arb_confidence", "CASE WHEN trigger IS NULL THEN 0 ELSE final_confidence END")]
)


@query("meta_features", "K1", with_ctes(["labels2"], "SELECT run_id, " + ", ".join(
    r(f"coalesce({n}, avg({n}) OVER ())", n) for n, _ in _META_SQL) + " FROM raw", [*_ARB_CTES, ("raw", "SELECT run_id, " + ", ".join(f"{e} AS {n}" for n, e in _META_SQL) + " FROM arb")]))
def _(t):
    out = policies.arbitration_outputs(_resolved(t))
    gone = F.array(*[F.lit(None).cast("double")] * 9)
    out = out.withColumn("stage_probs", F.when(F.col("vec_id") % 13 == 0, gone).otherwise(F.col("stage_probs")))
    return rounded(stacking.meta_features(out))


_SCORES = ("sc", f"SELECT *, 1 - CASE WHEN vec_id % 17 = 0 THEN 0 ELSE cascade[list_position({CLS}, y_true)] END AS score, CASE WHEN vec_id % 17 = 0 THEN 'other' ELSE y_true END AS yy FROM preds")


def _calibration_rows(t):
    p = D.predictions(t).withColumn("p", F.col("cascade"))
    return p.withColumn("y_true", F.when(F.col("vec_id") % 17 == 0, "other").otherwise(F.col("y_true")))


def _quantile_sql(alpha: float, source: str) -> str:
    return f"(SELECT list_sort(list(score))[ceil(least(ceil((count(*) + 1) * {1.0 - alpha!r}::DOUBLE) / count(*), 1) * (count(*) - 1))::BIGINT + 1] FROM {source})"


@query("conformal_scores", "U1", with_ctes(["preds"], f"SELECT run_id, yy AS y_true, {r('score', 'score')} FROM sc", [_SCORES]))
def _(t):
    return rounded(conformal.scores(_calibration_rows(t)).select("run_id", "y_true", "score"))


@query("conformal_quantiles", "U2 J14", with_ctes(["preds"], " UNION ALL ".join(
    f"SELECT {a}::DOUBLE AS alpha, {r(_quantile_sql(a, 'sc'), 'quantile')}, (SELECT count(*) FROM sc) AS n_calibration" for a in (0.02, 0.05, 0.1, 0.2)), [_SCORES]))
def _(t):
    return rounded(conformal.calibrate(conformal.scores(_calibration_rows(t)), (0.02, 0.05, 0.1, 0.2)))


def _set_sql(quantile: str, source: str = "sc") -> str:
    return f"""SELECT s.*, qq.q, {top('cascade')} AS point, CASE WHEN len(ins) > 0 THEN ins ELSE [{top('cascade')}] END AS pset FROM
        (SELECT x.*, y.q, list_filter([{', '.join(f"CASE WHEN cascade[{i + 1}] >= 1 - y.q - 1e-12 THEN {q(c)} END" for i, c in enumerate(CLASSES))}], lambda v: v IS NOT NULL) AS ins
         FROM {source} x, {quantile} y) s, (SELECT NULL AS q) qq"""


_SPLIT = [_SCORES, ("cal", "SELECT * FROM sc WHERE vec_id % 2 = 0"), ("tst", "SELECT * FROM sc WHERE vec_id % 2 = 1")]


def _q_table(alpha: float) -> str:
    return f"(SELECT {_quantile_sql(alpha, 'cal')} AS q)"


def _predicted(t, alpha=0.2):
    rows = _calibration_rows(t)
    cal = conformal.calibrate(conformal.scores(rows.where("vec_id % 2 = 0")), (alpha,))
    return conformal.predict(rows.where("vec_id % 2 = 1"), conformal.quantile_of(cal))


@query("conformal_sets", "U3", with_ctes(["preds"], f"""
    SELECT run_id, array_to_string(pset, '|') AS prediction_set, len(pset)::INT AS set_size, point AS point_prediction, {r('list_max(cascade)', 'point_confidence')},
      len(pset) > 1 AS is_abstained, {r('1 - list_max(cascade)', 'nonconformity')} FROM sets""", [*_SPLIT, ("sets", _set_sql(_q_table(0.2), "tst"))]))
def _(t):
    out = _predicted(t)
    return rounded(out.select("run_id", F.concat_ws("|", "prediction_set").alias("prediction_set"), "set_size", "point_prediction", "point_confidence", "is_abstained", "nonconformity"))


_RATES = ", ".join([
    "count(*) AS n_test", r("avg(list_contains(pset, yy)::INT)", "empirical_coverage"), r("avg((len(pset) > 1)::INT)", "abstain_rate"),
    "count_if(len(pset) > 1)::BIGINT AS n_abstained", "count_if(len(pset) = 1)::BIGINT AS n_confident",
    r("avg(CASE WHEN len(pset) = 1 THEN (point = yy)::INT END)", "conditional_accuracy"), r("avg(len(pset))", "average_set_size"),
])


@query("conformal_evaluation", "U4", with_ctes(["preds"], f"SELECT {_RATES}, {r('8e-1', 'target_coverage')}, {r('avg(list_contains(pset, yy)::INT) - 8e-1', 'coverage_gap')} FROM sets", [*_SPLIT, ("sets", _set_sql(_q_table(0.2), "tst"))]))
def _(t):
    return rounded(conformal.evaluate(_predicted(t), 0.2))


@query("conformal_by_class", "U4", with_ctes(["preds", "taxonomy"], f"""
    SELECT label AS class, coalesce(n, 0) AS n, cov AS coverage, ab AS abstain_rate FROM taxonomy LEFT JOIN
      (SELECT yy, count(*) AS n, {r('avg(list_contains(pset, yy)::INT)', 'cov')}, {r('avg((len(pset) > 1)::INT)', 'ab')} FROM sets GROUP BY yy) ON yy = label""",
    [*_SPLIT, ("sets", _set_sql(_q_table(0.2), "tst"))]))
def _(t):
    return rounded(conformal.evaluate_by_class(_predicted(t)))


_ALPHAS = (0.02, 0.05, 0.1)


@query("conformal_alpha_sweep", "U5 J6", with_ctes(["preds"], f"""
    SELECT alpha, {_RATES}, {r('1 - alpha', 'target_coverage')}, {r('avg(list_contains(pset, yy)::INT) - (1 - alpha)', 'coverage_gap')} FROM (
      {' UNION ALL '.join(f"SELECT {a}::DOUBLE AS alpha, * FROM ({_set_sql(_q_table(a), 'tst')})" for a in _ALPHAS)}) GROUP BY alpha""", _SPLIT))
def _(t):
    rows = _calibration_rows(t)
    return rounded(conformal.alpha_sweep(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), _ALPHAS))


@query("conformal_score_summary", "U6", with_ctes(["preds"], f"""
    SELECT count(score) AS n, {r('min(score)', 'min')}, {r('median(score)', 'median')}, {r('quantile_cont(score, 0.95)', 'p95')}, {r('max(score)', 'max')} FROM sc""", [_SCORES]))
def _(t):
    return rounded(conformal.score_summary(conformal.scores(_calibration_rows(t))))


# --- metrics -------------------------------------------------------------------------------------


def _cells_sql(source: str, by: str, y: str, p: str) -> tuple[str, str]:
    return ("cells", f"SELECT {by + ', ' if by else ''}{y} AS y_true, {p} AS pred, count(*) AS n FROM {source} GROUP BY ALL")


def _class_cte(by: str, labels) -> tuple[str, str]:
    lst = "[" + ", ".join(map(q, labels)) + "]"
    groups = f"(SELECT DISTINCT {by} FROM cells)" if by else "(SELECT 1 AS one)"
    on = f"c.{by} = g.{by} AND " if by else ""
    col = f"{by}, " if by else ""
    return ("pc", f"""SELECT {col}class, support, predicted, tp, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END AS precision,
        CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS recall, CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * tp / (support + predicted)::DOUBLE END AS f1 FROM
        (SELECT {'g.' + by + ', ' if by else ''}class, (SELECT coalesce(sum(n), 0) FROM cells c WHERE {on}c.y_true = class)::BIGINT AS support,
          (SELECT coalesce(sum(n), 0) FROM cells c WHERE {on}c.pred = class)::BIGINT AS predicted,
          (SELECT coalesce(sum(n), 0) FROM cells c WHERE {on}c.pred = class AND c.y_true = class)::BIGINT AS tp
         FROM {groups} g, (SELECT unnest({lst}) AS class))""")


_BULK = [_cells_sql("bulk", "slice", "y_true", "pred_a"), _class_cte("slice", CLASSES)]


@query("class_metrics_bulk", "E1", with_ctes(["bulk"], f"SELECT slice, class, {rcols(['precision', 'recall', 'f1'])}, support FROM pc", _BULK))
def _(t):
    cells = metrics.confusion_cells(D.bulk_predictions(t), ["slice"], pred="pred_a")
    return rounded(metrics.class_metrics(cells, ["slice"]))


@query("confusion_matrix_bulk", "E1", with_ctes(["bulk"], f"""
    SELECT slice, a.label AS y_true, b.label AS pred, coalesce((SELECT sum(n) FROM cells c WHERE c.slice = s.slice AND c.y_true = a.label AND c.pred = b.label), 0)::BIGINT AS n
    FROM (SELECT DISTINCT slice FROM cells) s, (SELECT unnest({CLS}) AS label) a, (SELECT unnest({CLS}) AS label) b""", _BULK[:1]))
def _(t):
    cells = metrics.confusion_cells(D.bulk_predictions(t), ["slice"], pred="pred_a")
    return metrics.confusion_matrix(cells, ["slice"])


def _summary_sql(by: str, w: str = "") -> str:
    return f"""SELECT c.{by}, n_samples::BIGINT AS n_samples, {r('accuracy', 'accuracy')}, {r('macro_f1', 'macro_f1')}, {r('weighted_f1', 'weighted_f1')}, {r('leakage_f1', 'leakage_f1')} FROM
      (SELECT {by}, sum(n) AS n_samples, sum(CASE WHEN y_true = pred THEN n ELSE 0 END) / sum(n)::DOUBLE AS accuracy FROM cells GROUP BY {by}) c
      JOIN (SELECT {by}, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, max(CASE WHEN class = 'leakage' THEN f1 END) AS leakage_f1 FROM pc GROUP BY {by}) f ON f.{by} = c.{by}"""


@query("report_bulk", "E1", with_ctes(["bulk"], _summary_sql("slice"), _BULK))
def _(t):
    return rounded(metrics.summary(metrics.confusion_cells(D.bulk_predictions(t), ["slice"], pred="pred_a"), ["slice"]))


@query("report_by_dataset", "E20", with_ctes(["labels2"], f"""
    SELECT dataset, class, metric, {rcols(['flat', 'cascade'])}, {r('cascade - flat', 'delta')} FROM (
      SELECT dataset, class, metric, max(CASE WHEN contour = 'flat' THEN value END) AS flat, max(CASE WHEN contour = 'cascade' THEN value END) AS cascade FROM (
        SELECT split_part(k, '|', 1)::BIGINT AS dataset, split_part(k, '|', 2) AS contour, class, metric, value FROM lng) GROUP BY ALL)""",
    [("long_rows", "SELECT dataset || '|flat' AS k, y_true, flat_label AS p FROM labels2 UNION ALL SELECT dataset || '|cascade', y_true, cascade_label FROM labels2"),
     _cells_sql("long_rows", "k", "y_true", "p"), _class_cte("k", CLASSES),
     ("lng", """SELECT k, class, 'f1' AS metric, f1 AS value FROM pc UNION ALL SELECT k, '', 'macro_f1', avg(f1) FROM pc GROUP BY k
        UNION ALL SELECT k, '', 'weighted_f1', sum(f1 * support) / sum(support) FROM pc GROUP BY k
        UNION ALL SELECT k, '', 'accuracy', sum(CASE WHEN y_true = pred THEN n ELSE 0 END) / sum(n)::DOUBLE FROM cells GROUP BY k""")]))
def _(t):
    lab = policies.with_labels(D.predictions(t))
    rows = attribution.contours(lab, ["dataset"], {"flat": "flat_label", "cascade": "cascade_label"})
    return rounded(attribution.metric_deltas(attribution.long_metrics(rows, ["dataset", "contour"]), ["dataset"]))


@query("flat_vs_cascade_deltas", "E15", with_ctes(["labels2"], f"""
    SELECT slice, class, metric, {rcols(['flat', 'cascade'])}, {r('cascade - flat', 'delta')} FROM (
      SELECT slice, class, metric, max(CASE WHEN contour = 'flat' THEN value END) AS flat, max(CASE WHEN contour = 'cascade' THEN value END) AS cascade FROM (
        SELECT split_part(k, '|', 1) AS slice, split_part(k, '|', 2) AS contour, class, metric, value FROM lng) GROUP BY ALL)""",
    [("sl", "SELECT *, unnest(['full', CASE WHEN entry_id % 3 = 0 THEN 'extended' ELSE 'core' END]) AS slice FROM labels2"),
     ("long_rows", "SELECT slice || '|flat' AS k, y_true, flat_label AS p FROM sl UNION ALL SELECT slice || '|cascade', y_true, cascade_label FROM sl"),
     _cells_sql("long_rows", "k", "y_true", "p"), _class_cte("k", CLASSES),
     ("lng", """SELECT k, class, 'f1' AS metric, f1 AS value FROM pc UNION ALL SELECT k, '', 'macro_f1', avg(f1) FROM pc GROUP BY k
        UNION ALL SELECT k, '', 'weighted_f1', sum(f1 * support) / sum(support) FROM pc GROUP BY k
        UNION ALL SELECT k, '', 'accuracy', sum(CASE WHEN y_true = pred THEN n ELSE 0 END) / sum(n)::DOUBLE FROM cells GROUP BY k""")]))
def _(t):
    lab = policies.with_labels(D.predictions(t))
    slices = F.array(F.lit("full"), F.when(F.col("entry_id") % 3 == 0, "extended").otherwise("core"))
    rows = attribution.contours(lab.withColumn("slice", F.explode(slices)), ["slice"], {"flat": "flat_label", "cascade": "cascade_label"})
    return rounded(attribution.metric_deltas(attribution.long_metrics(rows, ["slice", "contour"]), ["slice"]))


def _bin(c: str) -> str:
    return "(" + " + ".join(f"({c} >= {i} * 1e-1)::INT" for i in range(1, 10)) + ")"


_BULK_BINS = [("bins", f"SELECT slice, {_bin('confidence')} AS bin, count(*) AS n, sum(confidence) AS sc, sum((y_true = pred_a)::INT)::DOUBLE AS sk FROM bulk GROUP BY ALL")]


def _bulk_bins(t):
    b = D.bulk_predictions(t).withColumn("correct", F.col("y_true") == F.col("pred_a"))
    return metrics.bin_table(b, ["slice"])


@query("calibration_errors_bulk", "E2", with_ctes(["bulk"], f"""
    SELECT slice, {r('sum(abs(sc / n - sk / n) * n) / sum(n)', 'ece')}, {r('max(abs(sc / n - sk / n))', 'mce')} FROM bins GROUP BY slice""", _BULK_BINS))
def _(t):
    return rounded(metrics.calibration_errors(_bulk_bins(t), ["slice"]))


@query("reliability_bins_bulk", "E4", with_ctes(["bulk"], f"""
    SELECT s.slice, i::INT AS bin, {r('(i * 1e-1 + CASE WHEN i = 9 THEN 1 ELSE (i + 1) * 1e-1 END) / 2', 'bin_center')},
      {r('coalesce(sc / n, (i * 1e-1 + CASE WHEN i = 9 THEN 1 ELSE (i + 1) * 1e-1 END) / 2)', 'bin_confidence')}, {r('coalesce(sk / n, 0)', 'bin_accuracy')}, coalesce(n, 0) AS bin_count
    FROM (SELECT DISTINCT slice FROM bins) s CROSS JOIN (SELECT unnest(range(10)) AS i) LEFT JOIN bins b ON b.slice = s.slice AND b.bin = i""", _BULK_BINS))
def _(t):
    return rounded(metrics.reliability(_bulk_bins(t), ["slice"]))


_BRIER = " + ".join(f"(p[{i + 1}] - (y_true = '{c}')::INT) ** 2" for i, c in enumerate(CLASSES))


@query("brier_scores", "E3", with_ctes(["preds"], f"SELECT dataset, {r(f'avg({_BRIER})', 'brier')} FROM (SELECT *, flat AS p FROM preds) GROUP BY dataset"))
def _(t):
    b = metrics.brier_term(F.col("flat"), F.col("y_true"))
    return rounded(D.predictions(t).groupBy("dataset").agg(F.avg(b).alias("brier")))


@query("calibration_report", "E5 E2 E3", with_ctes(["labels2"], f"""
    SELECT policy, n_used, {rcols(['accuracy', 'brier', 'ece', 'mce'])} FROM
      (SELECT policy, count(*) AS n_used, avg(({top('p')} = y_true)::INT) AS accuracy, avg({_BRIER}) AS brier FROM rows_ GROUP BY policy)
      JOIN (SELECT policy, sum(abs(sc / n - sk / n) * n) / sum(n) AS ece, max(abs(sc / n - sk / n)) AS mce FROM
        (SELECT policy, {_bin('list_max(p)')} AS bin, count(*) AS n, sum(list_max(p)) AS sc, sum(({top('p')} = y_true)::INT)::DOUBLE AS sk FROM rows_ GROUP BY ALL) GROUP BY policy) USING (policy)""",
    [*_ARB_CTES, ("rows_", f"SELECT 'flat' AS policy, y_true, flat AS p FROM arb UNION ALL SELECT 'cascade', y_true, cascade FROM arb UNION ALL SELECT 'arbitrator', y_true, [{', '.join(_SOFT)}] FROM arb WHERE trigger IS NOT NULL")]))
def _(t):
    long = metrics.policy_probabilities(policies.arbitration_outputs(_resolved(t)))
    return rounded(metrics.calibration_report(long, ["policy"]))


@query("leakage_healthy_confusion", "E13", with_ctes(["labels2"], """
    SELECT contour, l2h AS leakage_called_healthy, h2l AS healthy_called_leakage, h2f AS healthy_called_faulty, nl AS n_leakage, nh AS n_healthy,
      round(l2h / nl::DOUBLE, 6) + 0.0 AS leakage_recall_loss_to_healthy, round(h2l / nh::DOUBLE, 6) + 0.0 AS healthy_false_alarm_to_leakage FROM (
      SELECT contour, count_if(y_true = 'leakage' AND p = 'healthy')::BIGINT AS l2h, count_if(y_true = 'healthy' AND p = 'leakage')::BIGINT AS h2l,
        count_if(y_true = 'healthy' AND p <> 'healthy')::BIGINT AS h2f, count_if(y_true = 'leakage')::BIGINT AS nl, count_if(y_true = 'healthy')::BIGINT AS nh
      FROM (SELECT 'flat' AS contour, y_true, flat_label AS p FROM labels2 UNION ALL SELECT 'cascade', y_true, cascade_label FROM labels2) GROUP BY contour)"""))
def _(t):
    rows = attribution.contours(policies.with_labels(D.predictions(t)), [], {"flat": "flat_label", "cascade": "cascade_label"})
    return rounded(metrics.leakage_healthy(rows, ["contour"]))


_Y1, _Y2 = mapped("y_true", STAGE1_OF), mapped("y_true", STAGE2_OF)


@query("error_propagation", "E14", with_ctes(["diagnosis"], f"""
    SELECT count(*) AS n, {r('avg(c1::INT)', 'stage1_acc')}, {r('avg(CASE WHEN stage2_pred IS NOT NULL THEN c2::INT END)', 'stage2_acc_given_eligible')},
      {r('avg(CASE WHEN stage3_pred IS NOT NULL THEN c3::INT END)', 'stage3_acc_given_eligible')}, count_if(c1 AND final_class <> y_true)::BIGINT AS stage1_only_correct_but_final_wrong,
      count_if(NOT c1)::BIGINT AS stage1_wrong_runs, {r('avg((final_class = y_true)::INT)', 'final_acc')}
    FROM (SELECT *, stage1_pred = {_Y1} AS c1, stage2_pred IS NOT DISTINCT FROM {_Y2} AS c2,
      stage3_pred IS NOT DISTINCT FROM (CASE WHEN y_true <> 'healthy' THEN y_true END) AS c3 FROM diagnosis)"""))
def _(t):
    return rounded(attribution.error_propagation(cascade.diagnose(D.predictions(t))))


def _stage_report_sql() -> str:
    parts, ctes = [], []
    from runlens.vocab import DATA, OPTGEN, STAGE1, STAGE2, STAGE3_DATA, STAGE3_OPT

    for i, (stage, labels, where, y, p) in enumerate((
        ("stage1", STAGE1, "true", _Y1, "stage1_pred"), ("stage2", STAGE2, "y_true <> 'healthy'", _Y2, "coalesce(stage2_pred, '<no_stage2>')"),
        (f"stage3_{DATA}", STAGE3_DATA, f"{_Y2} = '{DATA}'", "y_true", "coalesce(stage3_pred, '<no_stage3>')"),
        (f"stage3_{OPTGEN}", STAGE3_OPT, f"{_Y2} = '{OPTGEN}'", "y_true", "coalesce(stage3_pred, '<no_stage3>')"),
    )):
        ctes.append((f"cells{i}", f"SELECT '{stage}' AS stage, {y} AS y_true, {p} AS pred, count(*) AS n FROM diagnosis WHERE {where} GROUP BY ALL"))
        ctes.append((f"pc{i}", _class_cte("stage", labels)[1].replace("FROM cells", f"FROM cells{i}")))
        parts.append(f"""SELECT stage, class, {rcols(['precision', 'recall', 'f1'])}, support,
            {r(f"(SELECT sum(CASE WHEN y_true = pred THEN n ELSE 0 END) / sum(n)::DOUBLE FROM cells{i})", 'accuracy')}, {r('avg(f1) OVER ()', 'macro_f1')} FROM pc{i}""")
    return with_ctes(["diagnosis"], " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts), ctes)


@query("stage_reports", "E12", _stage_report_sql())
def _(t):
    return rounded(attribution.stage_reports(cascade.diagnose(D.predictions(t))))


@query("agreement_analysis", "E16", with_ctes(["labels2"], f"""
    SELECT policy, count(*) AS n, count_if(ag)::BIGINT AS n_agreement, count_if(NOT ag)::BIGINT AS n_disagreement, {r('avg(ag::INT)', 'agreement_rate')},
      {r('avg(CASE WHEN ag THEN (final_label = y_true)::INT END)', 'accuracy_on_agreement')}, {r('avg(CASE WHEN NOT ag THEN (flat_label = y_true)::INT END)', 'flat_accuracy_on_disagreement')},
      {r('avg(CASE WHEN NOT ag THEN (cascade_label = y_true)::INT END)', 'cascade_accuracy_on_disagreement')}, {r('avg(CASE WHEN NOT ag THEN (final_label = y_true)::INT END)', 'hybrid_accuracy_on_disagreement')}
    FROM (SELECT policy, final_label, y_true, flat_label, cascade_label, flat_label = cascade_label AS ag FROM labels2 JOIN
      ({' UNION ALL '.join(f"SELECT '{n}' AS policy, run_id, final_label FROM ({s})" for n, s in _POLICY_SQL.items())}) USING (run_id)) GROUP BY policy"""))
def _(t):
    return rounded(attribution.agreement_analysis(policies.resolve_all(D.predictions(t), alpha=0.4), ["policy"]))


@query("resolution_paths", "E16", with_ctes(["labels2"], "SELECT policy, resolution_path, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS policy, resolution_path FROM ({s})" for n, s in _POLICY_SQL.items()) + ") GROUP BY ALL"))
def _(t):
    return attribution.path_counts(policies.resolve_all(D.predictions(t), alpha=0.4), ["policy"])


_ATTR = ("attr", f"""SELECT *, CASE WHEN final_class = y_true THEN NULL WHEN stage1_pred <> {_Y1} THEN 'stage1' WHEN {_Y1} = 'healthy' THEN 'composition'
    WHEN stage2_pred IS DISTINCT FROM {_Y2} THEN 'stage2' WHEN stage3_pred IS DISTINCT FROM y_true THEN 'stage3' ELSE 'composition' END AS stage_at_fault,
    y_true = 'leakage' AND final_class = 'healthy' AS is_leakage_to_healthy, y_true = 'healthy' AND final_class <> 'healthy' AS is_healthy_to_faulty FROM diagnosis""")


@query("error_attribution", "E17", with_ctes(["diagnosis"], "SELECT run_id, y_true, final_class, final_class = y_true AS correct, stage_at_fault, is_leakage_to_healthy, is_healthy_to_faulty FROM attr", [_ATTR]))
def _(t):
    out = attribution.attribute_errors(cascade.diagnose(D.predictions(t)))
    return out.select("run_id", "y_true", "final_class", "correct", "stage_at_fault", "is_leakage_to_healthy", "is_healthy_to_faulty")


_BUCKETS = ["all", *[f"class:{c}" for c in CLASSES], "leakage_to_healthy", "healthy_to_faulty"]


@query("attribution_summary", "E18", with_ctes(["diagnosis"], f"""
    SELECT bucket, stage, (SELECT count(*) FROM attr WHERE stage_at_fault = stage AND (bucket = 'all' OR bucket = 'class:' || y_true
      OR (bucket = 'leakage_to_healthy' AND is_leakage_to_healthy) OR (bucket = 'healthy_to_faulty' AND is_healthy_to_faulty))) AS n
    FROM (SELECT unnest([{', '.join(map(q, _BUCKETS))}]) AS bucket), (SELECT unnest(['stage1', 'stage2', 'stage3', 'composition']) AS stage)""", [_ATTR]))
def _(t):
    return attribution.attribution_summary(attribution.attribute_errors(cascade.diagnose(D.predictions(t))))


@query("contour_disagreements", "E19", with_ctes(["diagnosis"], f"""
    SELECT run_id, y_true, fl AS flat_label, final_class AS cascade_label, CASE WHEN fl = y_true THEN 'flat' ELSE 'cascade' END AS winner, stage1_pred, stage2_pred, stage3_pred
    FROM (SELECT *, {top('flat')} AS fl FROM diagnosis) WHERE fl <> final_class AND ((fl = y_true) <> (final_class = y_true))"""))
def _(t):
    p = D.predictions(t)
    return attribution.disagreements(cascade.diagnose(p), policies.with_labels(p))


_COST_SQL = """(count_if(y_true = 'leakage' AND p = 'healthy'))::BIGINT AS leakage_to_healthy, count_if(y_true = 'label_noise' AND p = 'healthy')::BIGINT AS label_noise_to_healthy,
    count_if(y_true NOT IN ('healthy', 'leakage', 'label_noise') AND p = 'healthy')::BIGINT AS other_faulty_to_healthy, count_if(y_true = 'healthy' AND p <> 'healthy')::BIGINT AS healthy_to_faulty"""
_COST_SUM = "leakage_to_healthy * 3e0 + label_noise_to_healthy * 2e0 + other_faulty_to_healthy * 1.5e0 + healthy_to_faulty * 1e0"


@query("error_cost_bulk", "E21", with_ctes(["bulk"], f"SELECT *, {_COST_SUM} AS total_cost FROM (SELECT slice, {_COST_SQL} FROM (SELECT slice, y_true, pred_a AS p FROM bulk) GROUP BY slice)"))
def _(t):
    return metrics.error_cost(metrics.confusion_cells(D.bulk_predictions(t), ["slice"], pred="pred_a"), ["slice"])


_GRID = ", ".join(f"({x!r}::DOUBLE)" for x in thresholds.GRID)
_SWEEP = [
    ("swept", f"SELECT threshold, y_true, CASE WHEN stage_probs[1] >= threshold THEN 'healthy' ELSE 'faulty' END AS p FROM preds, (VALUES {_GRID}) g(threshold)"),
    ("costs", f"SELECT threshold, {_COST_SQL}, count_if(y_true = 'leakage')::BIGINT AS n_leakage, count_if(y_true = 'healthy')::BIGINT AS n_healthy FROM swept GROUP BY threshold"),
    ("bin", f"SELECT threshold, {_Y1} AS y_true, p FROM swept"),
    _cells_sql("bin", "threshold", "y_true", "p"),
    _class_cte("threshold", ("healthy", "faulty")),
    ("rep", """SELECT threshold, n_samples, accuracy, macro_f1, weighted_f1 FROM (SELECT threshold, sum(n)::BIGINT AS n_samples, sum(CASE WHEN y_true = pred THEN n ELSE 0 END) / sum(n)::DOUBLE AS accuracy FROM cells GROUP BY threshold)
        JOIN (SELECT threshold, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM pc GROUP BY threshold) USING (threshold)"""),
    ("sweep", f"SELECT *, {_COST_SUM} AS total_cost, leakage_to_healthy / greatest(1, n_leakage)::DOUBLE AS leakage_recall_loss, healthy_to_faulty / greatest(1, n_healthy)::DOUBLE AS healthy_false_alarm FROM rep JOIN costs USING (threshold)"),
]


def _p_healthy(t):
    return D.predictions(t).select("y_true", F.get("stage_probs", F.lit(0)).alias("p_healthy"))


@query("stage1_threshold_sweep", "E22 J6", with_ctes(["preds"], f"""
    SELECT threshold, n_samples, {rcols(['accuracy', 'macro_f1', 'weighted_f1'])}, leakage_to_healthy, label_noise_to_healthy, other_faulty_to_healthy, healthy_to_faulty,
      total_cost, n_leakage, n_healthy, {rcols(['leakage_recall_loss', 'healthy_false_alarm'])} FROM sweep""", _SWEEP))
def _(t):
    return rounded(thresholds.binary_sweep(_p_healthy(t)))


@query("chosen_thresholds", "E22", with_ctes(["preds"], """
    SELECT arg_min(threshold, (total_cost, threshold)) AS by_total_cost, arg_min(threshold, (-macro_f1, threshold)) AS by_macro_f1,
      coalesce(arg_min(threshold, (leakage_recall_loss, threshold)) FILTER (WHERE healthy_false_alarm <= 0.9), 0.5) AS by_leakage_loss,
      arg_min(threshold, (leakage_recall_loss * 2e0 + healthy_false_alarm, threshold)) AS by_weighted_cost FROM sweep""", _SWEEP))
def _(t):
    return thresholds.choose_threshold(thresholds.binary_sweep(_p_healthy(t)), max_false_alarm=0.9, w_leak=2.0)


_CS = [
    ("cats", f"SELECT threshold, dataset, y_true, CASE WHEN stage_probs[1] >= threshold THEN {top('hp')} ELSE {top('fp')} END AS p FROM (SELECT *, list_concat([stage_probs[1]], [stage_probs[2] / 5e0, stage_probs[2] / 5e0, stage_probs[2] / 5e0, stage_probs[2] / 5e0, stage_probs[2] / 5e0]) AS hp, list_concat([0e0], cascade[2:6]) AS fp FROM preds), (VALUES {_GRID}) g(threshold)"),
    ("keyed", "SELECT threshold, y_true, p FROM cats"),
    _cells_sql("keyed", "threshold", "y_true", "p"),
    _class_cte("threshold", CLASSES),
]


@query("cascade_threshold_sweep", "E22 C6", with_ctes(["preds"], f"""
    SELECT s.*, leakage_to_healthy, label_noise_to_healthy, other_faulty_to_healthy, healthy_to_faulty, {_COST_SUM} AS total_cost FROM ({_summary_sql('threshold')}) s
    JOIN (SELECT threshold, {_COST_SQL} FROM cats GROUP BY threshold) USING (threshold)""", _CS))
def _(t):
    return rounded(thresholds.cascade_sweep(D.predictions(t)))


@query("disagreement_pool", "E24", with_ctes(["labels2"], f"""
    SELECT corpus, count(*) AS n, {r('avg((y_true IN (flat_label, cascade_label))::INT)', 'pi')}, {r('avg((raw_label = y_true)::INT)', 'accuracy')},
      {r('avg((y_true IN (flat_label, cascade_label))::INT) / 2', 'envelope_low')}, {r('avg((y_true IN (flat_label, cascade_label))::INT)', 'envelope_high')},
      avg((raw_label = y_true)::INT) BETWEEN avg((y_true IN (flat_label, cascade_label))::INT) / 2 AND avg((y_true IN (flat_label, cascade_label))::INT) AS inside
    FROM (SELECT *, unnest(['all', 'corpus' || (dataset % 3)]) AS corpus FROM arb) WHERE flat_label <> cascade_label AND raw_label IS NOT NULL GROUP BY corpus""", _ARB_CTES))
def _(t):
    corpora = F.array(F.lit("all"), F.concat(F.lit("corpus"), (F.col("dataset") % 3).cast("string")))
    rows = _resolved(t).withColumn("corpus", F.explode(corpora)).withColumn("arb_label", F.col("raw_label"))
    return rounded(attribution.disagreement_pool(rows, ["corpus"]))


def _noisy_sql(column: str) -> str:
    """Softmax scores of one contour with the operator's own noise."""
    def u(i: int, salt: int) -> str:
        name = f"run_id || '|{column}|{i}|0|{salt}|' || round(sigma * 1e6)::BIGINT"
        return f"((('0x' || substr(md5({name}), 1, 13))::BIGINT)::DOUBLE + 5e-1) / {float(1 << 52)!r}::DOUBLE"

    noise = [f"({column}[{i + 1}] + sigma * (sqrt(-2e0 * ln({u(i, 1)})) * cos({u(i, 2)} * 6.283185307179586e0)))" for i in range(6)]
    return f"CASE WHEN sigma = 0 THEN {column} ELSE [{', '.join(noise)}] END"


@query("disagreement_noise", "E25", with_ctes(["preds"], f"""
    SELECT sigma, count_if(f <> c)::BIGINT AS n_disagreement, {r('avg(CASE WHEN f <> c THEN (y_true IN (f, c))::INT END)', 'pi')},
      {r('avg(CASE WHEN f <> c THEN (y_true IN (f, c))::INT END) / 2', 'envelope_low')}, {r('avg(CASE WHEN f <> c THEN (y_true IN (f, c))::INT END)', 'envelope_high')}
    FROM (SELECT sigma, y_true, {top('nf')} AS f, {top('nc')} AS c FROM noisy) GROUP BY sigma""",
    [("grid", "SELECT preds.*, sigma FROM preds, (VALUES (0::DOUBLE), (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) g(sigma)"),
     ("noisy", f"SELECT sigma, y_true, {_noisy_sql('flat')} AS nf, {_noisy_sql('cascade')} AS nc FROM grid")]))
def _(t):
    return rounded(attribution.noise_robustness(D.predictions(t)))


# --- resampling ----------------------------------------------------------------------------------


@query("macro_f1_interval_bulk", "E6")
def _(t):
    return rounded(resample.metric_interval(D.bulk_predictions(t), ["slice"], pred="pred_a"))


@query("accuracy_delta_interval_bulk", "E7")
def _(t):
    return rounded(resample.delta_interval(D.bulk_predictions(t), ["slice"], metric="accuracy", n_comparisons=3))


@query("grouped_delta_interval_bulk", "E8")
def _(t):
    return rounded(resample.grouped_delta_interval(D.bulk_predictions(t), "group_id", metric="macro_f1"))


@query("class_f1_intervals_bulk", "E9")
def _(t):
    return rounded(resample.class_f1_intervals(D.bulk_predictions(t), pred="pred_a"))


@query("agreement_share_interval_bulk", "E10")
def _(t):
    b = D.bulk_predictions(t).withColumn("agree", F.col("pred_a") == F.col("pred_b"))
    return rounded(resample.proportion_interval(b, ["slice"], "agree"))


@query("cohen_h_by_slice", "E7", with_ctes(["bulk"], f"""
    SELECT slice, {r('h', 'cohen_h')}, CASE WHEN abs(h) < 0.2 THEN 'trivial' WHEN abs(h) < 0.5 THEN 'small' WHEN abs(h) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM
      (SELECT slice, 2 * (asin(sqrt(avg((pred_b = y_true)::INT))) - asin(sqrt(avg((pred_a = y_true)::INT)))) AS h FROM bulk GROUP BY slice)"""))
def _(t):
    b = D.bulk_predictions(t).groupBy("slice").agg(
        F.avg((F.col("pred_a") == F.col("y_true")).cast("double")).alias("a"), F.avg((F.col("pred_b") == F.col("y_true")).cast("double")).alias("b")
    )
    h = resample.cohen_h(F.col("a"), F.col("b"))
    return rounded(b.select("slice", h.alias("cohen_h"), resample.magnitude(h).alias("magnitude")))


@query("holm_step_down", "E11", f"""
    WITH f AS (SELECT p_brand AS comparison, 1 - 2e-1 * avg(p_size) / 5e1 * (avg(p_size) / 5e1) ** 3 AS p_b_better FROM part GROUP BY p_brand),
    o AS (SELECT *, 1 - p_b_better AS pp, row_number() OVER (ORDER BY 1 - p_b_better, comparison) AS rank, count(*) OVER () AS m FROM f),
    s AS (SELECT *, 5e-2 / (m - rank + 1) AS thr FROM o)
    SELECT comparison, {r('p_b_better', 'p_b_better')}, rank, {r('thr', 'holm_threshold_pseudo_p')}, {r('1 - thr', 'holm_threshold_p_better')},
      bool_and(pp <= thr) OVER (ORDER BY rank) AS significant, m AS family_size FROM s""")
def _(t):
    m = F.avg("p_size") / 50.0
    f = t.part.groupBy(F.col("p_brand").alias("comparison")).agg((F.lit(1.0) - F.lit(0.2) * m * m * m * m).alias("p_b_better"))
    return rounded(resample.holm(f))
