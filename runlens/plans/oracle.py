"""SQL building blocks for the queries' twins (plain ANSI-style SQL over the same tables)."""

from __future__ import annotations

from runlens.vocab import BRANCH_OF, CLASSES, HEALTHY

CURVES = ("train_loss", "val_loss", "train_acc", "val_acc")
CLS = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"


def q(label: str | None) -> str:
    return "NULL" if label is None else f"'{label}'"


def r(expr: str, alias: str | None = None) -> str:
    out = f"round({expr}, 6) + 0.0"
    return f"{out} AS {alias}" if alias else out


def rcols(names) -> str:
    return ", ".join(r(n, n) for n in names)


def top(lst: str, labels: str = CLS) -> str:
    return f"({labels})[list_position({lst}, list_max({lst}))]"


def mapped(column: str, mapping: dict) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {column} {cases} END"


STAGE1_OF = {c: HEALTHY if c == HEALTHY else "faulty" for c in CLASSES}
STAGE2_OF = {c: BRANCH_OF.get(c) for c in CLASSES}
STAGE3_OF = {c: None if c == HEALTHY else c for c in CLASSES}

_EVENTS = {"click": "train_loss", "view": "val_loss", "purchase": "train_acc", "signup": "val_acc", "error": "grad_norm"}
_ALL_CURVES = tuple(_EVENTS.values())

_E = [f"e[{i + 1}]" for i in range(14)]


def _softmax_cols(prefix: str, scores: list[str]) -> str:
    top_ = "greatest(" + ", ".join(scores) + ")" if len(scores) > 1 else scores[0]
    ex = [f"exp({s} - {top_})" for s in scores]
    total = "(" + " + ".join(ex) + ")"
    return ", ".join(f"{x} / {total} AS {prefix}{i}" for i, x in enumerate(ex))


def compose_sql(s: list[str], gate: str | None = None) -> list[str]:
    """Un-normalised class masses from nine stage probabilities."""
    ph, pf, pd_, po, leak, noise, over, under, inst = s
    bd, bo = f"({pd_} / ({pd_} + {po}))", f"({po} / ({pd_} + {po}))"
    mass = [f"{pf} * {bo} * {over}", f"{pf} * {bo} * {under}", f"{pf} * {bd} * {leak}", f"{pf} * {bd} * {noise}", f"{pf} * {bo} * {inst}"]
    if gate:
        mass = [f"CASE WHEN {gate} THEN {m} ELSE {pf} / 5e0 END" for m in mass]
    return [ph, *mass]


_F = [f"f{i}" for i in range(6)]
_S = [f"s{i}" for i in range(9)]
_M = [f"m{i}" for i in range(6)]

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "taxonomy": (
        (),
        "SELECT * FROM (VALUES "
        + ", ".join(
            f"({q(c)}, {i}, {q(STAGE1_OF[c])}, {q(STAGE2_OF[c])}, {q(STAGE3_OF[c])})" for i, c in enumerate(CLASSES)
        )
        + ") t(label, ord, stage1, stage2, stage3)",
    ),
    "metrics": (
        (),
        "SELECT 'u' || user_id AS run_id, "
        + mapped("event_type", _EVENTS)
        + """ AS metric, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS step,
             ts, event_id AS seq,
             CASE WHEN event_type IN ('click', 'view') THEN value / 1e2
                  WHEN event_type IN ('purchase', 'signup') THEN value / (value + 5e1) ELSE value END AS value
             FROM events""",
    ),
    "history": (
        ("metrics",),
        "SELECT run_id, step AS pos, "
        + ", ".join(f"max(value) FILTER (WHERE metric = '{c}') AS {c}" for c in _ALL_CURVES)
        + " FROM metrics GROUP BY run_id, step",
    ),
    "history_gaps": (
        ("history",),
        "SELECT run_id, pos, "
        + ", ".join(
            f"CASE WHEN {c} IS NOT NULL AND pos % 7 = 5 THEN 'nan'::DOUBLE ELSE {c} END AS {c}" for c in _ALL_CURVES
        )
        + " FROM history",
    ),
    "runs_small": (
        (),
        f"""SELECT 'u' || user_id AS run_id, user_id AS ord,
            CASE WHEN user_id % 13 <> 12 THEN ({CLS})[(user_id % 6) + 1] END AS primary_label,
            (['mild', 'moderate', 'severe', 'none'])[(user_id % 4) + 1] AS severity,
            'ds' || (user_id % 8) AS dataset,
            CASE WHEN user_id % 17 <> 0 THEN 'e' || (user_id % 30) END AS entry_id,
            user_id % 11 = 0 AS is_multi_label, max(n) AS n_history_rows
            FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)
            GROUP BY user_id""",
    ),
    "runs_bulk": (
        (),
        f"""SELECT 'o' || o_orderkey AS run_id, o_orderkey AS ord,
            CASE WHEN o_orderkey % 101 <> 0 THEN ({CLS})[(o_orderkey % 6) + 1] END AS primary_label,
            CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'severe'
                 WHEN o_orderpriority = '3-MEDIUM' THEN 'moderate' WHEN o_orderpriority = '5-LOW' THEN 'mild' END AS severity,
            c_mktsegment AS dataset, 'e' || o_custkey AS entry_id,
            (o_orderstatus = 'P' AND o_orderkey % 5 = 0) AS is_multi_label,
            coalesce(n, 0) AS n_history_rows
            FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
            LEFT JOIN customer ON c_custkey = o_custkey""",
    ),
    "vec": ((), "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"),
    "preds_raw": (
        ("vec",),
        f"""SELECT 'v' || vec_id AS run_id, vec_id, vec_id % 8 AS dataset, vec_id % 100 AS entry_id,
            ({CLS})[(label % 6) + 1] AS y_true, e[14] AS raw_confidence,
            {_softmax_cols('f', [f'{x} * 2e0' for x in _E[:6]])},
            1e0 / (1e0 + exp(-({_E[6]} * 3e0))) AS s0, 1e0 - 1e0 / (1e0 + exp(-({_E[6]} * 3e0))) AS s1,
            1e0 / (1e0 + exp(-({_E[7]} * 3e0))) AS s2, 1e0 - 1e0 / (1e0 + exp(-({_E[7]} * 3e0))) AS s3,
            {_softmax_cols('d', [f'{x} * 3e0' for x in _E[8:10]])}, {_softmax_cols('o', [f'{x} * 3e0' for x in _E[10:13]])}
            FROM vec""",
    ),
    "preds_mass": (
        ("preds_raw",),
        "SELECT *, d0 AS s4, d1 AS s5, o0 AS s6, o1 AS s7, o2 AS s8, "
        + ", ".join(f"{m} AS m{i}" for i, m in enumerate(compose_sql(["s0", "s1", "s2", "s3", "d0", "d1", "o0", "o1", "o2"])))
        + " FROM preds_raw",
    ),
    "preds": (
        ("preds_mass",),
        f"""SELECT run_id, vec_id, dataset, entry_id, y_true, raw_confidence, [{', '.join(_F)}] AS flat,
            [{', '.join(_S)}] AS stage_probs,
            [{', '.join(f'{m} / ({" + ".join(_M)})' for m in _M)}] AS cascade FROM preds_mass""",
    ),
    "labels2": (
        ("preds",),
        f"""SELECT *, {top('flat')} AS flat_label, list_max(flat) AS flat_conf,
            {top('cascade')} AS cascade_label, list_max(cascade) AS cascade_conf FROM preds""",
    ),
    "diag_mass": (
        ("preds",),
        "SELECT *, stage_probs[1] >= 5e-1 AS healthy1, "
        + ", ".join(f"{m} AS g{i}" for i, m in enumerate(compose_sql([f"stage_probs[{i + 1}]" for i in range(9)], "NOT (stage_probs[1] >= 5e-1)")))
        + " FROM preds",
    ),
    "diag": (
        ("diag_mass",),
        f"""SELECT run_id, vec_id, dataset, entry_id, y_true, flat, cascade, stage_probs, raw_confidence,
            CASE WHEN healthy1 THEN 'healthy' ELSE 'faulty' END AS stage1_pred,
            CASE WHEN healthy1 THEN stage_probs[1] ELSE stage_probs[2] END AS stage1_conf,
            CASE WHEN NOT healthy1 THEN CASE WHEN stage_probs[3] >= stage_probs[4] THEN 'data_related' ELSE 'optimization_or_generalization_related' END END AS stage2_pred,
            CASE WHEN NOT healthy1 THEN greatest(stage_probs[3], stage_probs[4]) END AS stage2_conf,
            CASE WHEN NOT healthy1 THEN CASE WHEN stage_probs[3] >= stage_probs[4]
                 THEN {top('stage_probs[5:6]', "['leakage', 'label_noise']")}
                 ELSE {top('stage_probs[7:9]', "['overfitting', 'underfitting', 'instability']")} END END AS stage3_pred,
            CASE WHEN NOT healthy1 THEN CASE WHEN stage_probs[3] >= stage_probs[4]
                 THEN list_max(stage_probs[5:6]) ELSE list_max(stage_probs[7:9]) END END AS stage3_conf,
            [{', '.join(f'g{i} / (g0 + g1 + g2 + g3 + g4 + g5)' for i in range(6))}] AS class_probs
            FROM diag_mass""",
    ),
    "diagnosis": (
        ("diag",),
        f"SELECT *, {top('class_probs')} AS final_class, list_max(class_probs) AS final_confidence FROM diag",
    ),
    "alternatives": (
        ("diagnosis",),
        f"""SELECT run_id, label, p, row_number() OVER (PARTITION BY run_id ORDER BY p DESC, i) AS rk FROM (
            SELECT run_id, final_class, i, ({CLS})[i] AS label, class_probs[i] AS p
            FROM diagnosis, (SELECT unnest(range(1, 7)) AS i)) WHERE label <> final_class""",
    ),
    "bulk": (
        (),
        f"""SELECT ({CLS})[(l_linenumber % 6) + 1] AS y_true, ({CLS})[(trunc(l_quantity)::INT % 6) + 1] AS pred_a,
            ({CLS})[(l_suppkey % 6) + 1] AS pred_b, 1e0 - l_discount AS confidence, l_orderkey AS group_id,
            l_returnflag AS slice FROM lineitem""",
    ),
}


def curve_cte(source: str) -> tuple[str, str]:
    """Epoch rows with finite values (x_), previous values and run length, from ``source``."""
    xs = ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS x_{c}" for c in CURVES)
    lags = ", ".join(f"lag(x_{c}) OVER (PARTITION BY run_id ORDER BY pos) AS prev_{c}" for c in CURVES)
    ranks = ", ".join(
        f"count(x_{c}) OVER (PARTITION BY run_id ORDER BY pos) - 1 AS rank_{c}, count(x_{c}) OVER (PARTITION BY run_id) AS cnt_{c}"
        for c in ("val_loss", "val_acc")
    )
    body = f"""SELECT *, count(*) OVER (PARTITION BY run_id) AS n, max(x_val_acc) OVER (PARTITION BY run_id) AS va_max,
        min(x_val_loss) OVER (PARTITION BY run_id) AS vl_min, {lags}, {ranks}
        FROM (SELECT *, {xs} FROM {source})"""
    return "epochs", body


def curve_feature_exprs() -> dict[str, str]:
    out = {
        "n_epochs": "count(*)::DOUBLE",
        "diverged": "greatest("
        + ", ".join(
            f"(bool_or({c} IS NOT NULL) AND bool_or({c} IS NULL OR isnan({c})))::INT" for c in ("train_loss", "val_loss")
        )
        + ")::DOUBLE",
    }
    for c in CURVES:
        has = f"bool_or({c} IS NOT NULL)"

        def slope(y: str, has=has) -> str:
            return f"CASE WHEN {has} THEN CASE WHEN count({y}) >= 2 THEN regr_slope({y}, pos::DOUBLE) ELSE 0 END END"

        out[f"{c}_final"] = f"max(CASE WHEN pos = n - 1 AND NOT isnan({c}) THEN {c} END)"
        out[f"{c}_min"] = f"min(x_{c})"
        out[f"{c}_max"] = f"max(x_{c})"
        out[f"{c}_mean"] = f"avg(x_{c})"
        out[f"{c}_std"] = f"stddev_pop(x_{c})"
        out[f"{c}_slope"] = slope(f"x_{c}")
        out[f"{c}_slope_first_half"] = slope(f"CASE WHEN pos < greatest(1, n // 2) THEN x_{c} END")
        out[f"{c}_slope_second_half"] = slope(f"CASE WHEN pos >= greatest(1, n // 2) THEN x_{c} END")
        out[f"{c}_max_jump"] = (
            f"CASE WHEN {has} THEN CASE WHEN max(n) = 1 THEN 0 ELSE max(abs(x_{c} - prev_{c})) END END"
        )
        out[f"{c}_n_nan"] = f"CASE WHEN {has} THEN count(*) - count(x_{c}) ELSE 0 END::DOUBLE"
    for p, a, b in (("acc", "train_acc", "val_acc"), ("loss", "val_loss", "train_loss")):
        out[f"{p}_final_gap"] = f"max(CASE WHEN pos = n - 1 AND NOT isnan({a} - {b}) THEN {a} - {b} END)"
        out[f"{p}_max_gap"] = f"max(x_{a} - x_{b})"
        out[f"{p}_mean_gap"] = f"avg(x_{a} - x_{b})"
    out["val_loss_argmin_frac"] = "min(CASE WHEN x_val_loss = vl_min THEN pos END) / greatest(1, max(n) - 1)::DOUBLE"
    return out


def proxy_exprs() -> dict[str, str]:
    ap = "(x_train_acc IS NOT NULL AND x_val_acc IS NOT NULL)"
    lp = "(x_train_loss IS NOT NULL AND x_val_loss IS NOT NULL)"
    sx, sy = f"stddev_pop(x_train_acc) FILTER (WHERE {ap})", f"stddev_pop(x_val_acc) FILTER (WHERE {ap})"
    ta_f = "max(CASE WHEN pos = n - 1 THEN x_train_acc END)"
    gap_f = "max(CASE WHEN pos = n - 1 THEN x_train_acc - x_val_acc END)"
    vm = "max(x_val_acc)"
    lock = f"(1 - abs({ta_f} - {vm})) / greatest(1e-6, 1 - {vm})"
    head = "greatest(2, cnt_val_loss // 5)"
    return {
        "di_proxy_saturation": vm,
        "di_proxy_zero_gap_ceiling": f"CASE WHEN {vm} IS NOT NULL AND {gap_f} IS NOT NULL THEN greatest(0, {vm} - abs({gap_f})) END",
        "di_proxy_train_val_lockstep": f"CASE WHEN {ta_f} IS NOT NULL AND {vm} IS NOT NULL THEN least(greatest({lock}, 0), 50) END",
        "di_proxy_val_loss_uniqueness": "CASE WHEN bool_or(val_loss IS NOT NULL) AND count(*) > 4 THEN count(DISTINCT round_even(x_val_loss, 6)) / greatest(1, count(x_val_loss))::DOUBLE END",
        "di_proxy_early_val_flatness": f"CASE WHEN count(x_val_loss) > 4 THEN least(greatest(stddev_pop(CASE WHEN rank_val_loss < {head} THEN x_val_loss END), 0), 50) END",
        "di_proxy_val_above_train_acc_frac": f"CASE WHEN count_if({ap}) >= 3 THEN avg(CASE WHEN {ap} THEN (x_val_acc > x_train_acc)::INT END) END",
        "di_proxy_val_acc_minus_train_acc_mean": f"CASE WHEN count_if({ap}) >= 3 THEN avg(x_val_acc - x_train_acc) END",
        "di_proxy_val_below_train_loss_frac": f"CASE WHEN count_if({lp}) >= 3 THEN avg(CASE WHEN {lp} THEN (x_val_loss < x_train_loss)::INT END) END",
        "di_proxy_loss_ratio_mean": f"CASE WHEN count_if({lp}) >= 3 THEN avg(CASE WHEN {lp} THEN least(greatest(x_val_loss / greatest(x_train_loss, 1e-9), 0), 50) END) END",
        "di_proxy_acc_lockstep_corr": f"CASE WHEN count_if({ap}) >= 3 AND {sx} > 1e-9 AND {sy} > 1e-9 THEN covar_pop(x_val_acc, x_train_acc) / ({sx} * {sy}) END",
        "di_proxy_epoch_to_90pct_val_acc_frac": "CASE WHEN count(x_val_acc) > 1 THEN coalesce(min(CASE WHEN x_val_acc >= va_max * 9e-1 THEN rank_val_acc END) / greatest(count(x_val_acc) - 1, 1)::DOUBLE, 1) END",
        "di_proxy_best_minus_final_val_acc": "CASE WHEN count(x_val_acc) >= 2 THEN max(x_val_acc) - max(CASE WHEN rank_val_acc = cnt_val_acc - 1 THEN x_val_acc END) END",
    }


def with_ctes(names, body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``body`` preceded by the named building blocks (with what they need) and ``extra`` ones."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            add(dep)
        order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({b})" for n, b in (extra or [])]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def features_sql(source: str, which: dict[str, str]) -> tuple[list[str], list[tuple[str, str]]]:
    """Names and extra CTEs ending in ``feats`` (unrounded features per run)."""
    agg = ", ".join(f"{e} AS {n}" for n, e in which.items())
    return [source], [curve_cte(source), ("feats", f"SELECT run_id, {agg} FROM epochs GROUP BY run_id")]
