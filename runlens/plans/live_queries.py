"""Live runs from their epochs: running features with bounded state, closed runs, diagnoses from curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import linear_stages
from runlens.plans.oracle import CURVES, curve_cte, curve_feature_exprs, r, rcols, top
from runlens.plans.registry import query, rounded
from runlens.streaming import live
from runlens.streaming.curve_state import LIVE_FEATURES, closed_runs
from runlens.vocab import CLASSES

#: A fixed cascade over curve features, small enough to be written down.
WEIGHTS: linear_stages.Weights = {
    ("stage1", "healthy"): {"bias": 1.0, "val_loss_final": -0.8, "diverged": -1.0, "val_acc_mean": 2.0},
    ("stage1", "faulty"): {"loss_max_gap": 0.7, "val_loss_max_jump": 0.3, "train_acc_slope": -0.5},
    ("stage2", "data_related"): {"acc_mean_gap": -2.0, "val_loss_std": 0.9, "n_epochs": 0.05},
    ("stage2", "optimization_or_generalization_related"): {"loss_mean_gap": 1.1, "val_loss_argmin_frac": -0.6, "train_loss_n_nan": 0.2},
    ("stage3_data", "leakage"): {"val_acc_max": 2.5, "acc_final_gap": -1.0},
    ("stage3_data", "label_noise"): {"bias": 0.4, "train_loss_mean": 0.8},
    ("stage3_opt", "overfitting"): {"loss_final_gap": 1.3, "val_loss_slope": 0.4},
    ("stage3_opt", "underfitting"): {"train_loss_min": 1.0, "train_acc_final": -1.5},
    ("stage3_opt", "instability"): {"val_loss_n_nan": 0.5, "train_loss_max_jump": 0.6, "diverged": 0.8},
}
SILENCE_SECONDS = 86_400


def _epochs(t):
    """``events`` as a stream of epoch rows with four curves; an error logs no validation loss."""
    s = live.read_epochs(t.spark, t.root, t.events.schema, "events.parquet")
    v = F.col("value")
    return s.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"),
        F.floor(F.col("event_id") / 2).cast("long").alias("epoch"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_id") % 23 == 0).alias("finish"),
        (v / 97.0).alias("train_loss"), F.when(F.col("event_type") == "error", float("nan")).otherwise(v / 73.0).alias("val_loss"),
        F.when(F.col("event_type") != "view", v / (v + 50.0)).alias("train_acc"), (v / (v + 60.0)).alias("val_acc"),
    )


# Epochs once each, sessions by silence or finish mark, and which of them the last watermark closes.
_ROWS = """SELECT 'u' || user_id AS run, event_id // 2 AS epoch, ts, event_id % 23 = 0 AS finish, value / 9.7e1 AS train_loss,
    CASE WHEN event_type = 'error' THEN 'nan'::DOUBLE ELSE value / 7.3e1 END AS val_loss,
    CASE WHEN event_type <> 'view' THEN value / (value + 5e1) END AS train_acc, value / (value + 6e1) AS val_acc
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id // 2 ORDER BY ts) = 1"""
_MARKED = f"""SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL {SILENCE_SECONDS} SECOND OR lag(finish) OVER w, true)::INT AS opens
    FROM live_rows WINDOW w AS (PARTITION BY run ORDER BY ts)"""
_SESSIONS = "SELECT *, sum(opens) OVER (PARTITION BY run ORDER BY ts) AS session FROM live_marked"
_LAST = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
_ENDED = f"""SELECT run, session, epoch_us(min(ts)) AS opened_us, epoch_us(max(ts)) AS closed_us, CASE WHEN bool_or(finish) THEN 'finished' ELSE 'silent' END AS reason
    FROM live_sessions GROUP BY ALL
    HAVING (bool_or(finish) AND max(ts) <= {_LAST}) OR max(ts) + INTERVAL {SILENCE_SECONDS} SECOND <= {_LAST}"""
_LIVE = "SELECT run || ':' || session AS run_id, row_number() OVER (PARTITION BY run, session ORDER BY ts) - 1 AS pos, " + ", ".join(CURVES) + " FROM live_sessions"
_FEATS = "SELECT run_id, " + ", ".join(f"{e} AS {n}" for n, e in curve_feature_exprs().items() if n in LIVE_FEATURES) + " FROM epochs GROUP BY run_id"
_CTES = [
    ("live_rows", _ROWS), ("live_marked", _MARKED), ("live_sessions", _SESSIONS), ("live_ended", _ENDED), ("live_history", _LIVE),
    curve_cte("live_history"), ("feats", _FEATS),
]


def _with(body: str, extra=()) -> str:
    return "WITH " + ", ".join(f"{n} AS ({b})" for n, b in [*_CTES, *extra]) + " " + body


@query("live_closed_runs", "T3 T4", _with(f"""
    SELECT run AS run_id, opened_us, closed_us, reason, {rcols(LIVE_FEATURES)} FROM live_ended JOIN feats ON run_id = run || ':' || session"""))
def _(t):
    return rounded(live.run_append(closed_runs(_epochs(t), SILENCE_SECONDS), "closed", rocksdb=True))


def _stage_sql() -> str:
    cols, i = [], 0
    by_stage: dict[str, list[str]] = {}
    for stage, label in WEIGHTS:
        by_stage.setdefault(stage, []).append(label)
    for stage, labels in by_stage.items():
        sums = []
        for label in labels:
            row = WEIGHTS[stage, label]
            sums.append(f"({row.get('bias', 0.0)}e0" + "".join(f" + coalesce({f}, 0) * {w}e0" for f, w in sorted(row.items()) if f != "bias") + ")")
        for s in sums:
            cols.append(f"exp({s}) / ({' + '.join(f'exp({x})' for x in sums)}) AS s{i}")
            i += 1
    return ", ".join(cols)


# Class masses behind the healthy gate (C3-C5): without the later stages a faulty row spreads evenly.
_GATE = "NOT (s0 >= 5e-1)"
_MASSES = [
    "s0", *[f"CASE WHEN {_GATE} THEN s1 * {b} * {leaf} ELSE s1 / 5e0 END" for b, leaf in (
        ("s3", "s6"), ("s3", "s7"), ("s2", "s4"), ("s2", "s5"), ("s3", "s8"))],
]
_SCORED = [
    ("scored", f"SELECT run_id, {_stage_sql()} FROM feats"),
    ("masses", "SELECT *, " + ", ".join(f"{m} AS m{i}" for i, m in enumerate(_MASSES)) + " FROM scored"),
    ("classes", f"SELECT *, [{', '.join(f'm{i} / (m0 + m1 + m2 + m3 + m4 + m5)' for i in range(6))}] AS p FROM masses"),
]


@query("live_diagnoses", "T4 C3 C4 C5", _with(f"""
    SELECT run AS run_id, opened_us, closed_us, reason, {top('p')} AS final_class, {r('list_max(p)', 'final_confidence')},
      CASE WHEN s0 >= 5e-1 THEN 'healthy' ELSE 'faulty' END AS stage1_pred,
      {', '.join(r(f'p[{i + 1}]', f'p_{c}') for i, c in enumerate(CLASSES))}
    FROM live_ended JOIN classes ON run_id = run || ':' || session""", _SCORED))
def _(t):
    # The cascade is stored and loaded, as in a job that did not train it.
    path = live.new_folder(t.spark, "weights")
    linear_stages.save(t.spark, WEIGHTS, path)
    weights = linear_stages.load(t.spark, path)
    rows, _ = live.run_closed(closed_runs(_epochs(t), SILENCE_SECONDS), lambda f: linear_stages.score(f, weights), "diagnosed")
    keep = ["run_id", "opened_us", "closed_us", "reason", "final_class", "final_confidence", "stage1_pred", *[f"p_{c}" for c in CLASSES]]
    return rounded(rows.select(*keep))


@query("live_running_features", "T3", f"""
    SELECT run_id, n AS n_finite, {rcols(['minimum', 'maximum', 'mean', 'std', 'slope'])}, best_epoch FROM (
      SELECT 'u' || user_id AS run_id, count(*) AS n, min(value) AS minimum, max(value) AS maximum, avg(value) AS mean, stddev_pop(value) AS std,
        regr_slope(value, (event_id // 2)::DOUBLE) AS slope, arg_min(event_id // 2, (value, event_id // 2)) AS best_epoch FROM events WHERE event_type <> 'error' GROUP BY user_id)""")
def _(t):
    s = live.read_epochs(t.spark, t.root, t.events.schema, "events.parquet").where("event_type <> 'error'").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run_id"), F.floor(F.col("event_id") / 2).alias("epoch"),
        F.col("ts").cast("timestamp").alias("ts"), "value",
    )
    store, state = live.new_folder(t.spark, "summaries"), live.new_folder(t.spark, "summaries-state")
    live.store_summaries(live.window_summaries(s), store, state)
    rows = live.merge_summaries(live.read_summaries(t.spark, store))
    return rounded(rows.select("run_id", "n_finite", "minimum", "maximum", "mean", "std", "slope", "best_epoch"))


@query("live_state_rows", "T3", f"""
    SELECT count(*) AS state_rows FROM (SELECT DISTINCT user_id, time_bucket(INTERVAL 1 DAY, ts) AS w FROM events WHERE event_type <> 'error')
    WHERE w + INTERVAL 1 DAY > {_LAST.replace('events', "events WHERE event_type <> 'error'")}""")
def _(t):
    """State that the windows leave behind: only those that the watermark has not passed."""
    s = live.read_epochs(t.spark, t.root, t.events.schema, "events.parquet").where("event_type <> 'error'").select(
        F.col("user_id").cast("string").alias("run_id"), F.floor(F.col("event_id") / 2).alias("epoch"), F.col("ts").cast("timestamp").alias("ts"), "value",
    )
    left = live.store_summaries(live.window_summaries(s), live.new_folder(t.spark, "summaries"), live.new_folder(t.spark, "summaries-state"))
    return t.spark.range(1).select(F.lit(left).cast("long").alias("state_rows"))



