"""Evidence behind a diagnosis: decisive features, curve and integrity notes, hypotheses.

Everything is computed inside the row (arrays of at most a few dozen entries), without shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.numeric import finite
from runlens.functions.probs import items
from runlens.vocab import CLASSES, DATA, FAULTY, FAULTY_CLASSES, HEALTHY, OPTGEN, BRANCH_OF

# --- fixed values: keyword -> class, first match wins ---------------------------------------------
NOTE_KEYWORDS = (
    ("leakage proxy", "leakage"),
    ("leakage signal", "leakage"),
    ("leakage evidence", "leakage"),
    ("train/val overlap", "leakage"),
    ("duplicate overlap", "leakage"),
    ("replay", "leakage"),
    ("split_hash", "leakage"),
    ("overfitting fingerprint", "overfitting"),
    ("overfitting evidence", "overfitting"),
    ("early-overfitting", "overfitting"),
    ("late-overfitting", "overfitting"),
    ("underfitting evidence", "underfitting"),
    ("underfitting", "underfitting"),
    ("label noise", "label_noise"),
    ("label_noise", "label_noise"),
    ("declared noise", "label_noise"),
    ("diverged", "instability"),
    ("divergence", "instability"),
    ("instability", "instability"),
    ("nan/inf", "instability"),
    ("loss spike", "instability"),
)
# --- end of fixed values ------------------------------------------------------------------------


def feature_evidence(importances: dict[str, dict[str, float]], k: int = 5) -> Column:
    """Per row: the features that weighed most in each fitted stage, as (stage, column, value, importance), stages in order.

    A feature's weight is the stage's importance times the size of its value; where all of these are zero, the importances decide.
    ``importances`` is the models' own small table.
    """
    stages = []
    for stage, weights in importances.items():
        x = {c: finite(F.col(c).cast("double")) for c in weights}
        contrib = [F.coalesce(F.abs(x[c]) * F.lit(float(w)), F.lit(0.0)) for c, w in weights.items()]
        some = F.exists(F.array(*contrib), lambda v: v > 0)
        entries = F.array(*[
            F.struct((-F.when(some, v).otherwise(F.lit(float(w)))).alias("neg"), F.lit(i).alias("ord"), F.lit(c).alias("column"), x[c].alias("value"))
            for i, ((c, w), v) in enumerate(zip(weights.items(), contrib))
        ])
        stages.append(F.transform(F.slice(F.array_sort(entries), 1, k), _named(stage)))
    return F.concat(*stages)


def _named(stage: str):
    return lambda e: F.struct(F.lit(stage).alias("stage"), e["column"].alias("column"), e["value"].alias("value"), (-e["neg"]).alias("importance"))


def top_features(table: DataFrame, importances: dict[str, dict[str, float]], k: int = 5) -> DataFrame:
    """run_id + (stage, rank, column, value, score): features by importance x |value| per stage.

    When every product is zero the importances alone decide. ``importances`` is the model's own small
    table (stage -> column -> importance).
    """
    stages = []
    for stage, weights in importances.items():
        cols = list(weights)
        x = {c: finite(F.col(c).cast("double")) for c in cols}
        contrib = {c: F.coalesce(F.abs(x[c]) * F.lit(float(weights[c])), F.lit(0.0)) for c in cols}
        any_positive = F.greatest(*contrib.values()) > 0 if len(cols) > 1 else next(iter(contrib.values())) > 0
        entries = F.array(
            *[
                F.struct(
                    (-F.when(any_positive, contrib[c]).otherwise(F.lit(float(weights[c])))).alias("neg"),
                    F.lit(i).alias("ord"), F.lit(c).alias("column"), x[c].alias("value"),
                )
                for i, c in enumerate(cols)
            ]
        )
        stages.append(F.struct(F.lit(stage).alias("stage"), F.slice(F.array_sort(entries), 1, k).alias("top")))
    per = table.select("run_id", F.explode(F.array(*stages)).alias("s"))
    flat = per.select("run_id", "s.stage", F.posexplode("s.top").alias("rank", "f"))
    return flat.select(
        "run_id", "stage", (F.col("rank") + 1).alias("rank"), "f.column", "f.value", (-F.col("f.neg")).alias("score")
    )


def _share(x: Column) -> Column:
    """A share as a whole percentage, half to even."""
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))


def curve_notes() -> Column:
    """Notes from val_loss_argmin_frac, acc_final_gap and diverged."""
    frac, gap = finite(F.col("val_loss_argmin_frac")), finite(F.col("acc_final_gap"))
    return F.array_compact(
        F.array(
            F.when(
                (frac >= 0) & (frac < 0.5),
                F.concat(F.lit("val_loss minimum reached at "), _share(frac), F.lit(" of training — early-overfitting fingerprint.")),
            ),
            F.when(gap > 0.15, F.format_string("final train/val accuracy gap = %+.3f — overfitting evidence.", gap)),
            F.when(F.abs(gap) < 0.01, F.lit("near-zero train/val gap — could indicate either healthy convergence or leakage.")),
            F.when(F.col("diverged") > 0, F.lit("history contains NaN/inf in train_loss or val_loss — training diverged.")),
        )
    )


def integrity_notes() -> Column:
    overlap = finite(F.col("di_train_val_overlap"))
    sat, lock = finite(F.col("di_proxy_saturation")), finite(F.col("di_proxy_train_val_lockstep"))
    return F.array_compact(
        F.array(
            F.when(overlap > 0.01, F.format_string("train/val overlap = %.3f — direct leakage signal.", overlap)),
            F.when(
                (sat > 0.95) & (lock > 0.95),
                F.format_string("saturation=%.3f with high train/val lockstep (%.3f) — strong leakage proxy.", sat, lock),
            ),
        )
    )


def rejected_hypotheses() -> Column:
    """Classes ruled out by the stage path with their probabilities, most likely first."""
    p = dict(zip(CLASSES, items(F.col("class_probs"), len(CLASSES))))
    s1, s2 = F.col("stage1_pred"), F.col("stage2_pred")
    loser = F.when(s2 == DATA, OPTGEN).otherwise(DATA)

    def entry(order: int, c: str) -> Column:
        return F.struct((-p[c]).alias("neg"), F.lit(order).alias("ord"), F.lit(c).alias("label"))

    rejected = [F.when((s1 == FAULTY) & s2.isNotNull(), entry(0, HEALTHY))]
    for i, c in enumerate(FAULTY_CLASSES, start=1):
        lost = (s1 == HEALTHY) | ((s1 == FAULTY) & s2.isNotNull() & (loser == BRANCH_OF[c]))
        rejected.append(F.when(lost, entry(i, c)))
    return F.transform(
        F.array_sort(F.array_compact(F.array(*rejected))), lambda e: F.struct(e["label"].alias("label"), (-e["neg"]).alias("p"))
    )


def global_notes() -> Column:
    alt = F.get("alternatives", F.lit(0))
    return F.array_compact(
        F.array(
            F.when(
                F.col("final_confidence") < 0.5,
                F.format_string("low final confidence (%.3f) — treat the diagnosis as tentative.", F.col("final_confidence")),
            ),
            F.when(F.col("stage1_conf") < 0.6, F.lit("Stage 1 (healthy/faulty) is itself uncertain.")),
            F.when(F.col("stage2_conf") < 0.6, F.lit("Stage 2 branch decision is uncertain — both branches are plausible.")),
            F.when(alt["p"] > 0.25, F.format_string("strong alternative: `%s` (p=%.3f).", alt["label"], alt["p"])),
        )
    )


def supported_class(note: Column) -> Column:
    """Class of the first keyword found in the note, null without one."""
    low = F.lower(note)
    out = F.lit(None).cast("string")
    for kw, cls in reversed(NOTE_KEYWORDS):
        out = F.when(F.contains(low, F.lit(kw)), cls).otherwise(out)
    return out


def split_notes(notes: Column, diagnosis: Column) -> tuple[Column, Column]:
    """(decisive, secondary): notes that support the diagnosis or nothing, and notes for other classes."""

    def other(n: Column) -> Column:
        return F.coalesce(supported_class(n) != diagnosis, F.lit(False))

    return F.filter(notes, lambda n: ~other(n)), F.filter(notes, other)


STAGE_NAMES = ("stage1", "stage2", "stage3")


def stage_trace() -> Column:
    """Stages that ran: (stage, predicted, confidence)."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"{s}_pred").isNotNull(),
                    F.struct(F.lit(s).alias("stage"), F.col(f"{s}_pred").alias("predicted"), F.col(f"{s}_conf").alias("confidence")),
                )
                for s in STAGE_NAMES
            ]
        )
    )


def build_evidence(diagnoses: DataFrame, features: DataFrame, importances: dict[str, dict[str, float]] | None = None, k: int = 5) -> DataFrame:
    """One nested evidence row per run from diagnoses (``cascade.diagnose``) and features.

    ``features``: run_id, the curve features used in notes, di_train_val_overlap, di_label_noise_rate_declared and
    the two proxies. With the ``importances`` of the fitted stages there is ``top_features`` too; features must have their columns.
    """
    j = diagnoses.join(features, "run_id")
    top = [feature_evidence(importances, k).alias("top_features")] if importances else []
    out = j.withColumns({"curve_notes": curve_notes(), "integrity_notes": integrity_notes(), "own_notes": global_notes()})
    return out.select(
        *diagnoses.columns,
        *top,
        stage_trace().alias("stage_trace"),
        rejected_hypotheses().alias("rejected"),
        F.struct(
            F.col("n_epochs").cast("long").alias("n_epochs"),
            finite(F.col("train_loss_final")).alias("final_train_loss"),
            finite(F.col("val_loss_final")).alias("final_val_loss"),
            F.col("val_loss_min").alias("val_loss_min"),
            F.col("val_loss_argmin_frac").alias("val_loss_argmin_frac"),
            finite(F.col("acc_final_gap")).alias("final_acc_gap"),
            F.col("acc_max_gap").alias("max_acc_gap"),
            (F.col("diverged") > 0).alias("diverged"),
        ).alias("curve_evidence"),
        F.struct("di_train_val_overlap", "di_label_noise_rate_declared", "di_proxy_saturation", "di_proxy_train_val_lockstep").alias(
            "integrity_evidence"
        ),
        "curve_notes",
        "integrity_notes",
        F.concat("own_notes", "curve_notes", "integrity_notes").alias("diagnostic_notes"),
    )
