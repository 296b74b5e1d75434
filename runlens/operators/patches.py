"""Did a change help? Before/after comparison of diagnosed runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.probs import prob_of
from runlens.operators.actions import ACTIONS, applicability
from runlens.vocab import HEALTHY

MATERIAL = 0.05


def join_cases(cases: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """case_id, before, after, action + both diagnoses (class, probabilities)."""
    b = diagnoses.select(F.col("run_id").alias("before"), F.col("final_class").alias("before_class"), F.col("class_probs").alias("before_probs"))
    a = diagnoses.select(F.col("run_id").alias("after"), F.col("final_class").alias("after_class"), F.col("class_probs").alias("after_probs"))
    return cases.join(b, "before").join(a, "after")


def _chosen(cls: Column, probs: Column) -> Column:
    return F.when(cls == HEALTHY, F.lit(0.0)).otherwise(prob_of(probs, cls))


def classify(cases: DataFrame) -> DataFrame:
    """Add delta_p_healthy, delta_p_faulty_chosen, status and rationale."""
    d_h = F.get("after_probs", F.lit(0)) - F.get("before_probs", F.lit(0))
    d_f = _chosen(F.col("after_class"), F.col("after_probs")) - _chosen(F.col("before_class"), F.col("before_probs"))
    t = cases.withColumns({"delta_p_healthy": d_h, "delta_p_faulty_chosen": d_f})
    dh, df_ = F.col("delta_p_healthy"), F.col("delta_p_faulty_chosen")
    bc, ac = F.col("before_class"), F.col("after_class")
    bh, ah = bc == HEALTHY, ac == HEALTHY
    observe = F.col("action") == "observe_only"
    recovered = ~bh & ah
    up = (dh >= 2 * MATERIAL) & (df_ <= -MATERIAL)
    broke = bh & ~ah
    down = dh <= -2 * MATERIAL
    closer = ~bh & ~ah & ((dh >= MATERIAL) | (df_ <= -MATERIAL))
    status = (
        F.when(observe, "observe_only").when(recovered, "improved").when(up, "improved").when(broke, "degraded")
        .when(down, "degraded").when(closer, "partial").otherwise("neutral")
    )
    why = (
        F.when(observe & (bc == ac), F.lit("action is observe_only — interpreting `after` as a replication. classes match → consistent diagnosis under replication."))
        .when(observe, F.format_string("action is observe_only — interpreting `after` as a replication. classes differ (before=%s, after=%s) → unstable diagnosis.", bc, ac))
        .when(recovered, F.format_string("before was faulty (%s); after is healthy.", bc))
        .when(up, F.format_string("P(healthy) increased by %+.3f and P(%s) dropped by %.3f.", dh, bc, -df_))
        .when(broke, F.format_string("before was healthy; after became %s.", ac))
        .when(down, F.format_string("P(healthy) decreased by %.3f.", -dh))
        .when(closer & (bc != ac), F.format_string("still faulty, but materially closer to healthy on the cascade. faulty class also moved from `%s` to `%s`.", bc, ac))
        .when(closer, F.lit("still faulty, but materially closer to healthy on the cascade."))
        .otherwise(F.format_string("Δ P(healthy) = %+.3f, Δ P(%s) = %+.3f — below material thresholds.", dh, bc, df_))
    )
    return t.withColumns({"status": status, "rationale": why})


def meta_delta(cases: DataFrame, meta: DataFrame) -> DataFrame:
    """(case_id, key, before_value, after_value, changed) for the metadata keys of the case's action.

    ``meta``: run_id, meta_json.
    """
    # A path that is a literal is parsed once, not for every row.
    value = lambda c, key: F.get_json_object(c, f"$.{key}")
    each = F.lit(None).cast("array<struct<key:string,b:string,a:string>>")
    for name, _, meta_keys, _ in ACTIONS:
        listed = [F.struct(F.lit(key).alias("key"), value("mb", key).alias("b"), value("ma", key).alias("a")) for key in meta_keys]
        each = F.when(F.col("action") == name, F.array(*listed) if listed else F.array().cast("array<struct<key:string,b:string,a:string>>")).otherwise(each)
    j = cases.join(meta.select(F.col("run_id").alias("before"), F.col("meta_json").alias("mb")), "before").join(
        meta.select(F.col("run_id").alias("after"), F.col("meta_json").alias("ma")), "after"
    )
    rows = j.select("case_id", F.explode(each).alias("e"))
    b, a = F.col("e.b"), F.col("e.a")
    return rows.select("case_id", F.col("e.key").alias("key"), b.alias("before_value"), a.alias("after_value"), (~b.eqNullSafe(a)).alias("changed"))


def applicability_of(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether the action fits the run it was applied to: (case_id, in_target, applicable)."""
    flags = applicability()
    fits, target = F.lit(False), F.lit(False)
    for name, targets, _, _ in ACTIONS:
        mine = F.col("action") == name
        fits = F.when(mine, flags[name]).otherwise(fits)
        target = F.when(mine, F.col("final_class").isin(*targets)).otherwise(target)
    j = cases.join(evidence.select(F.col("run_id").alias("before"), "final_class", "curve_evidence", "integrity_evidence"), "before")
    return j.select("case_id", target.alias("in_target"), fits.alias("applicable"))


def patch_report(cases: DataFrame, diagnoses: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per case: outcome and applicability."""
    out = classify(join_cases(cases, diagnoses))
    return out.join(applicability_of(cases, evidence), "case_id").drop("before_probs", "after_probs")
