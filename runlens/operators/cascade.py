"""Cascade scoring: stage probabilities to class probabilities, decisions and diagnoses.

Stage probabilities travel as one ``ARRAY<DOUBLE>`` in the order of ``vocab.STAGE_COLUMNS``.
A stage that was not trained has null entries. Everything is element arithmetic (no UDF, no
shuffle), so scoring is a narrow projection over the scored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.probs import alternatives, items, let, normalise, top_label, top_value
from runlens.vocab import CLASSES, DATA, FAULTY, HEALTHY, OPTGEN, STAGE3_DATA, STAGE3_OPT


def branch_split(p_data: Column, p_opt: Column) -> tuple[Column, Column]:
    """Branch probabilities scaled to one; when both are zero the optimisation branch gets it all."""
    total = p_data + p_opt
    zero = total == 0
    return (
        F.when(zero, F.lit(0.0)).otherwise(F.try_divide(p_data, total)),
        F.when(zero, F.lit(1.0)).otherwise(F.try_divide(p_opt, total)),
    )


def compose_probabilities(stage: Column, gate: Column | None) -> Column:
    """Class probabilities from stage probabilities.

    ``gate`` (boolean, true = stages 2 and 3 ran) reproduces batch scoring, where a row called
    healthy never reaches stage 2; ``None`` composes all stages for every row.
    """
    return let(stage, lambda s: _composed(s, gate))


def _composed(stage: Column, gate: Column | None) -> Column:
    ph, pf, pd_, po, leak, noise, over, under, inst = items(stage, 9)
    p_faulty = F.coalesce(pf, F.lit(1.0) - ph)
    has2 = pd_.isNotNull() & po.isNotNull()
    if gate is not None:
        has2 = has2 & gate
    b_data, b_opt = branch_split(pd_, po)
    share = p_faulty / F.lit(5.0)

    def leaf(p: Column, branch: Column, siblings: int) -> Column:
        within = F.coalesce(p, F.lit(1.0 / siblings))
        return F.when(has2, p_faulty * branch * within).otherwise(share)

    return normalise(
        [ph, leaf(over, b_opt, 3), leaf(under, b_opt, 3), leaf(leak, b_data, 2), leaf(noise, b_data, 2), leaf(inst, b_opt, 3)]
    )


def hard_commit(cascade: Column, stage1_label: Column) -> Column:
    """Zero the healthy class where stage 1 said faulty, then renormalise."""
    def committed(a: Column) -> Column:
        p = items(a, len(CLASSES))
        return normalise([F.when(stage1_label == FAULTY, F.lit(0.0)).otherwise(p[0]), *p[1:]])

    return let(cascade, committed)


def diagnose(
    scored: DataFrame, *, healthy_threshold: float = 0.5, top_k: int = 3, gate: bool = True, stage: str = "stage_probs"
) -> DataFrame:
    """Stage decisions, class probabilities, final class and top-k alternatives per row.

    Adds: stage1_pred/conf, stage2_pred/conf, stage3_pred/conf (null = stage not run), class_probs,
    final_class, final_confidence, alternatives.
    """
    s = items(F.col(stage), 9)
    healthy = s[0] >= healthy_threshold
    stage1 = F.when(healthy, HEALTHY).otherwise(FAULTY)
    ran2 = ~healthy & s[2].isNotNull()
    data_side = s[2] >= s[3]
    pair, triple = F.array(*s[4:6]), F.array(*s[6:9])
    out = scored.withColumn("stage1_pred", stage1).withColumn(
        "stage1_conf", F.when(healthy, s[0]).otherwise(F.coalesce(s[1], F.lit(1.0) - s[0]))
    )
    out = out.withColumn("stage2_pred", F.when(ran2, F.when(data_side, DATA).otherwise(OPTGEN))).withColumn(
        "stage2_conf", F.when(ran2, F.greatest(s[2], s[3]))
    )
    ran3 = F.when(data_side, s[4].isNotNull()).otherwise(s[6].isNotNull()) & ran2
    out = out.withColumn(
        "stage3_pred",
        F.when(ran3, F.when(data_side, top_label(pair, STAGE3_DATA)).otherwise(top_label(triple, STAGE3_OPT))),
    ).withColumn("stage3_conf", F.when(ran3, F.when(data_side, top_value(pair)).otherwise(top_value(triple))))
    gate_col = F.col("stage1_pred") == FAULTY if gate else None
    out = out.withColumn("class_probs", compose_probabilities(F.col(stage), gate_col))
    out = out.withColumn("final_class", top_label(F.col("class_probs"))).withColumn(
        "final_confidence", top_value(F.col("class_probs"))
    )
    return out.withColumn("alternatives", alternatives(F.col("class_probs"), F.col("final_class"), top_k))


def flatten(diagnoses: DataFrame, top_k: int = 3) -> DataFrame:
    """One plain column per stage decision, class probability and alternative."""
    cols = [
        "run_id", "final_class", "final_confidence", "stage1_pred", "stage1_conf",
        "stage2_pred", "stage2_conf", "stage3_pred", "stage3_conf",
    ]
    probs = [F.get("class_probs", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(CLASSES)]
    alts = []
    for k in range(top_k):
        alts.append(F.get("alternatives", F.lit(k))["label"].alias(f"alt{k + 1}"))
        alts.append(F.get("alternatives", F.lit(k))["p"].alias(f"alt{k + 1}_p"))
    return diagnoses.select(*cols, *probs, *alts)
