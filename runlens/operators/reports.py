"""Report rows with a common envelope, their contract check, and summaries over many reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.numeric import ratio
from runlens.operators.actions import recommendations
from runlens.operators.narrative import narrate
from runlens.vocab import HEALTHY, LEAKAGE

SCHEMA_VERSION = "1.0"
SYSTEM = "runlens"
KINDS = ("diagnosis", "evidence", "interpretation", "recommendations", "case_summary")
HEADER = ("schema_version", "system_name", "created_at", "run_id", "payload")


def report_rows(evidence: DataFrame, language: str = "en", max_recommendations: int = 3) -> DataFrame:
    """One row per run and report kind: envelope columns and a JSON payload."""
    text = narrate(evidence, language)
    j = evidence.join(text, "run_id").withColumn("actions", recommendations(max_recommendations))
    common = [F.col("final_class"), F.col("final_confidence")]
    payloads = {
        "diagnosis": F.struct(*common, "stage_trace", "class_probs", "alternatives"),
        "evidence": F.struct(*common, "rejected", "curve_evidence", "integrity_evidence", "diagnostic_notes"),
        "interpretation": F.struct(*common, "summary", "explanation", "stage_texts", "symptoms", "confidence_notes", "limitations"),
        "recommendations": F.struct(*common, F.size("actions").alias("n_recommendations"), F.col("actions").alias("recommendations"), "limitations"),
        "case_summary": F.struct(*common, "summary", F.array(*map(F.lit, KINDS)).alias("files")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("schema_kind"), F.to_json(p).alias("payload")) for k, p in payloads.items()])
    return j.select("run_id", F.explode(rows).alias("r")).select(
        "run_id", "r.schema_kind", F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(SYSTEM).alias("system_name"),
        F.current_timestamp().alias("created_at"), "r.payload",
    )


def check_contract(rows: DataFrame, required: tuple[str, ...] = KINDS) -> DataFrame:
    """(case_id, errors): missing kinds, missing header values, wrong version, more than one run id."""
    per_row = F.array_compact(
        F.array(
            *[F.when(F.col(h).isNull(), F.concat(F.col("schema_kind"), F.lit(f": no {h}"))) for h in HEADER],
            F.when(F.col("schema_version") != SCHEMA_VERSION, F.concat(F.col("schema_kind"), F.lit(": schema_version"))),
        )
    )
    # Kinds come from a fixed vocabulary, so the sets stay small; run ids are compared by min and max.
    agg = rows.withColumn("e", per_row).groupBy("case_id").agg(
        F.collect_set(F.when(F.col("schema_kind").isin(*required), F.col("schema_kind"))).alias("kinds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("e")))).alias("row_errors"),
        (F.min("run_id") != F.max("run_id")).alias("mixed"),
    )
    missing = F.transform(F.array_except(F.array(*map(F.lit, required)), F.col("kinds")), lambda k: F.concat(F.lit("missing: "), k))
    mixed = F.array_compact(F.array(F.when(F.col("mixed"), F.lit("inconsistent run_id"))))
    return agg.select("case_id", F.concat(missing, "row_errors", mixed).alias("errors"))


def first_available(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The value of the best-ranked source that has one; rows: keys, priority, value."""
    return rows.where("value is not null").groupBy(*keys).agg(F.min_by("value", "priority").alias("value"))


def best_policy(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, policy, value): highest value, first listed policy on ties; rows: keys, policy, ord, value."""
    order = F.struct(F.col("value"), (-F.col("ord")).alias("o"))
    return long.groupBy(*keys).agg(F.max_by("policy", order).alias("best_policy"), F.max("value").alias("best_value"))


def cross_corpus(df: DataFrame, corpus: str, min_coverage: float = 0.92, tolerance: float = 5e-4, main_share: float = 0.40) -> DataFrame:
    """Headline and invariants per corpus from rows with y_true, pred_a (flat), pred_b (cascade), covered."""
    y = F.col("y_true")
    a, b = (F.col("pred_a") == y).cast("double"), (F.col("pred_b") == y).cast("double")
    swapped = ((y == LEAKAGE) & (F.col("pred_b") == HEALTHY)) | ((y == HEALTHY) & (F.col("pred_b") == LEAKAGE))
    t = df.groupBy(F.col(corpus).alias("corpus")).agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(a).alias("flat"), F.avg(b).alias("cascade"),
        F.avg(F.col("covered").cast("double")).alias("coverage"),
        ratio(F.count_if(swapped), F.count_if(F.col("pred_b") != y)).alias("leakage_healthy_share"),
    )
    return t.select(
        "corpus", "n_test", "flat", "cascade", "coverage", (F.col("coverage") >= min_coverage).alias("coverage_holds"),
        F.when(F.col("cascade") > F.col("flat"), "cascade").otherwise("flat").alias("best_policy"),
        # The best policy other than flat; only the cascade is one here.
        (F.col("cascade") >= F.col("flat") - tolerance).alias("best_beats_flat"),
        "leakage_healthy_share", (F.col("leakage_healthy_share") >= main_share).alias("leakage_healthy_is_main"),
    )
