"""Reconciling the flat and the cascade contour: policies, arbitration tables, constraint mechanisms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.probs import blend, items, let, soft_label, top_label, top_value
from runlens.vocab import CLASSES

POLICIES = ("agreement_or_cascade", "agreement_or_flat", "confidence_weighted", "external_arbitration")
TRIGGER_CONFIDENCE = 0.65
SOURCES = ("flat", "cascade", "neither")


def with_labels(df: DataFrame) -> DataFrame:
    """Add label and confidence of both contours and whether they agree."""
    return df.select(
        "*",
        top_label(F.col("flat")).alias("flat_label"),
        top_value(F.col("flat")).alias("flat_conf"),
        top_label(F.col("cascade")).alias("cascade_label"),
        top_value(F.col("cascade")).alias("cascade_conf"),
    ).withColumn("agreement", F.col("flat_label") == F.col("cascade_label"))


def pair_predictions(flat: DataFrame, cascade: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both contours side by side, and the run ids that only one of them has."""
    both = flat.join(cascade, "run_id")
    lost = flat.select("run_id").join(cascade, "run_id", "left_anti").unionByName(
        cascade.select("run_id").join(flat, "run_id", "left_anti")
    )
    return with_labels(both), lost


def agreed_confidence() -> Column:
    return F.col("flat_conf") * 0.5 + F.col("cascade_conf") * 0.5


def _agreement_or(contour: str) -> dict[str, Column]:
    agree = F.col("agreement")
    return {
        "final_label": F.col(f"{contour}_label"),
        "final_confidence": F.when(agree, agreed_confidence()).otherwise(F.col(f"{contour}_conf")),
        "resolution_path": F.when(agree, "agreement").otherwise(f"{contour}_picked"),
    }


def _weighted(alpha: float) -> dict[str, Column]:
    p = blend(F.col("flat"), F.col("cascade"), alpha)
    return {"final_label": top_label(p), "final_confidence": top_value(p), "resolution_path": F.lit("weighted")}


def policy_columns(policy: str, alpha: float = 0.5) -> dict[str, Column]:
    """Result columns of a policy that needs nothing but the two contours."""
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must be in [0, 1], got {alpha}")
    table = {
        "agreement_or_cascade": lambda: _agreement_or("cascade"),
        "agreement_or_flat": lambda: _agreement_or("flat"),
        "confidence_weighted": lambda: _weighted(alpha),
    }
    if policy not in table:
        raise ValueError(f"unknown policy {policy!r}; expected one of {tuple(table)}")
    return table[policy]()


RESULT = ("final_label", "final_confidence", "flat_label", "flat_conf", "cascade_label", "cascade_conf", "agreement", "resolution_path")


def resolve(df: DataFrame, policy: str, alpha: float = 0.5) -> DataFrame:
    """``df`` needs flat[6] and cascade[6]; adds the RESULT columns."""
    labelled = df if "flat_label" in df.columns else with_labels(df)
    return labelled.withColumns(policy_columns(policy, alpha))


def resolve_all(df: DataFrame, policies: tuple[str, ...] = POLICIES[:3], alpha: float = 0.5) -> DataFrame:
    """Every policy in one pass: one row per input row and policy (the rows are scored once)."""
    labelled = with_labels(df)
    results = F.array(
        *[F.struct(F.lit(p).alias("policy"), *[c.alias(n) for n, c in policy_columns(p, alpha).items()]) for p in policies]
    )
    rest = [c for c in labelled.columns]
    return labelled.withColumn("_r", F.explode(results)).select(
        *rest, "_r.policy", "_r.final_label", "_r.final_confidence", "_r.resolution_path"
    )


# --- arbitration as tables -----------------------------------------------------------------------


def trigger(low_confidence: float) -> Column:
    """disagreement / low_conf_agreement, null when nothing needs arbitration."""
    low = F.least("flat_conf", "cascade_conf") < low_confidence
    return F.when(~F.col("agreement"), "disagreement").when(low, "low_conf_agreement")


def request_key(evidence: Column, model: str, fold: Column | None = None) -> Column:
    """SHA-256 over everything that defines a request (probabilities to six digits, no timestamps)."""
    body = [
        F.lit(model).alias("model"),
        F.col("run_id").alias("run_id"),
        F.col("flat_label").alias("flat_label"),
        F.concat_ws(",", *[F.format_string("%.6f", p) for p in items(F.col("flat"), 6)]).alias("flat"),
        F.col("cascade_label").alias("cascade_label"),
        F.concat_ws(",", *[F.format_string("%.6f", p) for p in items(F.col("cascade"), 6)]).alias("cascade"),
        F.sha2(evidence, 256).alias("evidence"),
    ]
    if fold is not None:
        body.append(fold.cast("string").alias("fold"))
    return F.sha2(F.concat_ws("|", *[F.coalesce(b, F.lit("")) for b in body]), 256)


def arbitration_requests(
    df: DataFrame,
    *,
    low_confidence: float = TRIGGER_CONFIDENCE,
    evidence: Column | None = None,
    model: str = "default",
    fold: Column | None = None,
    answered: DataFrame | None = None,
) -> DataFrame:
    """Work queue: one row per distinct request that is triggered and not answered yet."""
    labelled = with_labels(df).withColumn("trigger", trigger(low_confidence)).where("trigger is not null")
    ev = F.lit("") if evidence is None else evidence
    out = labelled.withColumn("request_key", request_key(ev, model, fold))
    out = out.select("request_key", "run_id", "trigger", "flat_label", "flat_conf", "cascade_label", "cascade_conf")
    out = out.dropDuplicates(["request_key"])
    return out if answered is None else out.join(answered.select("request_key"), "request_key", "left_anti")


def json_block(text: Column) -> Column:
    """The JSON object inside a response: without a code fence, else from first { to last }."""

    def body(t: Column) -> Column:
        fenced = F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"```$", "")
        return F.trim(F.when(F.startswith(t, F.lit("```")), fenced).otherwise(t))

    def valid(b: Column) -> Column:
        inner = F.nullif(F.regexp_extract(b, r"(?s)\{.*\}", 0), F.lit(""))
        options = F.filter(F.array(b, inner), lambda x: F.try_parse_json(x).isNotNull())
        return F.get(options, F.lit(0))

    return let(let(F.trim(text), body), valid)


def _decision(j: Column) -> Column:
    v = F.try_parse_json(j)
    kind = F.schema_of_variant(F.try_variant_get(v, "$.chosen_label", "variant"))
    label, source = F.get_json_object(j, "$.chosen_label"), F.get_json_object(j, "$.chosen_source")
    given = F.get_json_object(j, "$.confidence")
    conf = F.when(F.try_variant_get(v, "$.confidence", "variant").isNotNull(), given.try_cast("double")).otherwise(F.lit(0.5))
    error = (
        F.when(~F.coalesce(F.startswith(j, F.lit("{")), F.lit(False)), "response was not a JSON object")
        .when(F.coalesce(kind, F.lit("")) != "STRING", "chosen_label missing or not a string")
        .when(~label.isin(*CLASSES), "chosen_label outside the vocabulary")
        .when(~F.coalesce(source.isin(*SOURCES), F.lit(False)), "chosen_source outside flat, cascade, neither")
        .when(conf.isNull(), "confidence not a number")
    )
    clamped = F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0))
    return F.struct(label.alias("label"), source.alias("source"), clamped.alias("confidence"), error.alias("error"))


def parse_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """Add chosen_label, chosen_source, confidence (clamped) and ``error`` (null = usable)."""
    r = responses.withColumn("_d", let(json_block(F.col(text)), _decision))
    ok = F.col("_d.error").isNull()
    return r.select(
        *[c for c in responses.columns if c != text],
        F.when(ok, F.col("_d.label")).alias("chosen_label"),
        F.when(ok, F.col("_d.source")).alias("chosen_source"),
        F.when(ok, F.col("_d.confidence")).alias("confidence"),
        F.col("_d.error").alias("error"),
    )


def snap(df: DataFrame) -> DataFrame:
    """Force the choice into {flat_label, cascade_label}.

    A third label becomes the named source's label (flat unless the source is cascade) with at most 0.5.
    """
    label, source = F.col("chosen_label"), F.col("chosen_source")
    inside = label.isin(F.col("flat_label"), F.col("cascade_label"))
    to_cascade = source == "cascade"
    return df.select(
        *df.columns,
        F.when(inside, label).when(to_cascade, F.col("cascade_label")).otherwise(F.col("flat_label")).alias("snapped_label"),
        F.when(inside, F.when(label == F.col("flat_label"), "flat").otherwise("cascade"))
        .when(to_cascade, "cascade").otherwise("flat").alias("snapped_source"),
        F.when(inside, F.col("confidence")).otherwise(F.least(F.col("confidence"), F.lit(0.5))).alias("snapped_confidence"),
    )


def resolve_with_responses(df: DataFrame, responses: DataFrame, low_confidence: float = TRIGGER_CONFIDENCE) -> DataFrame:
    """Join usable external decisions; triggered rows without one fall back to the flat contour.

    Responses belong to ``request_key`` where both tables have it, else to ``run_id``; one for each key is used, the smallest of
    several usable ones.
    """
    base = with_labels(df).withColumn("trigger", trigger(low_confidence))
    key = "request_key" if "request_key" in df.columns and "request_key" in responses.columns else "run_id"
    chosen = F.min(F.struct("chosen_label", "chosen_source", "confidence")).alias("r")
    good = responses.where("error is null").groupBy(key).agg(chosen).select(key, "r.*")
    j = base.join(good, key, "left")
    j = snap(j)
    need, answered = F.col("trigger").isNotNull(), F.col("chosen_label").isNotNull()
    return j.withColumns(
        {
            "final_label": F.when(need & answered, F.col("snapped_label")).otherwise(F.col("flat_label")),
            "final_confidence": F.when(~need, agreed_confidence())
            .when(answered, F.col("snapped_confidence"))
            .otherwise(F.col("flat_conf")),
            "resolution_path": F.when(~need, "agreement").when(answered, "llm_arbitrated").otherwise("llm_skipped"),
            "chosen_source": F.when(~need, F.lit(None).cast("string")).when(answered, F.col("snapped_source")).otherwise("flat"),
            "raw_label": F.when(need, F.col("chosen_label")),
        }
    )


def arbitration_outputs(resolved: DataFrame) -> DataFrame:
    """Columns that stacking reads: arbitrator[6], arb_triggered, arb_confidence (zeros when not triggered)."""
    on = F.col("resolution_path").isin("llm_arbitrated", "llm_skipped")
    zeros = F.array(*[F.lit(0.0)] * len(CLASSES))
    return resolved.withColumns(
        {
            "arbitrator": F.when(on, soft_label(F.col("final_label"), F.col("final_confidence"))).otherwise(zeros),
            "arb_triggered": on.cast("int"),
            "arb_confidence": F.when(on, F.col("final_confidence")).otherwise(0.0),
        }
    )


def arbitration_stats(resolved: DataFrame) -> DataFrame:
    """Calls by trigger, path and chosen source with their accuracy (needs y_true)."""
    called = resolved.where("trigger is not null")
    return called.groupBy("trigger", "resolution_path", "chosen_source").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.avg((F.col("final_label") == F.col("y_true")).cast("double")).alias("accuracy"),
        F.avg((F.col("flat_label") == F.col("y_true")).cast("double")).alias("flat_accuracy"),
        F.avg((F.col("cascade_label") == F.col("y_true")).cast("double")).alias("cascade_accuracy"),
    )


def template_choice() -> Column:
    """The more confident contour; the alphabetically first label on a tie."""
    f, c = F.col("flat_conf"), F.col("cascade_conf")
    return F.when(f > c, F.col("flat_label")).when(c > f, F.col("cascade_label")).otherwise(
        F.least("flat_label", "cascade_label")
    )


def constraint_comparison(resolved: DataFrame) -> DataFrame:
    """(mechanism, n, accuracy, violation_rate) on answered disagreements: snapped, raw, template."""
    pool = resolved.where("not agreement and raw_label is not null")
    outside = ~F.col("raw_label").isin(F.col("flat_label"), F.col("cascade_label"))
    mechanisms = F.array(
        F.struct(F.lit("hard_snap").alias("mechanism"), F.col("final_label").alias("pred"), F.lit(False).alias("out")),
        F.struct(F.lit("raw_label").alias("mechanism"), F.col("raw_label").alias("pred"), outside.alias("out")),
        F.struct(F.lit("template").alias("mechanism"), template_choice().alias("pred"), F.lit(False).alias("out")),
    )
    long = pool.select("y_true", F.explode(mechanisms).alias("m")).select("y_true", "m.*")
    return long.groupBy("mechanism").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("pred") == F.col("y_true")).cast("double")).alias("accuracy"),
        F.avg(F.col("out").cast("double")).alias("violation_rate"),
    )
