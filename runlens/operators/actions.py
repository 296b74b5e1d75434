"""The corrective-action catalogue: applicability, ranking, parameter checks, vetting of outside advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.vocab import CLASSES, INSTABILITY, LABEL_NOISE, LEAKAGE, OVERFITTING, UNDERFITTING

# --- fixed values: actions in registry order: name, classes, metadata keys they change, parameters
# (name, type, default, min, max) ----------------------------------------------------------------
ACTIONS = (
    ("reduce_lr", (INSTABILITY, OVERFITTING), ("lr", "learning_rate"), (("factor", "float", "0.1", 0.0001, 1.0),)),
    ("increase_capacity", (UNDERFITTING,), ("n_params", "hidden_size", "depth", "width"), (("scale", "float", "2.0", 1.0, 8.0),)),
    (
        "add_regularization", (OVERFITTING,), ("weight_decay", "dropout"),
        (("weight_decay", "float", "0.0001", 0.0, 1.0), ("dropout", "float", None, 0.0, 0.95)),
    ),
    ("early_stop", (OVERFITTING,), ("early_stop", "patience", "best_epoch"), (("patience", "int", "5", 1.0, 100.0),)),
    ("clean_label_noise", (LABEL_NOISE,), ("label_noise_rate", "n_train", "removed_fraction"), (("removed_fraction", "float", "0.1", 0.0, 0.5),)),
    (
        "fix_split", (LEAKAGE,), ("split_seed", "train_val_overlap", "duplicate_index_overlap"),
        (("split_seed", "int", "0", None, None), ("dedup", "bool", "true", None, None)),
    ),
    ("retrain_with_seed", CLASSES, ("seed", "training_seed"), (("seed", "int", "1", None, None),)),
    ("observe_only", CLASSES, (), ()),
)
# --- end of fixed values ------------------------------------------------------------------------

NAMES = tuple(a[0] for a in ACTIONS)


def action_table(spark: SparkSession) -> DataFrame:
    """Eight-row dimension: action, ord, target_classes, meta_keys."""
    rows = [(name, i, list(targets), list(keys)) for i, (name, targets, keys, _) in enumerate(ACTIONS)]
    return spark.createDataFrame(rows, "action string, ord int, target_classes array<string>, meta_keys array<string>")


def parameter_table(spark: SparkSession) -> DataFrame:
    rows = [(a, i, *p) for a, _, _, params in ACTIONS for i, p in enumerate(params)]
    return spark.createDataFrame(
        rows, "action string, param_ord int, param string, type string, default string, min double, max double"
    )


def applicability() -> dict[str, Column]:
    """Boolean per action from final_class, curve_evidence and integrity_evidence."""
    cls = F.col("final_class")

    def or_(label: str, cond: Column) -> Column:
        return (cls == label) | F.coalesce(cond, F.lit(False))

    overfit = or_(OVERFITTING, F.col("curve_evidence.final_acc_gap") > 0.10)
    return {
        "reduce_lr": or_(INSTABILITY, F.col("curve_evidence.diverged")),
        "increase_capacity": or_(UNDERFITTING, F.col("curve_evidence.final_train_loss") > 1.0),
        "add_regularization": overfit,
        "early_stop": overfit,
        "clean_label_noise": or_(LABEL_NOISE, F.col("integrity_evidence.di_label_noise_rate_declared") > 0.05),
        "fix_split": or_(LEAKAGE, F.col("integrity_evidence.di_train_val_overlap") > 0.01),
        "retrain_with_seed": F.lit(True),
        "observe_only": F.lit(True),
    }


def with_applicability(evidence: DataFrame) -> DataFrame:
    return evidence.withColumns({f"applies_{n}": c for n, c in applicability().items()})


def recommendations(max_recommendations: int = 3) -> Column:
    """Ranked actions of a row: those aimed at the class first, then registry order."""
    flags = applicability()
    entries = []
    for i, (name, targets, _, _) in enumerate(ACTIONS):
        miss = F.when(F.col("final_class").isin(*targets), 0).otherwise(1)
        entries.append(F.when(flags[name], F.struct(miss.alias("miss"), F.lit(i).alias("ord"), F.lit(name).alias("action"))))
    ranked = F.slice(F.array_sort(F.array_compact(F.array(*entries))), 1, max_recommendations)
    names = F.transform(ranked, lambda e: e["action"])
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("observe_only")))


def recommend(evidence: DataFrame, max_recommendations: int = 3) -> DataFrame:
    """run_id + (priority, action): one row per recommendation, computed inside the row."""
    r = evidence.select("run_id", F.posexplode(recommendations(max_recommendations)).alias("i", "action"))
    return r.select("run_id", (F.col("i") + 1).alias("priority"), "action")


TRUE_WORDS = ("true", "1", "yes", "y")


def validate_parameters(requests: DataFrame, keys: list[str]) -> DataFrame:
    """keys + action, parameters (checked, with defaults), errors; ``requests``: keys, action, params MAP<STRING,STRING>.

    The catalogue is a handful of literals, so all checks are expressions on the row.
    """
    p = F.col("params")
    errors, values = [F.when(~F.col("action").isin(*NAMES), F.lit("unknown action"))], []
    for name, _, _, specs in ACTIONS:
        mine = F.col("action") == name
        known = F.array(*[F.lit(s[0]) for s in specs]) if specs else F.array().cast("array<string>")
        extra = F.array_sort(F.array_except(F.map_keys(p), known))
        errors.append(F.when(mine & (F.size(extra) > 0), F.concat(F.lit("unknown parameter: "), F.concat_ws(",", extra))))
        for param, kind, default, lo, hi in specs:
            given = F.coalesce(F.try_element_at(p, F.lit(param)), F.lit(default))
            number = given.try_cast("double")
            if kind == "int":
                number = F.when(number == F.floor(number), number)
            typed = F.lower(given).isin(*TRUE_WORDS).cast("double") if kind == "bool" else number
            errors.append(F.when(mine & given.isNotNull() & typed.isNull(), F.lit(f"{param} must be {kind}")))
            if lo is not None:
                errors.append(F.when(mine & (typed < lo), F.lit(f"{param} below {lo:g}")))
            if hi is not None:
                errors.append(F.when(mine & (typed > hi), F.lit(f"{param} above {hi:g}")))
            values.append(F.when(mine & typed.isNotNull(), F.struct(F.lit(param).alias("k"), typed.alias("v"))))
    found = F.array_compact(F.array(*errors))
    ok = F.size(found) == 0
    return requests.select(
        *keys, "action",
        F.when(ok, F.map_from_entries(F.array_compact(F.array(*values)))).alias("parameters"),
        found.alias("errors"),
    )


ADVICE = "array<struct<action_name:string, parameters:map<string,string>, priority:string, rationale:string>>"


def vet_advice(responses: DataFrame, max_recommendations: int = 3) -> tuple[DataFrame, DataFrame]:
    """External recommendation lists checked against the catalogue: (accepted rows, warnings).

    ``responses``: run_id, response_json with a ``recommendations`` list. The first
    ``max_recommendations`` valid items are kept, in the order given.
    """
    items_ = F.from_json(F.get_json_object("response_json", "$.recommendations"), ADVICE)
    parsed = responses.select("run_id", items_.alias("recs"))
    none = parsed.where("recs is null").select(
        "run_id", F.lit(-1).alias("item"), F.array(F.lit("no recommendations list")).alias("errors")
    )
    each = parsed.select("run_id", F.posexplode("recs").alias("item", "r")).select(
        "run_id", "item", F.coalesce("r.action_name", F.lit("")).alias("action"),
        F.coalesce("r.parameters", F.create_map().cast("map<string,string>")).alias("params"),
        F.greatest(F.lit(1), F.coalesce(F.col("r.priority").try_cast("int"), F.col("item") + 1)).alias("priority"),
    )
    checked = validate_parameters(each, ["run_id", "item", "priority"])
    warnings = none.unionByName(checked.where(F.size("errors") > 0).select("run_id", "item", "errors"))
    return _first_valid(checked.where(F.size("errors") == 0), max_recommendations), warnings


def _first_valid(valid: DataFrame, k: int) -> DataFrame:
    # One run has one response with a short list.
    order = W.partitionBy("run_id").orderBy("item")
    return valid.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select(
        "run_id", "item", "action", "priority", "parameters"
    )
