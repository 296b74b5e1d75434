"""Readable text per run in English or Russian, from templates."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.evidence import split_notes
from runlens.vocab import HEALTHY

# --- fixed values: message templates per language -------------------------------------------------
MESSAGES = {
    "ru": {
        "stage_predicted": "Stage `{name}` предсказал `{pred}` с confidence {conf:.3f}.",
        "stage_low_conf": "Решение на этом этапе само по себе неуверенное — соседние классы получили существенную вероятность.",
        "stage1_healthy_end": "Каскад завершается на этом шаге без атрибуции fault'а.",
        "stage1_faulty_continue": "Faulty — каскад продолжается к разделению data / optimisation/generalisation.",
        "stage2_role": "Stage 2 определяет, кроется ли ошибка в data pipeline или в регулятивно-оптимизационном режиме.",
        "stage3_role": "Stage 3 уточняет конкретный режим ошибки внутри выбранной ветки.",
        "secondary_signal_prefix": "[вторичный сигнал, не доминировал в диагнозе] ",
        "low_composed_conf": "Итоговая composed confidence низкая ({conf:.3f}); относитесь к диагнозу как к предварительному.",
        "stage1_low_conf": "Stage 1 (healthy vs faulty) сам по себе неуверенный.",
        "stage2_low_conf": "Решение Stage 2 (data vs opt/gen) слабое — обе ветки остаются правдоподобными.",
        "strongest_alt": "Сильнейший альтернативный класс: `{cls}` (p={p:.3f}).",
        "lim_demonstrative": "Рекомендации носят демонстрационный и экспериментальный характер.",
        "lim_verify_config": "Каждую рекомендацию следует сверять с исходной training-конфигурацией перед применением.",
        "rat_reduce_lr": "Замечена нестабильность оптимизации или резкие скачки лосса; снижение learning rate — каноничный первый шаг для режима `{cls}`.",
        "rat_increase_capacity": "Train loss не достиг достаточно низкого значения — это согласуется с underfitting; увеличение ёмкости модели — каноничный первый шаг.",
        "rat_add_regularization": "Виден большой разрыв между train и val; weight decay (и опционально dropout) уменьшает этот разрыв без сокращения ёмкости модели.",
        "rat_early_stop": "Validation-кривая ухудшается после своего минимума; остановка на лучшей val-эпохе — самая дешёвая мера противодействия.",
        "rat_clean_label_noise": "Свидетельства согласуются с повышенным уровнем шума в метках; уменьшение доли шумных меток в обучающей выборке — каноничный первый шаг.",
        "rat_fix_split": "Свидетельства согласуются с утечкой между train и validation; пересборка split’а с дедупликацией и новым seed устраняет корневую причину со стороны данных.",
        "rat_retrain_with_seed": "Повторное обучение с другим seed позволяет измерить, какая часть наблюдаемого поведения воспроизводима, а какая — вариативна по seed.",
        "rat_observe_only": "Корректирующие действия не указаны; рекомендуется собрать больше runs для уточнения картины.",
        "summary_healthy_with_secondary": "Run диагностирован как `healthy` (composed P = {conf:.3f}) несмотря на отдельные слабые / противоречивые fault-like сигналы (см. секцию вторичных сигналов). Корректирующие действия не требуются.",
        "summary_healthy_clean": "Run диагностирован как `healthy` (composed P = {conf:.3f}); корректирующие действия не требуются.",
        "summary_faulty": "Run диагностирован как `{cls}` (composed P = {conf:.3f}). Рекомендуются корректирующие действия, нацеленные на этот класс.",
        "expl_cascade_class": "Иерархический каскад относит этот run к классу `{cls}` (P = {conf:.3f}). ",
        "expl_stage1": "Stage 1 выделил `{pred}` с P = {conf:.3f}. ",
        "expl_stage2": "Stage 2 направил run в ветку `{pred}` (P = {conf:.3f}). ",
        "expl_stage3": "Stage 3 присвоил листовой класс `{pred}` (P = {conf:.3f}). ",
        "expl_decisive_signals": "Подтверждающие сигналы: ",
        "expl_secondary_healthy": "Вторичные / противоречивые сигналы (не доминировали в диагнозе): ",
        "expl_secondary_faulty": "Альтернативные сигналы (отвергнуты каскадом): ",
        "expl_integrity_avail": "Доступны integrity-признаки: ",
        "expl_alt_hypotheses": "Альтернативные гипотезы: ",
    },
    "en": {
        "stage_predicted": "Stage `{name}` predicted `{pred}` with confidence {conf:.3f}.",
        "stage_low_conf": "The decision at this stage is itself uncertain — neighbouring classes received substantial probability.",
        "stage1_healthy_end": "The cascade terminates at this step with no fault attribution.",
        "stage1_faulty_continue": "Faulty — the cascade continues to the data / optimisation-or-generalisation split.",
        "stage2_role": "Stage 2 decides whether the failure lies in the data pipeline or in the regularisation/optimisation regime.",
        "stage3_role": "Stage 3 refines the specific failure mode within the chosen branch.",
        "secondary_signal_prefix": "[secondary signal, did not drive the diagnosis] ",
        "low_composed_conf": "Final composed confidence is low ({conf:.3f}); treat the diagnosis as preliminary.",
        "stage1_low_conf": "Stage 1 (healthy vs faulty) is itself uncertain.",
        "stage2_low_conf": "Stage 2 (data vs opt/gen) decision is weak — both branches remain plausible.",
        "strongest_alt": "Strongest alternative class: `{cls}` (p={p:.3f}).",
        "lim_demonstrative": "Recommendations are demonstrative and experimental in nature.",
        "lim_verify_config": "Each recommendation should be verified against the original training configuration before being applied.",
        "rat_reduce_lr": "Optimisation instability or loss spikes are present; lowering the learning rate is the canonical first step for the `{cls}` regime.",
        "rat_increase_capacity": "Training loss did not reach a sufficiently low value, consistent with underfitting; increasing model capacity is the canonical first step.",
        "rat_add_regularization": "There is a large train-vs-val gap; weight decay (and optionally dropout) reduces this gap without shrinking the model.",
        "rat_early_stop": "The validation curve worsens after its minimum; stopping at the best validation epoch is the cheapest mitigation.",
        "rat_clean_label_noise": "Evidence is consistent with elevated label noise; reducing the share of noisy labels in the training set is the canonical first step.",
        "rat_fix_split": "Evidence is consistent with leakage between train and validation; rebuilding the split with deduplication and a new seed removes the data-side root cause.",
        "rat_retrain_with_seed": "Retraining with a different seed measures how much of the observed behaviour is reproducible vs seed-variant.",
        "rat_observe_only": "No corrective actions apply; collecting more runs is suggested to clarify the picture.",
        "summary_healthy_with_secondary": "The run is diagnosed as `healthy` (composed P = {conf:.3f}) despite isolated weak or contradictory fault-like signals (see the secondary signals section). No corrective actions are required.",
        "summary_healthy_clean": "The run is diagnosed as `healthy` (composed P = {conf:.3f}); no corrective actions are required.",
        "summary_faulty": "The run is diagnosed as `{cls}` (composed P = {conf:.3f}). Corrective actions targeted at this class are recommended.",
        "expl_cascade_class": "The hierarchical cascade assigns this run to class `{cls}` (P = {conf:.3f}). ",
        "expl_stage1": "Stage 1 selected `{pred}` with P = {conf:.3f}. ",
        "expl_stage2": "Stage 2 routed the run into branch `{pred}` (P = {conf:.3f}). ",
        "expl_stage3": "Stage 3 assigned leaf class `{pred}` (P = {conf:.3f}). ",
        "expl_decisive_signals": "Supporting signals: ",
        "expl_secondary_healthy": "Secondary / contradictory signals (did not drive the diagnosis): ",
        "expl_secondary_faulty": "Alternative signals (rejected by the cascade): ",
        "expl_integrity_avail": "Integrity features available: ",
        "expl_alt_hypotheses": "Alternative hypotheses: ",
    },
}
# --- end of fixed values ------------------------------------------------------------------------

DEFAULT_LANGUAGE = "ru"


def language_or_default(language: str | None) -> str:
    name = (language or "").lower().strip()
    return name if name in MESSAGES else DEFAULT_LANGUAGE


def message(language: str, key: str, **values: Column) -> Column:
    """A template with its {fields} filled by columns."""
    parts = []
    for text, field, spec, _ in Formatter().parse(MESSAGES[language_or_default(language)][key]):
        if text:
            parts.append(F.lit(text))
        if field:
            parts.append(F.format_string(f"%{spec}", values[field]) if spec else values[field])
    return F.concat(*parts)


def _joined(notes: Column) -> Column:
    return F.concat_ws(" ", notes)


def stage_texts(language: str) -> Column:
    """(stage, text) for every stage that ran."""
    out = []
    for s in ("stage1", "stage2", "stage3"):
        pred, conf = F.col(f"{s}_pred"), F.col(f"{s}_conf")
        if s == "stage1":
            role = F.when(pred == HEALTHY, message(language, "stage1_healthy_end")).otherwise(message(language, "stage1_faulty_continue"))
        else:
            role = message(language, f"{s}_role")
        text = F.concat_ws(
            " ", message(language, "stage_predicted", name=F.lit(s), pred=pred, conf=conf),
            F.when(conf < 0.6, message(language, "stage_low_conf")), role,
        )
        out.append(F.when(pred.isNotNull(), F.struct(F.lit(s).alias("stage"), text.alias("text"))))
    return F.array_compact(F.array(*out))


def confidence_notes(language: str) -> Column:
    alt = F.get("alternatives", F.lit(0))
    return F.array_compact(
        F.array(
            F.when(F.col("final_confidence") < 0.5, message(language, "low_composed_conf", conf=F.col("final_confidence"))),
            F.when(F.col("stage1_conf") < 0.6, message(language, "stage1_low_conf")),
            F.when(F.col("stage2_conf") < 0.6, message(language, "stage2_low_conf")),
            F.when(alt["p"] > 0.25, message(language, "strongest_alt", cls=alt["label"], p=alt["p"])),
        )
    )


INTEGRITY_SHOWN = 6


def narrate(evidence: DataFrame, language: str = "en") -> DataFrame:
    """run_id, summary, explanation, stage_texts, symptoms, confidence_notes, limitations.

    ``evidence`` is the output of ``evidence.build_evidence``.
    """
    cls, conf = F.col("final_class"), F.col("final_confidence")
    all_notes = F.concat("curve_notes", "integrity_notes", "diagnostic_notes")
    decisive, secondary = split_notes(F.col("_all"), cls)
    t = evidence.withColumn("_all", all_notes).withColumns({"_dec": decisive, "_sec": secondary})
    dec, sec, healthy = F.col("_dec"), F.col("_sec"), cls == HEALTHY
    summary = (
        F.when(healthy & (F.size(sec) > 0), message(language, "summary_healthy_with_secondary", conf=conf))
        .when(healthy, message(language, "summary_healthy_clean", conf=conf))
        .otherwise(message(language, "summary_faulty", cls=cls, conf=conf))
    )
    space = F.lit(" ")
    names = F.array_compact(
        F.array(*[F.when(F.col(f"integrity_evidence.{c}").isNotNull(), F.lit(c)) for c in
                  ("di_train_val_overlap", "di_label_noise_rate_declared", "di_proxy_saturation", "di_proxy_train_val_lockstep")])
    )
    available = F.concat(
        message(language, "expl_integrity_avail"), F.concat_ws(", ", F.slice(names, 1, INTEGRITY_SHOWN)),
        F.when(F.size(names) > INTEGRITY_SHOWN, ", …").otherwise(""), F.lit(". "),
    )
    alts = F.concat_ws(", ", F.transform("alternatives", lambda a: F.format_string("`%s`=%.3f", a["label"], a["p"])))
    blank = F.lit("")
    explanation = F.concat(
        message(language, "expl_cascade_class", cls=cls, conf=conf),
        message(language, "expl_stage1", pred=F.col("stage1_pred"), conf=F.col("stage1_conf")),
        *[
            F.coalesce(
                F.when(F.col(f"{s}_pred").isNotNull(), message(language, f"expl_{s}", pred=F.col(f"{s}_pred"), conf=F.col(f"{s}_conf"))),
                blank,
            )
            for s in ("stage2", "stage3")
        ],
        F.when(F.size(dec) > 0, F.concat(message(language, "expl_decisive_signals"), _joined(dec), space)).otherwise(blank),
        F.when(
            F.size(sec) > 0,
            F.concat(
                F.when(healthy, message(language, "expl_secondary_healthy")).otherwise(message(language, "expl_secondary_faulty")),
                _joined(sec), space,
            ),
        ).otherwise(blank),
        F.when(F.size(names) > 0, available).otherwise(blank),
        F.when(F.size("alternatives") > 0, F.concat(message(language, "expl_alt_hypotheses"), alts, F.lit("."))).otherwise(blank),
    )
    prefix = message(language, "secondary_signal_prefix")
    symptoms = F.concat(
        F.array_distinct(dec), F.transform(F.array_distinct(F.array_except(sec, dec)), lambda n: F.concat(prefix, n))
    )
    return t.select(
        "run_id",
        summary.alias("summary"),
        explanation.alias("explanation"),
        stage_texts(language).alias("stage_texts"),
        symptoms.alias("symptoms"),
        confidence_notes(language).alias("confidence_notes"),
        F.array(message(language, "lim_demonstrative"), message(language, "lim_verify_config")).alias("limitations"),
    )


def rationale(language: str) -> Column:
    """Reason text for column ``action`` (needs final_class)."""
    out = F.lit(None).cast("string")
    for key in [k for k in MESSAGES["en"] if k.startswith("rat_")]:
        fields = {"cls": F.col("final_class")} if "{cls}" in MESSAGES["en"][key] else {}
        out = F.when(F.col("action") == key[4:], message(language, key, **fields)).otherwise(out)
    return out
