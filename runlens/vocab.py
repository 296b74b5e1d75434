"""Label taxonomy and other fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: class names, in tie-break order -------------------------------------------
HEALTHY = "healthy"
OVERFITTING = "overfitting"
UNDERFITTING = "underfitting"
LEAKAGE = "leakage"
LABEL_NOISE = "label_noise"
INSTABILITY = "instability"
CLASSES = (HEALTHY, OVERFITTING, UNDERFITTING, LEAKAGE, LABEL_NOISE, INSTABILITY)

FAULTY = "faulty"
DATA = "data_related"
OPTGEN = "optimization_or_generalization_related"
STAGE1 = (HEALTHY, FAULTY)
STAGE2 = (DATA, OPTGEN)
LEAVES = {DATA: (LEAKAGE, LABEL_NOISE), OPTGEN: (OVERFITTING, UNDERFITTING, INSTABILITY)}
STAGE3_DATA = LEAVES[DATA]
STAGE3_OPT = LEAVES[OPTGEN]

STAGE_COLUMNS = (
    "stage1_p_healthy",
    "stage1_p_faulty",
    "stage2_p_data",
    "stage2_p_optgen",
    "stage3_p_leakage",
    "stage3_p_label_noise",
    "stage3_p_overfitting",
    "stage3_p_underfitting",
    "stage3_p_instability",
)
# --- end of fixed values ------------------------------------------------------------------------

FAULTY_CLASSES = tuple(c for c in CLASSES if c != HEALTHY)
BRANCH_OF = {leaf: branch for branch, leaves in LEAVES.items() for leaf in leaves}


def taxonomy(spark: SparkSession) -> DataFrame:
    """Six-row dimension (primary, ord, stage1, stage2, stage3)."""
    rows = [
        (c, i, HEALTHY if c == HEALTHY else FAULTY, BRANCH_OF.get(c), None if c == HEALTHY else c)
        for i, c in enumerate(CLASSES)
    ]
    return spark.createDataFrame(
        rows, "primary string, ord int, stage1 string, stage2 string, stage3 string"
    )


def labels_array(labels=CLASSES) -> Column:
    return F.array(*[F.lit(c) for c in labels])


def class_ord(label: Column) -> Column:
    """0-based position in the class order, null for an unknown label."""
    pos = F.array_position(labels_array(), label)
    return F.when(pos > 0, pos - 1).cast("int")


def _mapped(label: Column, mapping: dict[str, str | None], strict: bool) -> Column:
    out = F.lit(None).cast("string")
    for key, value in mapping.items():
        out = F.when(label == key, F.lit(value).cast("string")).otherwise(out)
    if not strict:
        return out
    bad = label.isNotNull() & ~label.isin(*CLASSES)
    failure = F.raise_error(F.concat(F.lit("unknown primary label: "), label)).cast("string")
    return F.when(bad, failure).otherwise(out)


def to_stage1(label: Column, strict: bool = True) -> Column:
    return _mapped(label, {c: HEALTHY if c == HEALTHY else FAULTY for c in CLASSES}, strict)


def to_stage2(label: Column, strict: bool = True) -> Column:
    return _mapped(label, {c: BRANCH_OF.get(c) for c in CLASSES}, strict)


def to_stage3(label: Column, strict: bool = True) -> Column:
    return _mapped(label, {c: None if c == HEALTHY else c for c in CLASSES}, strict)


def taxonomy_problems(dim: DataFrame) -> DataFrame:
    """Rows that break the taxonomy's own rules (empty when it is sound)."""
    faulty = F.col("primary") != HEALTHY
    problem = (
        F.when(~faulty & (F.col("stage1") != HEALTHY), "healthy must map to stage-1 healthy")
        .when(faulty & (F.col("stage1") != FAULTY), "faulty class must map to stage-1 faulty")
        .when(~faulty & (F.col("stage2").isNotNull() | F.col("stage3").isNotNull()), "healthy has no stage 2/3")
        .when(faulty & ~F.coalesce(F.col("stage2").isin(*STAGE2), F.lit(False)), "stage 2 outside vocabulary")
        .when(faulty & ~F.col("stage3").eqNullSafe(F.col("primary")), "leaf must equal its class")
    )
    duplicates = (
        dim.groupBy("primary").count().where("count > 1")
        .select("primary", F.lit("class listed twice").alias("problem"))
    )
    missing = (
        dim.sparkSession.createDataFrame([(c,) for c in CLASSES], "primary string")
        .join(dim, "primary", "left_anti")
        .select("primary", F.lit("class missing").alias("problem"))
    )
    return (
        dim.select("primary", problem.alias("problem")).where("problem is not null")
        .unionByName(duplicates)
        .unionByName(missing)
    )
