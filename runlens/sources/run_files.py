"""Run folders: metadata documents, per-epoch CSV files with their own headers, the run table.

CSV files are read as *lines*, so one long file is split over tasks like any text file. The place of a line in
its file comes from the file block it was read in and its order inside the block; each
file's own first line decides which column means what.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.sources.manifests import name_of, parent_of

# --- fixed values: accepted column names per curve, in order of preference ----------------------
CURVE_COLUMNS = {
    "train_loss": ("train_loss", "loss"),
    "val_loss": ("val_loss", "valid_loss", "test_loss"),
    "train_acc": ("train_acc", "acc", "train_accuracy"),
    "val_acc": ("val_acc", "valid_acc", "val_accuracy", "test_acc"),
}
EXTRA_COLUMNS = ("epoch", "grad_norm", "weight_norm", "lr", "step_time_sec", "loss_spike_flag")
LABEL_KEYS = ("labels", "diagnosis", "label", "fault_labels")
STATUSES = ("running", "completed", "failed", "crashed", "interrupted")
# --- end of fixed values ------------------------------------------------------------------------


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    """(run_dir, content) of every meta.json below ``root``."""
    raw = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "meta.json")
        .text(root, wholetext=True)
    )
    return raw.select(parent_of(F.col("_metadata.file_path")).alias("run_dir"), F.col("value").alias("content"))


def parse_meta(docs: DataFrame) -> DataFrame:
    """run_dir, meta_json, error: the document is kept as text; a non-object is an error."""
    ok = F.startswith(F.ltrim(F.col("content")), F.lit("{")) & F.try_parse_json("content").isNotNull()
    return docs.select(
        "run_dir",
        F.when(ok, F.col("content")).alias("meta_json"),
        F.when(~F.coalesce(ok, F.lit(False)), F.lit("meta is not a JSON object")).alias("error"),
    )


def read_history_lines(spark: SparkSession, root: str) -> DataFrame:
    """(run_dir, block, ord, line) of every history.csv below ``root``; files stay splittable."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "history.csv").text(root)
    return raw.select(
        parent_of(F.col("_metadata.file_path")).alias("run_dir"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("ord"),
        F.col("value").alias("line"),
    )


def _cell(cells: Column, header: Column, names: tuple[str, ...]) -> Column:
    """Value under the first of ``names`` that the header has: NaN for blanks and junk, null without a column."""
    index = F.coalesce(*[F.nullif(F.array_position(header, n), F.lit(0)) for n in names])
    text = F.trim(F.get(cells, (index - 1).cast("int")))
    return F.when(index.isNotNull(), F.coalesce(text.try_cast("double"), F.lit(float("nan"))))


def split_cells(line: Column) -> Column:
    """Cells of a CSV line; a quoted cell may hold commas and doubled quotes."""
    # With a comma in front every cell begins with one, so that no match is empty.
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',[ \t]*("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    quoted = lambda c: F.replace(F.regexp_replace(c, r'^"|"[ \t]*$', ""), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda c: F.trim(F.when(F.startswith(c, F.lit('"')), quoted(c)).otherwise(c)))


def parse_history(lines: DataFrame) -> DataFrame:
    """run_dir, pos, epoch, curves and optional columns; the choice of columns is made per file."""
    rows = lines.where(F.trim("line") != "")
    per_block = rows.groupBy("run_dir", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("line", "ord").alias("first_line")
    )
    per_file = W.partitionBy("run_dir").orderBy("block")
    blocks = per_block.select(
        "run_dir",
        "block",
        F.coalesce(F.sum("n").over(per_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        split_cells(F.first("first_line").over(per_file)).alias("header"),
    )
    inside = W.partitionBy("run_dir", "block").orderBy("ord")
    placed = rows.join(blocks, ["run_dir", "block"]).withColumn(
        "index", F.row_number().over(inside) - 1 + F.col("offset")
    )
    cells, header = split_cells(F.col("line")), F.col("header")
    body = placed.where("index > 0")
    return body.select(
        "run_dir",
        (F.col("index") - 1).alias("pos"),
        _cell(cells, header, ("epoch",)).alias("epoch"),
        *[_cell(cells, header, names).alias(c) for c, names in CURVE_COLUMNS.items()],
        *[_cell(cells, header, (c,)).alias(c) for c in EXTRA_COLUMNS if c != "epoch"],
    )


def _label_block(v: Column) -> tuple[Column, Column]:
    """Labels under the first key that gives any, and whether a label value has an unsupported type.

    ``v`` is the parsed document (VARIANT).
    """
    picked: list[Column] = []
    bad = F.lit(False)
    for key in LABEL_KEYS:
        item = F.try_variant_get(v, f"$.{key}", "variant")
        kind = F.schema_of_variant(item)
        is_list, is_text = kind.startswith("ARRAY"), kind == "STRING"
        many = F.filter(F.try_variant_get(v, f"$.{key}", "array<string>"), lambda x: x.isNotNull())
        values = F.when(is_list, many).when(is_text, F.array(F.try_variant_get(v, f"$.{key}", "string")))
        unsupported = F.coalesce(item.isNotNull() & ~(is_list | is_text | (kind == "VOID")), F.lit(False))
        earlier = F.coalesce(*picked, F.lit(None)).isNull() if picked else F.lit(True)
        bad = bad | (unsupported & earlier)
        picked.append(F.when(F.size(values) > 0, values))
    return F.coalesce(*picked, F.array().cast("array<string>")), bad


def _text_at(v: Column, path: str) -> Column:
    """A JSON string at ``path`` of a parsed document; other types give null."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def dataset_of(v: Column, config: Column) -> Column:
    """dataset, dataset_name, config[task].dataset, or the first config.*.dataset.

    ``config`` maps the sections of the document to their JSON text, in document order.
    """
    def inside(section: Column) -> Column:
        return _text_at(F.try_parse_json(section), "$.dataset")

    by_task = inside(F.try_element_at(config, F.try_variant_get(v, "$.task", "string")))
    anywhere = F.get(F.filter(F.transform(F.map_values(config), inside), lambda d: d.isNotNull()), 0)
    return F.coalesce(_text_at(v, "$.dataset"), _text_at(v, "$.dataset_name"), by_task, anywhere)


def promote_meta(meta: DataFrame) -> DataFrame:
    """Run columns found in the metadata alone: run_dir, run_id, labels, dataset, severity, is_multi_label, entry_id.

    Each document is parsed once into a VARIANT; all fields are read from that. A broken document keeps its row and its error.
    """
    sections = F.from_json(F.get_json_object("meta_json", "$.config"), "map<string, string>")
    m = meta.withColumns({"_v": F.try_parse_json("meta_json"), "_config": sections})
    v = F.col("_v")

    def text(key: str) -> Column:
        return F.nullif(F.try_variant_get(v, f"$.{key}", "string"), F.lit(""))

    labels, bad = _label_block(v)
    m = m.withColumns({"_labels": labels, "_bad": bad})
    declared = F.coalesce(F.lower(text("multi_label")), F.lit("false"))
    truthy = ~declared.isin("false", "null", "0", "0.0", "[]", "{}")
    return m.select(
        "run_dir",
        "meta_json",
        F.coalesce(text("run_id"), name_of(F.col("run_dir"))).alias("run_id"),
        F.col("_labels").alias("labels"),
        dataset_of(v, F.col("_config")).alias("dataset"),
        F.lower(F.trim(F.coalesce(text("severity"), text("fault_severity")))).alias("severity"),
        (truthy | (F.size("_labels") > 1)).alias("is_multi_label"),
        text("entry_id").alias("entry_id"),
        F.coalesce(*[F.col(c) for c in meta.columns if c == "error"], F.when(F.col("_bad"), F.lit("unsupported label value"))).alias("error"),
    )


def last_by_key(dim: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the last one listed wins (what assigning into a dictionary does)."""
    rest = [c for c in dim.columns if c not in keys]
    return dim.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest])


def load_runs(promoted: DataFrame, manifest: DataFrame, history_sizes: DataFrame) -> DataFrame:
    """The run table; manifest values win over metadata.

    promoted: ``promote_meta``; manifest: run_key, entry_id, primary_label, severity, is_multi_label (one row per key);
    history_sizes: run_dir, n_history_rows. A run with a broken or missing document, without history rows or with bad labels
    carries ``error``; a run that only the manifest has goes by its key.
    """
    m = manifest.select(
        F.col("run_key"),
        F.col("entry_id").alias("m_entry"),
        F.col("primary_label").alias("m_label"),
        F.lower(F.trim("severity")).alias("m_severity"),
        F.col("is_multi_label").alias("m_multi"),
    )
    j = (
        promoted.withColumn("run_key", name_of(F.col("run_dir")))
        .join(m, "run_key", "full")
        .withColumn("lacks_meta", F.col("run_dir").isNull())
        .withColumn("run_dir", F.coalesce("run_dir", "run_key"))
        .join(history_sizes, "run_dir", "left")
    )
    labels = F.when(F.col("m_label").isNotNull(), F.array("m_label")).otherwise(F.col("labels"))
    no_history = F.coalesce(F.col("n_history_rows"), F.lit(0)) == 0
    return j.select(
        F.coalesce("run_id", "run_key").alias("run_id"),
        "run_dir",
        "dataset",
        F.get(labels, 0).alias("primary_label"),
        labels.alias("labels"),
        F.size(labels).alias("n_labels"),
        F.coalesce("m_multi", "is_multi_label").alias("is_multi_label"),
        F.coalesce("m_severity", "severity").alias("severity"),
        F.coalesce(F.col("n_history_rows"), F.lit(0)).cast("long").alias("n_history_rows"),
        F.coalesce("entry_id", "m_entry").alias("entry_id"),
        F.coalesce(
            F.when(F.col("lacks_meta"), F.lit("meta.json is missing")),
            F.when(F.col("meta_json").isNull(), F.col("error")),
            F.when(no_history, F.lit("history is empty or missing")),
            F.col("error"),
        ).alias("error"),
    )


def split_broken(runs: DataFrame, skip_broken: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good runs, quarantined runs). Without ``skip_broken`` a broken run fails the query."""
    if not skip_broken:
        check = F.when(F.col("error").isNull(), True).otherwise(
            F.raise_error(F.concat_ws(": ", "run_dir", "error")).cast("boolean")
        )
        return runs.where(check).drop("error"), runs.where(F.lit(False))
    return runs.where("error is null").drop("error"), runs.where("error is not null").select("run_dir", "error")
