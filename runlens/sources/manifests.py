"""Corpus manifests: JSON documents to one row per run, with splits and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = (
    "name string, corpus string, corpus_id string, runs array<string>, "
    "entries array<struct<entry_id:string, run_ids:array<string>, primary_label:string, severity:string, "
    "fault_plan:array<string>>>, splits map<string, array<string>>"
)


def read_documents(spark: SparkSession, paths: str, filename: str = "corpus.manifest.json") -> DataFrame:
    """(corpus_path, content) of every manifest file below ``paths``."""
    raw = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", filename)
        .text(paths, wholetext=True)
    )
    return raw.select(parent_of(F.col("_metadata.file_path")).alias("corpus_path"), F.col("value").alias("content"))


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def run_path(item: Column, corpus_path: Column) -> Column:
    """Directory of a run entry: text or {path | dir | run_dir | run_id}; relative ones are below the corpus."""
    is_object = F.startswith(F.ltrim(item), F.lit("{"))
    located = F.coalesce(*[F.get_json_object(item, f"$.{k}") for k in ("path", "dir", "run_dir")])
    ident = F.get_json_object(item, "$.run_id")

    def below(p: Column) -> Column:
        return F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat_ws("/", corpus_path, p))

    chosen = F.when(located.isNotNull(), below(located)).when(ident.isNotNull(), F.concat_ws("/", corpus_path, ident))
    return F.when(is_object, chosen).otherwise(below(item))


def _parsed(docs: DataFrame) -> DataFrame:
    is_object = F.startswith(F.ltrim(F.col("content")), F.lit("{"))
    d = docs.withColumn("d", F.from_json("content", DOCUMENT)).withColumn(
        "valid", is_object & F.try_parse_json("content").isNotNull()
    )
    has_runs = F.get_json_object("content", "$.runs").isNotNull()
    has_entries = F.get_json_object("content", "$.entries").isNotNull()
    n_entry_runs = F.aggregate(
        F.col("d.entries"), F.lit(0), lambda acc, e: acc + F.greatest(F.lit(0), F.coalesce(F.size(e["run_ids"]), F.lit(0)))
    )
    unsupported = F.exists(F.col("d.runs"), lambda x: run_path(x, F.lit("")).isNull())
    error = (
        F.when(~F.col("valid"), "manifest is not a JSON object")
        .when(has_runs & ~(F.coalesce(F.size("d.runs"), F.lit(0)) > 0), "runs must be a non-empty list")
        .when(has_runs & unsupported, "unsupported run entry")
        .when(~has_runs & has_entries & ~(F.coalesce(F.size("d.entries"), F.lit(0)) > 0), "entries must be a non-empty list")
        .when(~has_runs & has_entries & (n_entry_runs == 0), "entries produced no runs")
        .when(~has_runs & ~has_entries, "manifest has neither runs nor entries")
    )
    name = F.coalesce(
        *[F.nullif(F.col(f"d.{k}"), F.lit("")) for k in ("name", "corpus", "corpus_id")], name_of(F.col("corpus_path"))
    )
    return d.withColumn("error", error).withColumn("corpus", name).withColumn("use_runs", has_runs)


def manifest_errors(docs: DataFrame) -> DataFrame:
    return _parsed(docs).where("error is not null").select("corpus_path", "error")


def parse_manifests(docs: DataFrame, strict: bool = False) -> DataFrame:
    """One row per run: corpus, run_dir, run_key, entry_id, primary_label, severity, n_faults, is_multi_label.

    Broken documents are left out (see ``manifest_errors``); ``strict`` makes them fail the query.
    """
    p = _parsed(docs)
    if strict:
        p = p.where(
            F.when(F.col("error").isNull(), True).otherwise(
                F.raise_error(F.concat_ws(": ", "corpus_path", "error")).cast("boolean")
            )
        )
    p = p.where("error is null")
    none = F.lit(None).cast("string")
    from_runs = p.where("use_runs").select("corpus", "corpus_path", F.explode("d.runs").alias("item")).select(
        "corpus",
        run_path(F.col("item"), F.col("corpus_path")).alias("run_dir"),
        none.alias("entry_id"),
        none.alias("primary_label"),
        none.alias("severity"),
        F.lit(None).cast("int").alias("n_faults"),
    )
    from_entries = (
        p.where("not use_runs")
        .select("corpus", "corpus_path", F.explode("d.entries").alias("e"))
        .select("corpus", "corpus_path", "e", F.explode("e.run_ids").alias("rid"))
        .select(
            "corpus",
            F.concat_ws("/", "corpus_path", "rid").alias("run_dir"),
            F.coalesce(F.col("e.entry_id"), F.lit("")).alias("entry_id"),
            F.col("e.primary_label").alias("primary_label"),
            F.col("e.severity").alias("severity"),
            F.greatest(F.lit(0), F.coalesce(F.size("e.fault_plan"), F.lit(0))).alias("n_faults"),
        )
    )
    out = from_runs.unionByName(from_entries)
    return out.select(
        "corpus",
        "run_dir",
        name_of(F.col("run_dir")).alias("run_key"),
        "entry_id",
        "primary_label",
        "severity",
        "n_faults",
        (F.col("n_faults") > 1).alias("is_multi_label"),
    )


def parse_splits(docs: DataFrame) -> DataFrame:
    """(corpus, split, run_id) rows of every manifest that defines splits."""
    p = _parsed(docs).where("error is null")
    s = p.select("corpus", F.explode("d.splits").alias("split", "ids"))
    return s.select("corpus", "split", F.explode("ids").alias("run_id"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all meta.json and history.csv files below ``root`` (contents are not read)."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "{meta.json,history.csv}").load(root)
    )
    return files.select("path", "length")


def runs_from_directory(files: DataFrame) -> DataFrame:
    """A corpus without a manifest: directories that hold both a meta.json and a history.csv."""
    by_dir = files.groupBy(parent_of(F.col("path")).alias("run_dir")).agg(
        F.max(name_of(F.col("path")) == "meta.json").alias("has_meta"),
        F.max(name_of(F.col("path")) == "history.csv").alias("has_history"),
    )
    parent = name_of(parent_of(F.col("run_dir")))
    return by_dir.where("has_meta and has_history").select(
        F.concat_ws("_", parent, name_of(F.col("run_dir")), F.lit("singlerun")).alias("corpus"),
        "run_dir",
        name_of(F.col("run_dir")).alias("run_key"),
    )
