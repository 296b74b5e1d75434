"""Manifests of any size, cut into their runs and entries by a structural index instead of one parse of the whole document.

The file is read as pieces between commas, so Spark may split it anywhere. Three numbers of a piece tell what it does to the
text behind it: whether its number of quotes is odd, and by how much it changes the bracket depth if it begins outside or inside a string.
Within a split they are summed along the pieces, for both cases; a summary per split, a few numbers for each 128 MB, says which case
holds and how deep each split begins. From then on every piece knows its own depth: pieces that begin at depth 1 start a section of
the document, pieces at depth 2 an element of the section's array, and the pieces of an element are put together again. No task
holds more than one split or one element.

Only arrays of the document (``runs``, ``entries``) and its short texts are of use here; ``manifests`` has the rules for what they mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.session import cut_lineage
from runlens.sources.manifests import name_of, parent_of, run_path

SEPARATOR = ","
TEXTS = ("name", "corpus", "corpus_id")
ENTRY = "entry_id string, run_ids array<string>, primary_label string, severity string, fault_plan array<string>"


def _bare(text: Column) -> Column:
    """What is left outside strings, for a text that begins outside one; an open string reaches to the end."""
    return F.regexp_replace(text, r'"[^"]*("|$)', "")


def _depth_change(bare: Column) -> Column:
    return (F.length(F.regexp_replace(bare, r"[^\[{]", "")) - F.length(F.regexp_replace(bare, r"[^\]}]", ""))).cast("long")


def pieces(spark: SparkSession, paths: str, filename: str = "corpus.manifest.json") -> DataFrame:
    """(file, split, at, piece, depth, inside): every piece with the bracket depth it begins at and whether it begins inside a string."""
    raw = (
        spark.read.option("lineSep", SEPARATOR).option("recursiveFileLookup", True).option("pathGlobFilter", filename).text(paths)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    )
    # An escaped character is no quote; a piece never ends within an escape, as a comma can't be escaped.
    plain = F.regexp_replace("piece", r"\\.", "")
    shut = F.regexp_replace(plain, r'^[^"]*("|$)', "")
    told = cut_lineage(raw.select(
        "file", "split", "at", "piece", (F.length(F.regexp_replace(plain, '[^"]', "")) % 2).cast("long").alias("odd"),
        _depth_change(_bare(plain)).alias("outside"), _depth_change(_bare(shut)).alias("within"),
    ))
    before = W.partitionBy("file", "split").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2
    marked = told.withColumn("flip", odd)
    # The change of each piece if its split begins outside (even) or inside (odd) a string.
    case = {0: F.when(F.col("flip") == 0, F.col("outside")).otherwise(F.col("within")), 1: F.when(F.col("flip") == 1, F.col("outside")).otherwise(F.col("within"))}
    marked = marked.select("file", "split", "at", "piece", "odd", "flip", case[0].alias("even_change"), case[1].alias("odd_change"))
    run = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("even_change", "odd_change")}
    summed = marked.select("*", run["even_change"].alias("even_depth"), run["odd_change"].alias("odd_depth"))
    splits = marked.groupBy("file", "split").agg(F.sum("odd").alias("odd"), F.sum("even_change").alias("even"), F.sum("odd_change").alias("odd_sum"))
    order = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    begun = splits.withColumn("starts", F.coalesce(F.sum("odd").over(order), F.lit(0)) % 2)
    begun = begun.withColumn("base", F.coalesce(F.sum(F.when(F.col("starts") == 0, F.col("even")).otherwise(F.col("odd_sum"))).over(order), F.lit(0)))
    own = F.when(F.col("starts") == 0, F.col("even_depth")).otherwise(F.col("odd_depth"))
    return summed.join(begun.select("file", "split", "starts", "base"), ["file", "split"]).select(
        "file", "split", "at", "piece", (own + F.col("base")).alias("depth"), ((F.col("flip") + F.col("starts")) % 2 == 1).alias("inside"),
        F.when(F.col("starts") == 0, F.col("even_change")).otherwise(F.col("odd_change")).alias("change"),
    )


_KEY = r'^\s*\{?\s*"((?:[^"\\]|\\.)*)"\s*:\s*'


def elements(spark: SparkSession, paths: str, filename: str = "corpus.manifest.json") -> DataFrame:
    """(corpus_path, section, pos, element): JSON texts of the elements of each array of a document, and its other sections (pos null).

    ``pos`` grows along an array. A document whose brackets or quotes do not close has a row of the section ``null``.
    """
    p = cut_lineage(pieces(spark, paths, filename))
    place = F.struct("split", "at")
    opens = ~F.col("inside") & (F.col("depth") <= 1)
    begins = ~F.col("inside") & (F.col("depth") <= 2)
    name = F.regexp_extract("piece", _KEY, 1)
    is_array = F.col("piece").rlike(_KEY + r"\[")
    # The newest section and element start, first inside a split, then over splits.
    marks = p.select(
        "*", F.when(opens, F.struct(place.alias("place"), name.alias("name"), is_array.alias("array"))).alias("section"), F.when(begins, place).alias("start"),
    )
    upto = W.partitionBy("file", "split").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    here = marks.select("*", *[F.last(c, ignorenulls=True).over(upto).alias(f"own_{c}") for c in ("section", "start")])
    ends = marks.groupBy("file", "split").agg(F.max("section").alias("section"), F.max("start").alias("start"))
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("file", "split", *[F.last(c, ignorenulls=True).over(earlier).alias(f"old_{c}") for c in ("section", "start")])
    known = here.join(carried, ["file", "split"]).select(
        "file", "piece", "depth", "change", place.alias("place"), F.coalesce("own_section", "old_section").alias("section"), F.coalesce("own_start", "old_start").alias("start"),
    )
    # Other sections are one group each; elements of arrays are groups of their own.
    group = F.when(F.col("section.array"), F.col("start")).otherwise(F.col("section.place"))
    put = known.withColumn("group", group).groupBy("file", "section", "group").agg(
        F.array_sort(F.collect_list(F.struct("place", "piece", (F.col("depth") + F.col("change")).alias("after")))).alias("parts")
    )
    after = F.element_at("parts.after", -1)
    text = F.array_join("parts.piece", SEPARATOR)
    head = F.col("group") == F.col("section.place")
    text = F.when(head & F.col("section.array"), F.regexp_replace(text, _KEY + r"\[", "")).when(head, F.regexp_replace(text, _KEY, "")).otherwise(text)
    closing = F.when(F.col("section.array") & (after == 1), F.regexp_replace(text, r"\]\s*$", "")).when(
        F.col("section.array") & (after == 0), F.regexp_replace(text, r"\]\s*\}\s*$", "")
    ).when(after == 0, F.regexp_replace(text, r"\}\s*$", "")).otherwise(text)
    # What reads the elements reads them several times: they are put together once.
    found = cut_lineage(put.select(
        parent_of(F.col("file")).alias("corpus_path"), F.col("section.name").alias("section"), F.when(F.col("section.array"), F.col("group")).alias("pos"),
        F.regexp_replace(closing, r"^\s+|\s+$", "").alias("element"),
    ).where("element <> ''"))
    whole = p.groupBy("file").agg(F.sum("change").alias("left"), F.min_by("piece", place).alias("first"), F.max_by(F.col("depth") + F.col("change"), place).alias("last"))
    broken = whole.where((F.col("left") != 0) | (F.col("last") != 0) | ~F.startswith(F.ltrim("first"), F.lit("{")))
    return found.unionByName(broken.select(
        parent_of(F.col("file")).alias("corpus_path"), F.lit(None).cast("string").alias("section"),
        F.lit(None).cast(found.schema["pos"].dataType).alias("pos"), F.lit(None).cast("string").alias("element"),
    ))


def parse_elements(found: DataFrame) -> DataFrame:
    """The rows of ``manifests.parse_manifests`` from ``elements`` of its documents (broken ones are left out)."""
    bad = found.where("section is null").select("corpus_path").distinct()
    good = found.join(bad, "corpus_path", "left_anti")
    texts = good.where(F.col("pos").isNull() & F.col("section").isin(*TEXTS)).groupBy("corpus_path").agg(
        *[F.nullif(F.get_json_object(F.concat(F.lit('{"v":'), F.max(F.when(F.col("section") == k, F.col("element"))), F.lit("}")), "$.v"), F.lit("")).alias(f"t_{k}") for k in TEXTS],
    )
    has = good.groupBy("corpus_path").agg(F.max(F.col("section") == "runs").alias("use_runs"))
    docs = has.join(texts, "corpus_path", "left").select(
        "corpus_path", "use_runs", F.coalesce(*[F.col(f"t_{k}") for k in TEXTS], name_of(F.col("corpus_path"))).alias("corpus")
    )
    each = good.where("pos is not null").join(docs, "corpus_path")
    none = F.lit(None).cast("string")
    # A run is a text or an object.
    item = F.when(F.startswith("element", F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), F.col("element"), F.lit("}")), "$.v")).otherwise(F.col("element"))
    runs = each.where("use_runs and section = 'runs'").select(
        "corpus", run_path(item, F.col("corpus_path")).alias("run_dir"), none.alias("entry_id"), none.alias("primary_label"), none.alias("severity"),
        F.lit(None).cast("int").alias("n_faults"),
    )
    e = F.from_json("element", ENTRY)
    entries = each.where("not use_runs and section = 'entries'").select("corpus", "corpus_path", e.alias("e")).select("corpus", "corpus_path", "e", F.explode("e.run_ids").alias("rid")).select(
        "corpus", F.concat_ws("/", "corpus_path", "rid").alias("run_dir"), F.coalesce(F.col("e.entry_id"), F.lit("")).alias("entry_id"), F.col("e.primary_label").alias("primary_label"),
        F.col("e.severity").alias("severity"), F.greatest(F.lit(0), F.coalesce(F.size("e.fault_plan"), F.lit(0))).alias("n_faults"),
    )
    out = runs.unionByName(entries)
    return out.select("corpus", "run_dir", name_of(F.col("run_dir")).alias("run_key"), "entry_id", "primary_label", "severity", "n_faults", (F.col("n_faults") > 1).alias("is_multi_label"))
