"""A corpus from raw documents to packed sequences: rules, classifier, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before it kept, written and read back. All but the last
return the columns of ``documents``; rows with nulls and repeated rows are rows like any other (of repeated rows the near-duplicate stage
keeps one), extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import harmonic_packing, minhash_dedup, quality_classifier, quality_rules, queries, secret_scan
from runlens.llm.common import documents
from runlens.session import cut_lineage

ROW = "_near_duplicates_row"


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose n-grams look like those of trusted documents."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, queries.labels(spark, sf_dir)))


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good. It learns from the whole table, since the rules leave little bad to learn from."""
    vectors, net = quality_classifier.fit(documents(spark, sf_dir), queries.labels(spark, sf_dir), queries.learns)
    return quality_classifier.keep_good(docs, vectors, net, queries.QUALITY_LIMIT)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the smallest id, then the first such row.

    Verdicts are for rows, not ids, so a row with another text stays whatever becomes of the rows that share its id. Of a group
    without any id one row stays too. Rows without words are alone.
    """
    # Written once with a key of its own for each row, which must not change between the search and the join.
    numbered = cut_lineage(docs.withColumn(ROW, F.monotonically_increasing_id()))
    found = minhash_dedup.near_duplicates(numbered, minhash_dedup.NearDup(words=5), key=ROW)
    return numbered.join(found.where("not kept").select(ROW), ROW, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secret values replaced and n_chars counted anew."""
    clean = secret_scan.redact(docs, queries.scanner())
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return harmonic_packing.pack(docs, queries.packing())


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("minhash_dedup", keep_one_of_each_group),
    ("secret_scan", redact_secrets),
    ("harmonic_packing", pack_sequences),
]

#: Hashes of n-grams, a trained network and token ids can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
