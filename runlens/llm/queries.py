"""One registered query for each operator, with production parameters, over its whole table; and the pipeline's entry.

A vocabulary's path is a parameter of its operator; these queries take the installed public files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import (
    bpe_codec, byte_index_dedup, conversation_repair, elias_fano, harmonic_packing, hmm_lm, minhash_dedup, periodic_runs, quality_classifier, quality_rules, range_sharding, secret_scan, simhash,
)
from runlens.llm.common import crc_mod, documents, stored
from runlens.session import new_table_path

QUALITY_LIMIT = 0.7


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def learns(doc_id):
    """Labels of these rows may be learnt from."""
    return crc_mod(doc_id, 4) != 2


def scanner() -> secret_scan.Scanner:
    return secret_scan.Scanner(words=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def packing() -> harmonic_packing.Packing:
    return harmonic_packing.Packing(tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


def op1_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir), scanner()))


def op3_range_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_sharding.shard(documents(spark, sf_dir))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_packing.pack(documents(spark, sf_dir), packing())


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe_codec.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe_codec.round_trip(documents(spark, sf_dir), vocabulary)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_within: rows within the search radius of a query row's fingerprint (itself included); within: the fingerprints of their classes,
    whose members are the rows with that ``fingerprint``. Both are null for other rows."""
    search = simhash.Search(radius=simhash.NEAR_COPIES)
    rows = stored(simhash.compare_successors(documents(spark, sf_dir)))
    asked = (F.col("doc_id") % search.every == 0) & F.col("doc_id").isNotNull()
    near = simhash.within_radius(rows.select("fingerprint"), rows.where(asked).select("fingerprint"), search)
    found = rows.where(asked).join(near, "fingerprint", "left").select(*rows.columns, "n_within", "within")
    others = rows.where(~asked).withColumns({"n_within": F.lit(None).cast("long"), "within": F.lit(None).cast("array<string>")})
    return found.unionByName(others)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, sf_dir), minhash_dedup.NearDup(words=4))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, labels(spark, sf_dir)))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    vectors, net = quality_classifier.fit(docs, labels(spark, sf_dir), learns)
    scored = quality_classifier.score(docs, vectors, net)
    return scored.select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= QUALITY_LIMIT).cast("int").alias("predicted"),
    )


def op10_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark)
    elias_fano.write_ids(documents(spark, sf_dir), path, elias_fano.Format(public_tokenizers.path("word_bpe_49k.json")))
    return elias_fano.read_documents(spark, path)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.plant_repeats(documents(spark, sf_dir))))


def op13_byte_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_index_dedup.near_duplicates(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hidden_markov_lm, op2_secret_scan, op3_range_sharding, op4_harmonic_packing, op5_byte_bpe, op6_simhash, op7_minhash_dedup,
        op8_quality_rules, op9_quality_classifier, op10_elias_fano, op11_conversation_repair, op12_periodic_runs, op13_byte_index_dedup,
    )
}
