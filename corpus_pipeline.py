"""A training-data pipeline over `documents`: one operator a stage, each stored and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staycohort.llm import mixing, quality_rules, recompression, simhash, trie_bpe
from staycohort.llm.common import materialised
from staycohort.llm.queries import (
    MIXING_EXPONENT,
    MIXING_SEED,
    QUALITY_DOUBT,
    QUALITY_RISK,
    SIMHASH_LIMIT,
    SIMHASH_WIDTH,
    tokenizer_file,
)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, labels, QUALITY_RISK, QUALITY_DOUBT)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs, SIMHASH_WIDTH, SIMHASH_LIMIT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere go from every text that holds them; n_chars follows."""
    cut = recompression.remove_repeats(docs)
    shorter = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", shorter).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by source, in a new order."""
    weights = mixing.smoothed_weights(docs, MIXING_EXPONENT)
    return mixing.poisson_mixture(docs, weights, MIXING_SEED).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the ids of each text; decoded again in `decoded`."""
    coded = trie_bpe.encode_and_decode(docs, tokenizer_file("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", keep_good),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("substring dedup", cut_repeats),
    ("source mixing", mix_sources),
    ("BPE encoding", encode),
]

#: No SQL: fingerprints, learned thresholds and encodings are beyond it. Tests hold the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each result is stored where all executors read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir))
    return docs
