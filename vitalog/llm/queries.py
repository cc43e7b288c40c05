"""The numbered operators with production parameters, over whole tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from . import decontamination, exact_dedup, factorization, language_id, mixing, ngram_lm, prefix_trie, sharding, simhash, spelling, suffix_dedup, toxicity, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), width=3, tau=2)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_documents(spark, sf_dir), parts=10, fold=0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages_of(_documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir), length=100)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rate=0.1)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(_documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(configure(spark).read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0)
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.quality(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op11_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), shards=16)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_documents(spark, sf_dir), least_length=5, least_count=3, ratio=2, drop_every=97)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(configure(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_language_model": op2_language_model,
    "op3_language_id": op3_language_id,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_decontaminate": op6_decontaminate,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_shard": op11_shard,
    "op12_spelling": op12_spelling,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_warc": warc.ORACLE,
    "op11_shard": sharding.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
