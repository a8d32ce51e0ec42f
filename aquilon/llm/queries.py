"""The registered queries of this subpackage: thin, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, language_id, ngram_join, packing, quality, substring_dedup, suffix_dedup, token_counts, url_filter


def _tokenizer(name: str) -> str:
    import public_tokenizers  # here, so that the other queries work without it

    return public_tokenizers.path(name)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_t(spark, sf_dir, "embeddings"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_t(spark, sf_dir, "pages"), spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(_t(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_t(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_t(spark, sf_dir, "documents"), whole_lines=True)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_t(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_t(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_t(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_url_filter, op3_token_counts, op4_suffix_dedup, op5_substring_dedup, op6_language_id, op7_decontaminate, op8_packing, op9_quality, op10_ngram_join)}

ORACLES = {"op1_embedding_dedup": embedding_dedup.ORACLE, "op2_url_filter": url_filter.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op10_ngram_join": ngram_join.ORACLE}
