"""The opN queries and the pipeline, for __spark_entry__."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, fingerprints, html_text, jaccard_join, line_dedup, packing, quality_rules, substring_dedup, suffix_dedup, token_counts
from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.query(spark, sf_dir)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(spark, sf_dir)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.query(spark, sf_dir)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.query(spark, sf_dir)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.query(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_suffix_dedup, op3_token_counts, op4_line_dedup, op5_substring_dedup, op6_byte_bpe, op7_quality_rules, op8_jaccard_join, op9_packing, op10_html_text)}
ORACLE: dict[str, str] = {"op2_suffix_dedup": suffix_dedup.ORACLE_SQL, "op4_line_dedup": line_dedup.ORACLE_SQL, "op5_substring_dedup": substring_dedup.ORACLE_SQL, "op8_jaccard_join": jaccard_join.ORACLE_SQL}
