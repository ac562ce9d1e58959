"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, suffix-array dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. ``run`` writes each stage as Parquet in the
shared folder and reads it again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import jaccard_join, line_dedup, packing, quality_rules, suffix_dedup
from tracelake.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """documents rows with the texts of kept (doc_id, kept); texts without a word go."""
    kept = kept.select("doc_id", F.col("kept").alias("text")).where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    rest = docs.select("doc_id", "lang", "source").where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("lang", "source")).alias("r"))
    return kept.join(rest, "doc_id").select("doc_id", "text", "r.lang", "r.source", F.length("text").cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules keep. The rules are fitted on the labelled rows of what comes in.

    A null or blank text fails the base rules. Rows of an id stay if any row of it does
    well; rows with a null id go. Without rows, or labels, the base rules alone hold.
    """
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    kept = quality_rules.judge(docs, rules).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines, of any length but blank ones, that an earlier document or line has within one edit; documents that nothing is left of go.

    Null texts are empty. Of rows that share an id one stays, with the smallest text
    that is not blank and the smallest lang and source; rows with a null id go.
    """
    return _with_text(docs, line_dedup.line_dedup(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that 5-word shingles link at 0.8.

    A document without words is a group of its own. Rows that share an id stand for
    one document, by the smallest text that is not blank; all of its rows stay.
    """
    groups = jaccard_join.jaccard_components(docs, 80, 5)
    return docs.join(groups.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes that a string of 100 bytes found earlier covers; documents that nothing is left of go. Ids and nulls as for lines."""
    return _with_text(docs, suffix_dedup.suffix_dedup(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", substrings), ("packing", packed)]
#: Learned rules and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
