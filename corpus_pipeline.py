"""The pipeline over documents: quality rules, line dedup, near-duplicate join, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet and
reads it again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.llm import bloom, line_dedup, near_dup, packing, quality
from textlake.llm.common import documents, free, labels, ready, stored
from textlake.llm.queries import word_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest, which is fitted on this stage's labelled input.

    Null and empty texts fail the base rules and go. Rows that repeat get one verdict, a score that equals the
    threshold stays, null ids and further columns stay, an empty table gives none. Texts of any length are read whole.
    """
    ready(spark)
    sampled = stored(quality.labelled(labels(spark, sf_dir)), "labelled")
    measured = quality.measure(docs.join(F.broadcast(sampled), "doc_id", "left_semi"))
    return quality.keep(docs, quality.fit(measured, sampled))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that equal an earlier one or are one word apart from it.

    A document of which nothing is left goes; null and empty texts stay. n_chars follows the text. Earlier is the
    smaller id, then the earlier line; rows that repeat with one id and text keep or lose lines together, and a null
    id comes first. Further columns stay, whatever their names; an empty table gives none.
    """
    ready(spark)
    kept = line_dedup.drop_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("bigint"))


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, of several texts under that id the one
    with the smallest hash.

    Texts without words are similar to nothing and stay. Rows that repeat with the id and text that stays stay
    together. A null id comes last. Further columns stay, whatever their names; an empty table gives none.
    """
    ready(spark)
    by_id, by_text = free("_id", docs), free("_of", docs)
    removed = near_dup.join(docs).where("NOT kept").select(F.col("doc_id").alias(by_id), F.col("text_hash").alias(by_text))
    removed = stored(removed.distinct(), "removed")
    of = F.xxhash64(F.coalesce("text", F.lit("")))
    # Documents that are not removed are not shuffled.
    maybe, others = bloom.split(docs, removed, [F.col("doc_id"), of])
    gone = F.col("doc_id").eqNullSafe(F.col(by_id)) & (of == F.col(by_text))
    return maybe.join(removed, gone, "left_anti").unionByName(others)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences.

    A null or empty text has the end id only. Rows that repeat are packed each for itself; pieces of equal length are
    placed in any order. Null ids stay; further columns are not carried along; an empty table gives none.
    """
    ready(spark)
    return packing.pack_documents(docs, word_tokenizer(), payload="crc32")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", unique_lines),
    ("ngram_jaccard_join", unique_documents),
    ("packing", packed),
]

# The forest, the signatures and the linear program have no SQL form; tests/llm checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
