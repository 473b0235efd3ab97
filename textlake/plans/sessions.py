"""Changes of a stored session table (``sources.versions``): only the buckets of the sessions in question are rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.log import close_sessions, mark_incomplete
from ..operators.merge import merge_sessions
from ..sources import versions


def close_stored_sessions(spark: SparkSession, path: str, updates: DataFrame) -> int:
    """Closes the sessions of (id, ended_at, summary) rows; the number of the newest version afterwards."""
    return versions.rewrite(spark, path, updates, close_sessions)


def mark_stored_incomplete(spark: SparkSession, path: str, marks: DataFrame) -> int:
    """Closes, as incomplete, the sessions of (id, ended_at) rows that are still open."""
    return versions.rewrite(spark, path, marks, mark_incomplete)


def longest_summaries(remote: DataFrame) -> DataFrame:
    """One row for each id: the earliest one, with the longest summary of all its rows."""
    size = F.coalesce(F.length("summary"), F.lit(0))
    first = W.partitionBy("id").orderBy("started_at", F.asc_nulls_last("ended_at"), F.desc(size), "project", "summary")
    # Of equally long summaries the smallest.
    best = remote.groupBy("id").agg(F.min(F.struct((-size).alias("size"), "summary")).alias("_best"))
    rows = remote.withColumn("_n", F.row_number().over(first)).where("_n = 1").join(best, "id")
    return rows.select(*[F.col("_best.summary").alias(c) if c == "summary" else F.col(c) for c in remote.columns])


def merge_stored_sessions(spark: SparkSession, path: str, remote: DataFrame) -> int:
    """Merges another machine's sessions, whose ids may repeat, into the stored ones."""
    return versions.rewrite(spark, path, longest_summaries(remote), merge_sessions)
