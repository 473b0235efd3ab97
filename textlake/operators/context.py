"""Recent context of every project under a token budget, all projects at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import estimate_tokens

# Parts of a project that are sorted by tasks of their own.
_PARTS = 64
SUMMARY_HEADING = "## Last Session\n"
RECENT_HEADING = "## Recent Observations\n"


def last_session_summary(sessions: DataFrame) -> DataFrame:
    """(project, summary) of the newest session, if that one has a summary."""
    newest = W.partitionBy("project").orderBy(F.desc("started_at"), F.asc("id"))
    return (
        sessions.select("project", "started_at", "id", "summary")
        .withColumn("_n", F.row_number().over(newest))
        .where("_n = 1")
        .where(F.coalesce("summary", F.lit("")) != "")
        .select("project", "summary")
    )


def _recent_lines(observations: DataFrame, budget: int, recent: int | None) -> DataFrame:
    # A line costs one token at least, so that no more than ``budget`` lines can fit. The newest of each of some
    # parts of a project come first, so that a project with a third of the log is not sorted by one task.
    most = max(0, budget) if recent is None else min(recent, max(0, budget))
    order = [F.desc("created_at"), F.asc("id")]
    newest = W.partitionBy("project").orderBy(*order)
    of_part = W.partitionBy("project", F.pmod(F.xxhash64("id"), F.lit(_PARTS))).orderBy(*order)
    line = F.concat(F.lit("- ["), F.col("type"), F.lit("] "), F.col("content"))
    return (
        observations.select("project", "created_at", "id", "type", "content")
        .withColumn("rank", F.row_number().over(of_part))
        .where(F.col("rank") <= most)
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= most)
        .select("project", F.col("rank").cast("bigint").alias("rank"), "id", line.alias("line"))
        .withColumn("cost", estimate_tokens("line"))
    )


def _within(lines: DataFrame, left: Column) -> DataFrame:
    # Costs are not negative, so the running sum stays above the budget once it
    # has passed it: the same rows as a loop that stops at the first overflow.
    upto = W.partitionBy("project").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn("used", F.sum("cost").over(upto)).where(F.col("used") <= left)


def budget_pack(observations: DataFrame, budget: int = 2000, recent: int | None = None) -> DataFrame:
    """(project, rank, id, line, cost, used): the newest lines that fit the budget, ``recent`` at most if given."""
    return _within(_recent_lines(observations, budget, recent), F.lit(budget))


def build_context(sessions, observations, budget=2000, status=None, preamble="", recent=None) -> DataFrame:
    """(project, context) for every project of either table.

    Status line (always, charged), last summary if it fits (else skipped), the
    packed observations (``recent`` at most if given); parts are joined by
    blank lines. ``preamble`` comes first and is not charged.
    """
    projects = sessions.select("project").union(observations.select("project")).distinct()
    status_cost = len(status) // 4 if status else 0
    text = F.concat(F.lit(SUMMARY_HEADING), F.col("summary"))
    summaries = (
        last_session_summary(sessions)
        .select("project", text.alias("summary_text"))
        .withColumn("summary_cost", estimate_tokens("summary_text"))
        .where(F.col("summary_cost") + status_cost <= budget)
    )
    lines = _recent_lines(observations, budget, recent).join(summaries.select("project", "summary_cost"), "project", "left")
    left = F.lit(budget - status_cost) - F.coalesce("summary_cost", F.lit(0))
    # As many lines per project as the budget has tokens, at most.
    packed = (
        _within(lines, left)
        .groupBy("project")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"))
        .select("project", F.concat(F.lit(RECENT_HEADING), F.array_join("lines.line", "\n")).alias("recent"))
    )
    parts = F.concat_ws(
        "\n\n", F.lit(preamble or None), F.lit(status or None), F.col("summary_text"), F.col("recent")
    )
    return (
        projects.join(summaries.select("project", "summary_text"), "project", "left")
        .join(packed, "project", "left")
        .select("project", parts.alias("context"))
    )
