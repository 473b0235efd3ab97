"""Additive, idempotent merge of logs from several machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import content_hash


def row_hash() -> Column:
    """The row's hash, worked out where a row has none."""
    return F.coalesce("content_hash", content_hash("content"), F.lit(""))


def new_observations(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote rows whose content is not in ``local``, the first one per content.

    The hash is global, not per project; rows without one are compared by that of their content. Known contents go
    first, so that of a log that was merged before next to nothing is sorted: the hashes that both sides have come
    out of a semi join, which reads only hashes from the local side and does not shuffle it when the remote part is
    small enough for Spark to broadcast. ``row_number = 1`` then keeps one row per hash in every task before the
    shuffle, so a content that makes up a third of the remote log leaves one row per task.
    """
    arriving = remote.select("*", row_hash().alias("_hash"))
    known = local.select(row_hash().alias("_hash")).join(arriving.select("_hash").distinct(), "_hash", "left_semi").distinct()
    first = W.partitionBy("_hash").orderBy("created_at", "id")
    unknown = arriving.join(known, "_hash", "left_anti")
    return unknown.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*remote.columns)


def merge_observations(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Every local row unchanged plus the new remote ones.

    Ids are taken as they come; ``id_conflicts`` lists the new rows whose id the log has already.
    """
    return local.unionByName(new_observations(local, remote))


def id_conflicts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """New remote rows whose id is already taken by another content."""
    return new_observations(local, remote).join(local.select("id"), "id", "left_semi")


def merge_sessions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Unknown sessions whole; of known ones only a longer summary is taken.

    Length is in characters, ties stay local, end times are not merged.
    """
    mine, theirs = local.alias("l"), remote.alias("r")
    lsum, rsum = F.col("l.summary"), F.col("r.summary")
    longer = F.coalesce(F.length(rsum), F.lit(0)) > F.coalesce(F.length(lsum), F.lit(0))
    known = F.col("l.id").isNotNull()
    summary = F.when(known & ~longer, lsum).otherwise(rsum)

    def pick(c):
        return F.when(known, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c)

    return mine.join(theirs, F.col("l.id") == F.col("r.id"), "full_outer").select(
        *[summary.alias(c) if c == "summary" else pick(c) for c in local.columns]
    )


def merge_logs(local, remote):
    """Both merges on (sessions, observations) pairs."""
    return merge_sessions(local[0], remote[0]), merge_observations(local[1], remote[1])
