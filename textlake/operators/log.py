"""Sessions and observations: look-ups, timeline, statistics, and new rows.

Observations have the columns id, session_id, project, type, content,
content_hash, embedding (optional) and created_at; sessions have id, project,
started_at, ended_at and summary. Times may be timestamps or epoch seconds.
Equal times are ordered by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import col, contains_bytes, content_hash, like_anywhere, preview
from .safety import has_leak

# Fixed values.
OBSERVATION_TYPES = ["decision", "bug", "architecture", "pattern", "error", "note"]
INCOMPLETE = "[incomplete]"
BACKFILL_MARKER = "[migrated from index.bin]"
IN_PROGRESS = "(in progress)"


def _newest(df: DataFrame, time: str, limit: int | None) -> DataFrame:
    """The newest ``limit`` rows, all of them without a limit, newest first."""
    ordered = df.orderBy(F.desc(time), F.asc("id"))
    return ordered if limit is None else ordered.limit(limit)


def _of_project(df: DataFrame, project) -> DataFrame:
    return df.where(F.col("project") == project) if project else df


def filter_observations(obs, text="", project=None, obs_type=None, limit=20) -> DataFrame:
    """Newest observations by LIKE text (empty = any), project and type."""
    rows = _of_project(obs, project)
    if text:
        rows = rows.where(like_anywhere("content", text))
    if obs_type:
        rows = rows.where(F.col("type") == obs_type)
    return _newest(rows, "created_at", limit)


def recent_observations(obs, project=None, limit=5) -> DataFrame:
    return _newest(_of_project(obs, project), "created_at", limit)


def recall(obs, last=None) -> DataFrame:
    """Newest ``last`` observations of all projects; 0 or nothing means 20, "all" all of them."""
    return recent_observations(obs, limit=None if last == "all" else last or 20)


def observation_by_id(obs, obs_id) -> DataFrame:
    return obs.where(F.col("id") == obs_id).drop("embedding")


def search_observations(obs, text, project=None, limit=20) -> DataFrame:
    """Newest observations that hold ``text`` byte for byte; empty text finds none."""
    return _newest(_of_project(obs, project).where(contains_bytes("content", text)), "created_at", limit)


def filter_sessions(sessions, project=None, since=None, limit=20) -> DataFrame:
    rows = _of_project(sessions, project)
    if since is not None:
        rows = rows.where(F.col("started_at") >= F.lit(since).cast(rows.schema["started_at"].dataType))
    return _newest(rows, "started_at", limit)


def timeline(sessions, obs, project=None, limit=20, since=None) -> DataFrame:
    """The newest sessions with their observations, one row per observation.

    Sessions come newest first (``session_rank``), observations oldest first;
    a session without any keeps one row of NULLs. The sessions are limited
    before the join, so Spark knows that they are few, broadcasts them and
    filters the observations in place: a session holding a third of the log is
    never gathered in one task. ``limit=None`` gives all sessions, without a
    rank (NULL), which would take one task: sort by start and id instead.
    """
    newest = filter_sessions(sessions, project, since, limit)
    rank = F.row_number().over(W.orderBy(F.desc("started_at"), F.asc("id"))) if limit is not None else F.lit(None)
    ranked = newest.select(
        rank.cast("bigint").alias("session_rank"),
        F.col("id").alias("session_id"),
        "project",
        "started_at",
        "ended_at",
        "summary",
    )
    entries = obs.select("session_id", F.col("id").alias("obs_id"), "type", "content", "created_at")
    filled = entries.join(ranked, "session_id")
    used = obs.select("session_id").join(ranked.select("session_id"), "session_id", "left_semi")
    empty = ranked.join(used.distinct(), "session_id", "left_anti")
    both = filled.unionByName(empty, allowMissingColumns=True)
    columns = [*ranked.columns, "obs_id", "type", "content", "created_at"]
    order = ["session_rank"] if limit is not None else [F.desc("started_at"), "session_id"]
    return both.select(*columns).orderBy(*order, "created_at", "obs_id")


def filter_timeline(entries, project=None, obs_type=None) -> DataFrame:
    """Keep one project and one type; sessions left without observations go."""
    rows = _of_project(entries, project)
    return rows.where(F.col("type") == obs_type) if obs_type else rows


def preview_sessions(sessions) -> DataFrame:
    """Start to the minute, project, and the summary or a mark that it is open."""
    open_summary = F.when(F.coalesce("summary", F.lit("")) == "", F.lit(IN_PROGRESS))
    return sessions.select(
        "id",
        F.substring(F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss"), 1, 16).alias("started"),
        "project",
        open_summary.otherwise(F.col("summary")).alias("summary"),
    )


def preview_observations(obs, chars=100) -> DataFrame:
    return obs.select(
        "id",
        F.substring(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), 1, 16).alias("created"),
        "type",
        preview("content", chars).alias("content"),
    )


def memory_stats(obs, sessions, *stored_at: str) -> DataFrame:
    """One row: both counts, the newest session start (NULL without sessions) and the bytes of the files below
    ``stored_at`` (0 without any)."""
    n_obs = obs.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    size = stored_bytes(obs.sparkSession, *stored_at).scalar() if stored_at else F.lit(0).cast("bigint")
    return sessions.groupBy().agg(
        F.count(F.lit(1)).alias("session_count"), F.max("started_at").alias("last_session")
    ).select(n_obs.alias("observation_count"), "session_count", "last_session", size.alias("stored_bytes"))


def stored_bytes(spark, *paths: str) -> DataFrame:
    """One row: bytes of the files below ``paths``, from their listing; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return files.select("length").groupBy().agg(F.coalesce(F.sum("length"), F.lit(0)).alias("stored_bytes"))


def session_observation_counts(sessions, obs) -> DataFrame:
    """(session_id, observations) with 0 for empty sessions; counted before the join."""
    counts = obs.groupBy("session_id").agg(F.count(F.lit(1)).alias("observations"))
    ids = sessions.select(F.col("id").alias("session_id"))
    return ids.join(counts, "session_id", "left").select(
        "session_id", F.coalesce("observations", F.lit(0)).alias("observations")
    )


def list_projects(sessions) -> DataFrame:
    return sessions.select("project").where("project <> ''").distinct().orderBy("project")


# --- new rows -------------------------------------------------------------


def observation_rows(df, key_cols, created_at: Column | None = None) -> DataFrame:
    """Completes (project, type, content, ...) rows to observations.

    The id is a hash of ``key_cols``, which identify a source row, so that a
    task that is run again makes the same ids. Each value goes in with its
    length, NULL without one, so that different keys give different texts. Equal
    contents stay apart: local writes are not deduplicated.
    """
    values = [F.col(c).cast("string") for c in key_cols]
    key = F.concat(*[F.coalesce(F.concat(F.length(v), F.lit(":"), v), F.lit("-")) for v in values])
    have = set(df.columns)
    return df.select(
        F.sha2(key, 256).alias("id"),
        (F.col("session_id") if "session_id" in have else F.lit(None).cast("string")).alias("session_id"),
        "project",
        "type",
        "content",
        content_hash("content").alias("content_hash"),
        *(["embedding"] if "embedding" in have else []),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def is_known_type(c="type") -> Column:
    return F.coalesce(col(c).isin(OBSERVATION_TYPES), F.lit(False))


def open_sessions(requests, started_at: Column) -> DataFrame:
    """New session rows for (id, project) requests."""
    none = F.lit(None)
    return requests.select(
        "id",
        "project",
        started_at.alias("started_at"),
        none.cast("timestamp").alias("ended_at"),
        none.cast("string").alias("summary"),
    )


def close_sessions(sessions, updates) -> DataFrame:
    """Applies (id, ended_at, summary) rows; the latest one per id wins.

    Summaries with a credential are refused and unknown ids do nothing.
    """
    latest = W.partitionBy("id").orderBy(F.desc("ended_at"), F.desc("summary"))
    accepted = (
        updates.where(~has_leak("summary"))
        .withColumn("_n", F.row_number().over(latest))
        .where("_n = 1")
        .select("id", F.col("ended_at").alias("_ended"), F.col("summary").alias("_summary"))
    )
    hit = F.col("_ended").isNotNull()
    return sessions.join(accepted, "id", "left").select(
        "id",
        "project",
        "started_at",
        F.when(hit, F.col("_ended")).otherwise(F.col("ended_at")).alias("ended_at"),
        F.when(hit, F.col("_summary")).otherwise(F.col("summary")).alias("summary"),
    )


def mark_incomplete(sessions, marks) -> DataFrame:
    """Closes the sessions of (id, ended_at) rows that are still open."""
    first = marks.groupBy("id").agg(F.min("ended_at").alias("_ended"))
    hit = F.col("ended_at").isNull() & F.col("_ended").isNotNull()
    return sessions.join(first, "id", "left").select(
        "id",
        "project",
        "started_at",
        F.when(hit, F.col("_ended")).otherwise(F.col("ended_at")).alias("ended_at"),
        F.when(hit, F.lit(INCOMPLETE)).otherwise(F.col("summary")).alias("summary"),
    )


def _seconds(c) -> Column:
    return F.col(c).cast("timestamp").cast("double")


def orphan_sessions(sessions, machine="project", bucket_seconds=86400) -> DataFrame:
    """Closes, as incomplete, each open session at the next start on its machine.

    The next start is looked up inside (machine, time bucket) and, for the last
    session of a bucket, from the first start of the machine's next bucket, so
    a machine with a third of all sessions is spread over its buckets.
    """
    bucketed = sessions.withColumn("_bucket", F.floor(_seconds("started_at") / bucket_seconds))
    firsts = bucketed.groupBy(machine, "_bucket").agg(F.min("started_at").alias("_first"))
    following = firsts.select(
        machine, "_bucket", F.lead("_first").over(W.partitionBy(machine).orderBy("_bucket")).alias("_later")
    )
    inside = W.partitionBy(machine, "_bucket").orderBy("started_at", "id")
    chained = bucketed.withColumn("_next", F.lead("started_at").over(inside))
    next_start = F.coalesce("_next", "_later")
    orphan = F.col("ended_at").isNull() & next_start.isNotNull()
    return chained.join(following, [machine, "_bucket"], "left").select(
        *[c for c in sessions.columns if c not in ("ended_at", "summary")],
        F.when(orphan, next_start).otherwise(F.col("ended_at")).alias("ended_at"),
        F.when(orphan, F.lit(INCOMPLETE)).otherwise(F.col("summary")).alias("summary"),
    )


def backfill_notes(sessions, notes, now: Column, project="legacy"):
    """Old (note_id, text) rows as one closed session and a ``note`` each.

    Returns (new sessions, new observations, refused notes). The marker summary
    of an earlier run makes all three empty; the guard is a scalar subquery. All
    rows are made in one go, so that they can be appended together.
    """
    done = sessions.where((F.col("project") == project) & (F.col("summary") == BACKFILL_MARKER))
    fresh = done.groupBy().agg((F.count(F.lit(1)) == 0).alias("fresh")).scalar()
    pending = notes.where(fresh)
    accepted = pending.where(~has_leak("text"))
    sid = F.sha2(F.lit(f"backfill\u0001{project}"), 256)
    rows = accepted.select(
        "note_id",
        sid.alias("session_id"),
        F.lit(project).alias("project"),
        F.lit("note").alias("type"),
        F.col("text").alias("content"),
    )
    observations = observation_rows(rows, ["session_id", "note_id"], created_at=now)
    session = pending.groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        sid.alias("id"),
        F.lit(project).alias("project"),
        now.alias("started_at"),
        now.alias("ended_at"),
        F.lit(BACKFILL_MARKER).alias("summary"),
    )
    return session, observations, pending.where(has_leak("text"))
