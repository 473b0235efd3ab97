"""Gated writes to a stored log: one pass over the texts, two outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log, merge, safety
from ..sources.tables import append_log

ACCEPTED = "accepted"
LEAK = "secret_leak"
UNKNOWN_TYPE = "unknown_type"


def judged(rows: DataFrame, key_cols, created_at: Column | None = None) -> DataFrame:
    """Complete observation rows with a ``status``: accepted or why they are refused."""
    status = (
        F.when(~log.is_known_type("type"), UNKNOWN_TYPE)
        .when(safety.has_leak("content"), LEAK)
        .otherwise(ACCEPTED)
    )
    return log.observation_rows(rows, key_cols, created_at).withColumn("status", status)


UNNAMED = "unnamed"
STORED_SCHEMA = (
    "id string, session_id string, project string, type string, content string, content_hash string, "
    "created_at {time}, status string, batch string"
)


def escaped(batch: str) -> str:
    """The name of a batch as one folder: what a path or Spark's readers take for something else is %XX."""
    return "".join(c if c.isalnum() or c in "-_." else "".join(f"%{b:02X}" for b in c.encode()) for c in str(batch))


def ingest_observations(rows: DataFrame, path: str, key_cols, created_at: Column | None = None, batch=None) -> None:
    """Appends rows below ``path``, partitioned by batch and status.

    With a ``batch`` name they go to a folder of that batch, which is written
    over when the job is run again, so that a repeated job adds nothing twice;
    without one they are added to the folder of the unnamed ones. Read with
    ``ingested``.

    The texts are read and screened once; readers of one status touch only its
    files, and the positions of the warnings are worked out from the refused
    files alone (see ``quarantine_warnings``).
    """
    writer = judged(rows, key_cols, created_at).write.partitionBy("status")
    if batch is None:
        writer.mode("append").parquet(f"{path}/batch={UNNAMED}")
    else:
        writer.mode("overwrite").parquet(f"{path}/batch={escaped(batch)}")


def ingested(spark: SparkSession, path: str, time_type="timestamp") -> DataFrame:
    """All rows below ``path`` with their status and batch, which is text whatever its name looks like."""
    return spark.read.schema(STORED_SCHEMA.format(time=time_type)).parquet(path)


def accepted_rows(stored: DataFrame) -> DataFrame:
    return stored.where(F.col("status") == ACCEPTED).drop("status")


def quarantined_rows(stored: DataFrame) -> DataFrame:
    return stored.where(F.col("status") != ACCEPTED)


def quarantine_warnings(stored: DataFrame) -> DataFrame:
    """(id, kind, pattern, position) of every credential in the refused rows."""
    return safety.scan_leaks(stored.where(F.col("status") == LEAK), ["id"], "content")


def append_merge(store: DataFrame, remote: DataFrame, path: str) -> None:
    """Appends the remote rows that the stored log lacks; running it again adds none."""
    append_log(merge.new_observations(store, remote), path)
