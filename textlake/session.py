"""Session settings and the shared folder used for written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Set on top of Spark's defaults by build_session. Sizes are per task, so they
# hold for 25 MB as well as for 100 TB: scan splits of 128 MB, shuffle
# partitions coalesced by AQE towards 128 MB, hot shuffle partitions split. A
# gated write has three outcomes, which four open files per task take without
# sorting the rows by outcome first.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "4",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def cluster_settings(total_cores: int, largest_shuffle_bytes: int = 0) -> dict[str, str]:
    """Shuffle partitions that AQE starts from: 128 MB each of the largest shuffle, and two per core at least.

    AQE merges partitions that turn out small, but cuts large ones only where they are skewed, so that the number
    has to come from the bytes.
    """
    by_bytes = -(-largest_shuffle_bytes // (128 << 20))
    return {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(200, 2 * total_cores, by_bytes))}


def build_session(app_name="textlake", master=None, **conf) -> SparkSession:
    """Session with the recommended settings; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the cluster's ``spark.checkpoint.dir``, which every executor must reach."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


# Where ensure_shared_dir keeps its folder: spark.checkpoint.dir can't be set in a running session.
_OWN = "textlake.shared.dir"


def ensure_shared_dir(spark: SparkSession) -> None:
    """Gives a session on one machine that names no shared folder one of its own, as tests do; others stay as they are."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not named and re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        spark.conf.set(_OWN, tempfile.mkdtemp(prefix="textlake-"))
