"""Structured Streaming jobs; both give what their batch forms give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.merge import new_observations, row_hash
from ..plans.ingest import judged
from ..plans.sessions import merge_stored_sessions
from ..sources.tables import append_log, read_log


def stream_safe_ingest(
    rows: DataFrame, path: str, checkpoint: str, key_cols, created_at: Column, trigger=None
) -> StreamingQuery:
    """Continuous gate: accepted and refused rows land in partitions of one table.

    The verdict is a row-wise native expression, so no state is kept. The file
    sink commits each micro-batch through its log: a batch that is run again
    after a failure adds nothing twice. Read with ``spark.read.parquet(path)``.
    """
    return (
        judged(rows, key_cols, created_at)
        .writeStream.format("parquet")
        .partitionBy("status")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


class _FirstOfContent(StatefulProcessor):
    """Lets the first row of every content through; a content's state is one flag that never expires."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues):
        if self.seen.exists():
            return
        self.seen.update((True,))
        # NULL comes first, as in an ascending sort.
        yield min(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order])

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def close(self) -> None:
        pass


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_merge(remote: DataFrame, path: str, checkpoint: str, schema, trigger=None) -> StreamingQuery:
    """Merges arriving observations into the log at ``path``.

    Which contents the log has is keyed state: a micro-batch looks up its own hashes, and what it reads does not grow
    with the log. The state starts from the log's hashes, which are read once, by the first micro-batch; later starts
    go on from the checkpoint. After a failure a micro-batch can come again whose rows, or some of them, were appended
    already: the first one after a start is therefore compared with the log. One such query may write to a log at a
    time, and nothing else while its checkpoint is in use.
    """
    spark = remote.sparkSession
    columns = read_log(spark, path, schema).columns
    arriving = remote.select(*columns).withColumn("_hash", row_hash())
    known = read_log(spark, path, schema).select(row_hash().alias("_hash")).distinct()
    fresh = arriving.groupBy("_hash").transformWithState(
        _FirstOfContent(["created_at", "id"]), arriving.schema, "append", "none", known.groupBy("_hash")
    )
    compared = []

    def add(batch: DataFrame, _batch_id: int) -> None:
        rows = batch.select(*columns)
        if not compared:
            rows = new_observations(read_log(batch.sparkSession, path, schema), rows)
        append_log(rows, path)
        compared.append(True)

    # The query keeps the settings that it starts with; those of the session go back at once.
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def stream_merge_sessions(remote: DataFrame, path: str, checkpoint: str, trigger=None) -> StreamingQuery:
    """Merges arriving sessions into the versioned table at ``path`` (``sources.versions``).

    Unknown sessions come in whole, of known ones only a longer summary is taken. A micro-batch reads and rewrites the
    buckets of its own sessions, and is a version of the table; the same one again changes nothing, so that a retry
    is safe. One such query may write to a table at a time.
    """

    def merge(batch: DataFrame, _batch_id: int) -> None:
        merge_stored_sessions(batch.sparkSession, path, batch)

    return remote.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_merge_logs(sessions: DataFrame, observations: DataFrame, path: str, checkpoint: str, schema, trigger=None) -> list[StreamingQuery]:
    """Both merges, into ``path``/sessions and ``path``/observations, each with its own checkpoint."""
    return [
        stream_merge_sessions(sessions, f"{path}/sessions", f"{checkpoint}/sessions", trigger),
        stream_merge(observations, f"{path}/observations", f"{checkpoint}/observations", schema, trigger),
    ]
