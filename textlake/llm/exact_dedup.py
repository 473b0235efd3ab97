"""Exact deduplication by a stream with keyed state.

The stream keeps a row of state for every digest, for good and on disk (RocksDB): the smallest document id seen, the
place of that document's text (file and row), and the number of copies. A digest that comes again is a hit. Digests
only find the hits: the texts of all hits are compared in full, and texts that share a digest by chance are told
apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textlake.llm import bloom
from textlake.llm.common import documents, stored
from textlake.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    # All state partitions of an executor share one memory budget instead of having one each.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "400",
    # Else each state partition sets 4 MB of disk aside for its manifest, however little it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space, null as empty.

    A lone space needs no change, so that the pattern only matches what has to be rewritten.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    # Never null: a join on a digest that could be null would work it out once more to test that.
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def keyed(docs: DataFrame, digest: Callable[[Column], Column] = sha256, id_col="doc_id", text_col="text", with_text=False) -> DataFrame:
    """Digest, id and place of the texts of a table that was read from files, streamed or not."""
    norm = normalised(F.col(text_col))
    columns = [
        digest(norm).alias("digest"),
        F.col(id_col).alias("doc_id"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    ]
    return docs.select(*columns, *([norm.alias("norm")] if with_text else []))


def dedup_stream(keys: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the state of every digest and writes the rows of state that a micro-batch changed, one folder a batch.

    A batch that runs again after a failure overwrites its own folder.
    """
    state = keys.groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"),
        F.min_by("file", "doc_id").alias("keep_file"),
        F.min_by("row", "doc_id").alias("keep_row"),
        F.count(F.lit(1)).alias("copies"),
    )

    def changed(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        state.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(changed)
        .start()
    )


STATE_SCHEMA = "digest binary, keep_id bigint, keep_file bigint, keep_row bigint, copies bigint"


def state_of(spark: SparkSession, out: str) -> DataFrame:
    """The last state of every digest: copies only grow, so that the largest count is the last."""
    rows = spark.read.schema(f"{STATE_SCHEMA}, batch bigint").parquet(out)
    last = [F.max_by(c, "copies").alias(c) for c in ("keep_id", "keep_file", "keep_row")]
    return rows.groupBy("digest").agg(*last, F.max("copies").alias("copies"))


def classes_of_hits(texts: DataFrame, state: DataFrame) -> DataFrame:
    """Compares the whole texts of all hits: a row for each different text of a digest that came more than once.

    A text leaves its task only if its digest may have copies, which a Bloom filter says. Digests with at least one in
    2,000 of all copies are dealt over several tasks (there are at most 2,000 of them, so that they can be broadcast);
    grouping by digest and text then collapses copies before the second shuffle. ``state`` is read several times.
    """
    hits = state.where("copies > 1")
    texts, _ = bloom.split(texts, hits.select("digest"), [F.col("digest")])
    total = hits.agg(F.sum("copies")).first()[0] or 0
    heavy = max(1000, total // 2000)
    salts = F.ceil(F.col("copies") / F.lit(heavy)).cast("int")
    often = hits.where(F.col("copies") >= heavy).select("digest", salts.alias("salts"))
    dealt = texts.join(F.broadcast(often), "digest", "left").select(
        "digest", "doc_id", "norm", "file", "row", F.pmod(F.xxhash64("file", "row"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    )
    wanted = hits.select("digest", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)).alias("salt"))
    return (
        dealt.join(wanted, ["digest", "salt"], "left_semi")
        .groupBy("digest", "norm")
        .agg(
            F.min("doc_id").alias("keep_id"),
            F.min_by("file", "doc_id").alias("keep_file"),
            F.min_by("row", "doc_id").alias("keep_row"),
            F.count(F.lit(1)).alias("copies"),
        )
    )


def mark_copies(
    spark: SparkSession,
    read: Callable[[], DataFrame],
    stream: Callable[[], DataFrame],
    digest: Callable[[Column], Column] = sha256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, digest, keep_id (smallest id of an equal text), group_size, kept, and where the
    text that stays is found (keep_file, a hash of the file's path, and keep_row, the row in it; null if no copy has
    an id).

    ``stream`` and ``read`` give the same files as a stream and as a table. White space is compared as ``normalised``
    has it. Null and empty texts are equal to each other. Of rows that repeat with the same id, all count as the one
    that stays. A null id is kept only if no other copy has an id. An empty table gives no rows; further columns are
    not read.
    """
    base = shared_dir(spark, "exact-dedup")
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        dedup_stream(keyed(stream(), digest, id_col, text_col), f"{base}/state", f"{base}/checkpoint").awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # A stream over no files runs no batch and leaves no folder.
    nothing = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in STATE_SCHEMA.split(", ")]
    spark.range(0).select(*nothing).write.parquet(f"{base}/state/batch=-1")
    state = stored(state_of(spark, f"{base}/state"), "digests")

    classes_of_hits(keyed(read(), digest, id_col, text_col, with_text=True), state).write.parquet(f"{base}/classes")
    classes = spark.read.parquet(f"{base}/classes")
    clashing = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")

    keys = keyed(read(), digest, id_col, text_col)
    columns = ["digest", "doc_id", "keep_id", "keep_file", "keep_row", "copies"]
    marked = keys.join(state, "digest").select(*columns)
    if not clashing.isEmpty():
        # Texts that only share a digest: their rows take the class of their own text.
        texts = keyed(read(), digest, id_col, text_col, with_text=True).join(clashing, "digest", "left_semi")
        own = texts.join(classes, ["digest", "norm"]).select(*columns)
        marked = marked.join(clashing, "digest", "left_anti").unionByName(own)
    return marked.select(
        "doc_id",
        "digest",
        "keep_id",
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "keep_file",
        "keep_row",
    )


def mark_copies_of_table(spark: SparkSession, sf_dir: str, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """``mark_copies`` of the given documents, in micro-batches of files of about ``bytes_per_batch``, so that a large
    table is not one batch that has to succeed as a whole."""
    stream = spark.readStream.schema(documents(spark, sf_dir).schema).option("maxBytesPerTrigger", bytes_per_batch).parquet
    return mark_copies(spark, lambda: documents(spark, sf_dir), lambda: stream(f"{sf_dir}/document[s].parquet"))
