"""Round trips through stored tables, gated writes, and the streaming jobs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from textlake.functions import code as flags
from textlake.functions import text as tx
from textlake.functions import vectors as vec
from textlake.plans import ingest
from textlake.plans.sessions import close_stored_sessions, mark_stored_incomplete
from textlake.session import shared_dir
from textlake.sources import files, tables, versions
from textlake.sources.tree_source import SourceTree
from textlake.streaming.ingest import stream_merge, stream_merge_logs, stream_safe_ingest

from .code_queries import CODE, functions, sources
from .log_queries import CLOSED, MERGED_OBS, MERGED_SESS, closing, observations, remote_observations, remote_sessions, sessions
from .text_queries import LEAKS
from .views import TABLES, VIEWS, oracle, query, spark_view

EPOCH = 1704067200


_TREE = """SELECT concat('n=', CAST(p_partkey % 40 AS STRING)) AS folder, sum(octet_length(encode(content)) + 1)::BIGINT AS bytes,
        sum(len(string_split(content, 'export func ')) - 1)::BIGINT AS exports
        FROM (SELECT CAST(regexp_extract(path, 'k(\\d+)[.]ea', 1) AS BIGINT) AS p_partkey, content FROM v_src)
        WHERE p_partkey % 40 <> 7 GROUP BY 1"""


def _written_tree(spark, sf):
    """The sources as a tree of folders, one of which is to be skipped."""
    path = shared_dir(spark, "tree")
    number = F.regexp_extract("path", r"k(\d+)[.]ea", 1).cast("bigint") % 40
    texts = sources(spark, sf).select(number.alias("n"), F.col("content").alias("value"))
    texts.repartition(8, "n").write.partitionBy("n").text(path)
    return path


def _by_folder(found):
    return found.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(
        F.sum("length").alias("bytes"), F.sum(flags.count_exports(tx.byte_view_of_binary("content"))).alias("exports")
    )


@query("load_source_tree", oracle(_TREE, "v_src"))
def _(spark, sf):
    return _by_folder(files.load_source_tree(spark, [_written_tree(spark, sf)], suffix=".txt", skip_dirs=["n=7"]))


@query("source_tree_stream", oracle(_TREE, "v_src"))
def _(spark, sf):
    """The tree as a stream into a table."""
    spark.dataSource.register(SourceTree)
    tree, path = _written_tree(spark, sf), shared_dir(spark, "stream")
    stream = spark.readStream.format("source_tree").option("roots", json.dumps([tree])).option("suffix", ".txt").option("skip_dirs", '["n=7"]')
    job = stream.option("settle", 0).load().writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    job.trigger(availableNow=True).start().awaitTermination()
    return _by_folder(spark.read.parquet(f"{path}/rows"))


@query(
    "write_read_tables",
    oracle(
        """SELECT (SELECT count(*) FROM fn) AS functions_count, (SELECT count(*) FROM v_src) AS embeddings_count,
        CAST(1704067200 AS BIGINT) AS built_at, fn.path, func_name, length(s.content)::BIGINT AS bytes
        FROM fn JOIN v_src s ON s.path = fn.path""",
        "v_src",
        **CODE,
    ),
)
def _(spark, sf):
    path = shared_dir(spark, "index")
    embeddings = sources(spark, sf).select("path", vec.byte_counts("content").alias("embedding"))
    tables.write_tables(
        path, F.lit(EPOCH).cast("bigint"), functions=functions(spark, sf), embeddings=embeddings
    )
    stored = tables.read_tables(spark, path)
    total = F.aggregate("embedding", F.lit(0).cast("bigint"), lambda a, x: a + x)
    joined = stored["functions"].join(stored["embeddings"], "path").select("path", "func_name", total.alias("bytes"))
    meta = {c: stored["meta"].select(c).scalar().alias(c) for c in stored["meta"].columns}
    return joined.select("*", *meta.values())


@query(
    "append_log",
    oracle("SELECT id, project, type, content, created_s AS created_at FROM v_obs", "v_obs"),
)
def _(spark, sf):
    path = shared_dir(spark, "log")
    obs = observations(spark, sf).select("id", "project", "type", "content", "created_at")
    tables.append_log(obs.where("type = 'note'"), path)
    tables.append_log(obs.where("type <> 'note'"), path)
    return tables.read_log(spark, path, obs.schema)


@query(
    "export_snapshot",
    oracle(
        "SELECT id, project, started_s AS started_at, ended_s AS ended_at, summary FROM v_sess", "v_sess"
    ),
)
def _(spark, sf):
    path = shared_dir(spark, "snapshot")
    tables.export_snapshot(sessions(spark, sf), path)
    return tables.read_log(spark, path)


def _incoming(planted):
    return planted.select(
        F.col("doc_id").alias("note_id"),
        F.col("source").alias("project"),
        F.when(F.col("doc_id") % 11 == 0, "rumour").otherwise("note").alias("type"),
        F.col("text").alias("content"),
    )


_ID = "sha256(concat(CAST(length(CAST(doc_id AS STRING)) AS STRING), ':', CAST(doc_id AS STRING)))"
_INGESTED = f"""SELECT {_ID} AS id, CAST(NULL AS STRING) AS session_id, source AS project,
    CASE WHEN doc_id % 11 = 0 THEN 'rumour' ELSE 'note' END AS type, text AS content, sha256(text) AS content_hash,
    CAST(1704067200 AS BIGINT) AS created_at,
    CASE WHEN doc_id % 11 = 0 THEN 'unknown_type' WHEN doc_id IN (SELECT doc_id FROM leaks) THEN 'secret_leak'
         ELSE 'accepted' END AS status FROM v_planted"""


def _ingested(spark, sf):
    path = shared_dir(spark, "ingest")
    incoming = _incoming(spark_view(spark, sf, "v_planted"))
    ingest.ingest_observations(incoming, path, ["note_id"], F.lit(EPOCH).cast("bigint"))
    return ingest.ingested(spark, path, "bigint").drop("batch")


@query("ingest_observations", oracle(_INGESTED, "v_planted", **LEAKS))
def _(spark, sf):
    return _ingested(spark, sf)


@query(
    "ingest_observations_batches",
    oracle(
        f"""SELECT *, CASE WHEN id IN (SELECT {_ID} FROM v_planted WHERE doc_id % 2 = 0) THEN '007' ELSE 'unnamed' END AS batch
        FROM i""",
        "v_planted",
        **LEAKS,
        i=_INGESTED,
    ),
)
def _(spark, sf):
    """Named batches, one of them twice, and unnamed rows on one path."""
    path = shared_dir(spark, "ingest")
    incoming, now = _incoming(spark_view(spark, sf, "v_planted")), F.lit(EPOCH).cast("bigint")
    for _ in range(2):
        ingest.ingest_observations(incoming.where("note_id % 2 = 0"), path, ["note_id"], now, batch="007")
    ingest.ingest_observations(incoming.where("note_id % 2 = 1"), path, ["note_id"], now)
    return ingest.ingested(spark, path, "bigint")


@query(
    "quarantine_warnings",
    oracle(
        f"""SELECT {_ID} AS id, kind, pattern, position FROM leaks WHERE doc_id % 11 <> 0""",
        "v_planted",
        **LEAKS,
    ),
)
def _(spark, sf):
    return ingest.quarantine_warnings(_ingested(spark, sf))


@query("stream_safe_ingest", oracle(_INGESTED, "v_planted", **LEAKS))
def _(spark, sf):
    # A pattern, as the table may be one file or a folder of files.
    stream = spark.readStream.schema(TABLES["documents"]).parquet(f"{sf}/document[s].parquet")
    sql = VIEWS["v_planted"].replace("FROM documents", "FROM {documents}")
    path = shared_dir(spark, "stream")
    job = stream_safe_ingest(
        _incoming(spark.sql(sql, documents=stream)),
        f"{path}/rows",
        f"{path}/checkpoint",
        ["note_id"],
        F.lit(EPOCH).cast("bigint"),
    )
    job.awaitTermination()
    return spark.read.schema(ingest.STORED_SCHEMA.format(time="bigint")).parquet(f"{path}/rows").drop("batch")


@query(
    "stream_merge",
    oracle(
        "SELECT id, session_id, project, type, content, created_s AS created_at, sha256(content) AS content_hash FROM m",
        "v_obs",
        "v_remote_obs",
        m=MERGED_OBS,
    ),
)
def _(spark, sf):
    path = shared_dir(spark, "merge")
    obs = observations(spark, sf)
    tables.append_log(obs, f"{path}/log")
    # The other machine's rows arrive as files.
    tables.export_snapshot(remote_observations(spark, sf), f"{path}/arriving")
    arriving = spark.readStream.schema(obs.schema).parquet(f"{path}/arriving")
    job = stream_merge(arriving, f"{path}/log", f"{path}/checkpoint", obs.schema)
    job.awaitTermination()
    return tables.read_log(spark, f"{path}/log", obs.schema)


@query(
    "stream_merge_logs",
    oracle(
        """SELECT 'session' AS part, id, project, started_at AS at, coalesce(summary, '-') AS said FROM s
        UNION ALL SELECT 'observation', id, project, created_s, content FROM m""",
        "v_obs",
        "v_sess",
        "v_remote_obs",
        "v_remote_sess",
        m=MERGED_OBS,
        s=MERGED_SESS,
    ),
)
def _(spark, sf):
    """Both tables of another machine arrive in two parts, and the streams start again for the second one."""
    path = shared_dir(spark, "merge")
    obs, sess = observations(spark, sf), sessions(spark, sf)
    tables.append_log(obs, f"{path}/log/observations")
    versions.create(sess, f"{path}/log/sessions", buckets=8)
    for part in (0, 1):
        for name, rows in (("observations", remote_observations(spark, sf)), ("sessions", remote_sessions(spark, sf))):
            rows.where(F.expr("id % 4 div 2") == part).write.mode("append").parquet(f"{path}/arriving/{name}")
        arriving = [spark.readStream.schema(t.schema).parquet(f"{path}/arriving/{n}") for n, t in (("sessions", sess), ("observations", obs))]
        for job in stream_merge_logs(*arriving, f"{path}/log", f"{path}/checkpoint", obs.schema):
            job.awaitTermination()
    merged = tables.read_log(spark, f"{path}/log/observations", obs.schema)
    said = F.coalesce("summary", F.lit("-")).alias("said")
    return versions.read(spark, f"{path}/log/sessions").select(
        F.lit("session").alias("part"), "id", "project", F.col("started_at").alias("at"), said
    ).unionByName(
        merged.select(F.lit("observation").alias("part"), "id", "project", F.col("created_at").alias("at"), F.col("content").alias("said"))
    )


@query("close_stored_sessions", oracle(f"SELECT 2 AS version, * FROM ({CLOSED}) UNION ALL SELECT 1, id, project, started_s, ended_s, summary FROM v_sess", "v_obs", "v_sess"))
def _(spark, sf):
    """The rows of both versions: before and after the sessions are closed."""
    path = shared_dir(spark, "sessions")
    versions.create(sessions(spark, sf), path, buckets=8)
    close_stored_sessions(spark, path, closing(spark, sf))
    both = [versions.read(spark, path, v).select(F.lit(v).alias("version"), "*") for v in (1, 2)]
    return both[0].unionByName(both[1])


@query(
    "mark_stored_incomplete",
    oracle(
        """SELECT id, project, started_s AS started_at, CASE WHEN ended_s IS NULL AND id < 100000 THEN started_s + 99 ELSE ended_s END AS ended_at,
        CASE WHEN ended_s IS NULL AND id < 100000 THEN '[incomplete]' ELSE summary END AS summary FROM v_sess""",
        "v_sess",
    ),
)
def _(spark, sf):
    path = shared_dir(spark, "sessions")
    stored = sessions(spark, sf)
    versions.create(stored, path, buckets=8)
    mark_stored_incomplete(spark, path, stored.where("id < 100000").select("id", (F.col("started_at") + 99).alias("ended_at")))
    return versions.read(spark, path)
