"""Stored tables: the function index and the log."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_TABLES = ["functions", "catalog", "notes", "embeddings"]

OBSERVATION_SCHEMA = (
    "id string, session_id string, project string, type string, content string, "
    "content_hash string, embedding array<float>, created_at timestamp"
)
SESSION_SCHEMA = "id string, project string, started_at timestamp, ended_at timestamp, summary string"


def write_tables(path: str, built_at: Column, **tables: DataFrame) -> None:
    """Writes the index tables as a new version and, last, a ``meta`` row with their counts.

    Readers take the newest version in ``meta``, so that they find complete tables of one build while another one
    is written. One build may write at a time. Embeddings are stored once per file, keyed by path.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    number = (_meta(spark, path).agg(F.max("version_no")).first()[0] or 0) + 1
    for name in INDEX_TABLES:
        if name in tables:
            tables[name].write.parquet(f"{path}/{version}/{name}")
    stored = [n for n in INDEX_TABLES if n in tables]
    counts = [
        spark.read.parquet(f"{path}/{version}/{n}").groupBy().agg(F.count(F.lit(1)).alias("n")).scalar().alias(f"{n}_count")
        for n in stored
    ]
    missing = [F.lit(None).cast("bigint").alias(f"{n}_count") for n in INDEX_TABLES if n not in tables]
    row = spark.range(1).select(
        F.lit(number).cast("bigint").alias("version_no"),
        F.lit(version).alias("version"),
        built_at.cast("bigint").alias("built_at"),
        *counts,
        *missing,
    )
    row.coalesce(1).write.mode("append").parquet(f"{path}/meta")


_META = "version_no bigint, version string, built_at bigint, " + ", ".join(f"{n}_count bigint" for n in INDEX_TABLES)


def _meta(spark: SparkSession, path: str) -> DataFrame:
    """One row per version; none if nothing was written."""
    try:
        return spark.read.schema(_META).parquet(f"{path}/meta")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _META.split(", ")])


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest version and its ``meta`` row."""
    newest = _meta(spark, path).orderBy(F.desc("version_no")).limit(1)
    meta = newest.first()
    if meta is None:
        raise ValueError(f"no complete index below {path}")
    stored = [n for n in INDEX_TABLES if meta[f"{n}_count"] is not None]
    row = newest.select("built_at", *[f"{n}_count" for n in stored])
    return {"meta": row, **{n: spark.read.parquet(f"{path}/{meta['version']}/{n}") for n in stored}}


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows, partitioned by project.

    Rebalancing gives few files of even size per project and splits a project
    that holds a large share of the rows over several writers.
    """
    df.hint("rebalance", "project").write.mode("append").partitionBy("project").parquet(path)


def read_log(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stored log table; pass its schema where the log may still be empty.

    Without one, project names made of digits would come back as numbers. An
    empty project name, which a folder name cannot hold, is restored.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(path)
    if "project" not in rows.columns:
        return rows
    return rows.withColumn("project", F.coalesce(F.col("project").cast("string"), F.lit("")))


def export_snapshot(df: DataFrame, path: str) -> None:
    """A verbatim copy of a log table."""
    df.write.mode("overwrite").parquet(path)
