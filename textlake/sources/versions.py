"""Stored tables whose rows change: versions by copy on write.

Rows are dealt over buckets by a hash of their key. A change reads and rewrites the buckets that its keys fall into,
into a folder of its own, and publishes a manifest row that names the folder of every bucket. Readers take the newest
manifest row (or the one they ask for), so that a version's files never change under them. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version bigint, key string, buckets int, schema string, folders map<int, string>"


def _manifest(spark: SparkSession, path: str, version: int | None = None):
    """The manifest row of a version, by default the newest one."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = None
    found = rows and rows.where(F.lit(version is None) | (F.col("version") == version)).orderBy(F.desc("version")).first()
    if not found:
        raise ValueError(f"no {'' if version is None else f'version {version} of a '}versioned table at {path}")
    return found


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> str:
    """Writes rows into a new folder, a file for each bucket, ordered so that files can be pruned by project."""
    folder = uuid.uuid4().hex
    order = [c for c in ("project", "started_at", "created_at", key) if c in rows.columns]
    dealt = rows.withColumn("_bucket", _bucket(key, buckets)).repartition("_bucket").sortWithinPartitions("_bucket", *order)
    dealt.write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    return folder


def _publish(spark: SparkSession, path: str, version: int, key: str, buckets: int, schema: str, folders: dict[int, str]) -> None:
    pairs = [F.lit(x) for pair in sorted(folders.items()) for x in pair]
    made = F.create_map(*pairs) if pairs else F.lit(None).cast("map<int, string>")
    row = spark.range(1).select(
        F.lit(version).cast("bigint").alias("version"),
        F.lit(key).alias("key"),
        F.lit(buckets).alias("buckets"),
        F.lit(schema).alias("schema"),
        made.alias("folders"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _held(spark: SparkSession, path: str, folder: str) -> list[int]:
    """Buckets that a folder has files of."""
    found = spark.read.schema("_bucket int").option("basePath", f"{path}/{folder}").parquet(f"{path}/{folder}")
    return [r[0] for r in found.select("_bucket").distinct().collect()]


def create(rows: DataFrame, path: str, key: str = "id", buckets: int = 64) -> None:
    """Stores rows as version 1. Choose so many buckets that one of them holds what a change may rewrite (some 100 MB)."""
    spark = rows.sparkSession
    try:
        _manifest(spark, path)
    except ValueError:
        pass
    else:
        raise ValueError(f"{path} has a versioned table already")
    folder = _write(rows, path, key, buckets)
    held = {} if rows.isEmpty() else dict.fromkeys(_held(spark, path, folder), folder)
    _publish(spark, path, 1, key, buckets, rows.schema.simpleString()[7:-1], held)


def _rows(spark: SparkSession, path: str, schema: str, folders: dict[int, str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], _ddl(schema))
    return spark.read.schema(_ddl(schema)).parquet(*[f"{path}/{folder}/_bucket={b}" for b, folder in sorted(folders.items())])


def _ddl(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(f"struct<{schema}>")


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at its newest version, or at the one asked for."""
    at = _manifest(spark, path, version)
    return _rows(spark, path, at["schema"], at["folders"] or {})


def newest(spark: SparkSession, path: str) -> int:
    return _manifest(spark, path)["version"]


def rewrite(spark: SparkSession, path: str, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], key: str = "id") -> int:
    """Applies ``apply(stored rows, changes)`` to the buckets that the changes' keys fall into; the new version's number.

    ``apply`` has to be right on any part of the table that holds all rows of the keys in question, as a join by key
    is, and may add rows of keys that the table lacks. Only the touched buckets' numbers come to the driver. Changes
    without rows make no version. What a failed change has written is not in any manifest.
    """
    at = _manifest(spark, path)
    if at["key"] != key:
        raise ValueError(f"the table at {path} has the key {at['key']}")
    folders = dict(at["folders"] or {})
    touched = [r[0] for r in changes.select(_bucket(key, at["buckets"]).alias("b")).distinct().collect()]
    if not touched:
        return at["version"]
    part = _rows(spark, path, at["schema"], {b: folders[b] for b in touched if b in folders})
    changed = apply(part, changes).select(*part.columns)
    folder = _write(changed, path, key, at["buckets"])
    # A touched bucket that the table lacks may have got no rows.
    there = touched if all(b in folders for b in touched) else _held(spark, path, folder)
    if not there:
        return at["version"]
    _publish(spark, path, at["version"] + 1, key, at["buckets"], at["schema"], {**folders, **dict.fromkeys(there, folder)})
    return at["version"] + 1
