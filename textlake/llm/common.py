"""Parts that several operators of this subpackage use."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlake.session import ensure_shared_dir, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# Arrow batches have this many rows, so that their texts take little room on both sides of a Python worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> None:
    """Settings that the queries and stages want: small Arrow batches unless the session sets a size of its own, and a
    shared folder where there is none (see ``ensure_shared_dir``)."""
    ensure_shared_dir(spark)
    if int(spark.conf.get(_BATCH)) == 10_000:  # Spark's default
        spark.conf.set(_BATCH, BATCH_ROWS)


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter as it is."""
    return F.translate(c, UPPER, LOWER)


def free(name: str, *tables: DataFrame) -> str:
    """``name`` with as many underscores behind it as no column of the tables has, in any case of letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    This cuts the lineage: an executor that is lost costs its running tasks, not the steps before them.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, group: list[str], order: list[str], out: str, chunk_rows: int = 100_000) -> DataFrame:
    """Numbers the rows of every group from 0 without a gap, by chunks of about ``chunk_rows`` rows.

    A window over a whole group would sort a group of any size in one task. Here the rows of a group are dealt
    over chunks by a hash of ``order``; windows number the rows of a chunk, and the counts of the earlier chunks
    are added. Rows that agree in ``order`` are numbered in any order.
    """
    chunks = max(1, math.ceil(rows.count() / chunk_rows))
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy(*group, "_chunk")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    return (
        dealt.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(before, [*group, "_chunk"])
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_chunk", "_before", "_inside")
    )


def table(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A given table; its columns are named, so that no job looks into the files first."""
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PAGES = "page_id bigint, url string, html string"
LABELS = "doc_id bigint, quality int, toxic int"
BENCHMARK = "item_id bigint, text string"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", DOCUMENTS)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", PAGES)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels", LABELS)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark", BENCHMARK)
