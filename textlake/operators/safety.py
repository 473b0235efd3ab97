"""Screen of texts for leaked credentials and instruction-injection phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import byte_view, col
from ..session import shared_dir
from .offsets import tagged_positions


def has_leak(text) -> Column:
    """Whether the text holds a credential: a cheap hint on the text, then the exact test."""
    exact = col(text).rlike(P.LEAK_HINT) & byte_view(text).rlike(P.LEAK_AT)
    return F.coalesce(exact, F.lit(False))


def has_injection(text) -> Column:
    """Whether the text holds an injection phrase."""
    found = col(text).rlike(P.LONG_PHRASE)
    for mark in P.SHORT_PHRASES:
        found = F.contains(col(text), F.lit(mark)) | found
    return F.coalesce(found, F.lit(False))


def scan_leaks(df: DataFrame, ids, text) -> DataFrame:
    """(ids, kind, pattern, position) of every credential, by byte position."""
    # The hint only: a text without a credential has no position and vanishes there.
    found = tagged_positions(df.where(col(text).rlike(P.LEAK_HINT)), ids, byte_view(text), P.LEAK_AT)
    return found.select(
        *ids, F.lit(P.SECRET_LEAK).alias("kind"), P.leak_description("tag").alias("pattern"), "position"
    )


def scan_injection(df: DataFrame, ids, text) -> DataFrame:
    """(ids, kind, pattern, position) of every injection phrase, by byte position."""
    found = tagged_positions(df.where(has_injection(text)), ids, byte_view(text), P.INJECTION_AT)
    return found.select(
        *ids, F.lit(P.INJECTION).alias("kind"), P.injection_description("tag").alias("pattern"), "position"
    )


def scan(df: DataFrame, ids, text) -> DataFrame:
    """Both scans in one pass over the texts.

    Sort by (ids, kind, position) for injections first, each by position.
    """
    suspect = df.where(has_injection(text) | col(text).rlike(P.LEAK_HINT))
    found = tagged_positions(suspect, ids, byte_view(text), P.ANY_AT)
    leak = P.is_leak_prefix("tag")
    return found.select(
        *ids,
        F.when(leak, P.SECRET_LEAK).otherwise(P.INJECTION).alias("kind"),
        F.when(leak, P.leak_description("tag")).otherwise(P.injection_description("tag")).alias("pattern"),
        "position",
    )


def gate(df: DataFrame, text, out="accepted") -> DataFrame:
    """Adds the verdict: rejected if and only if the text holds a credential."""
    return df.withColumn(out, ~has_leak(text))


def require_clean(df: DataFrame, text) -> DataFrame:
    """The same rows; the job that reads them fails at the first credential.

    For writes that must be all or nothing.
    """
    return df.where(F.assert_true(~has_leak(text), F.lit("text holds a credential")).isNull())


def partition_by_safety(df: DataFrame, ids, text, label="screened"):
    """(accepted rows, rejected rows, warnings of the rejected rows).

    The texts are read and screened once and stored by verdict in the shared folder; each result reads its part, and
    positions are worked out for the rejected texts alone.
    """
    path = shared_dir(df.sparkSession, label)
    gate(df, text, "_accepted").write.partitionBy("_accepted").parquet(path)
    # A verdict that no row has leaves no folder.
    screened = df.sparkSession.read.schema(f"{_ddl(df)}, _accepted boolean").parquet(path)
    accepted = screened.where("_accepted").drop("_accepted")
    rejected = screened.where("NOT _accepted").drop("_accepted")
    return accepted, rejected, scan_leaks(rejected, ids, text)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
