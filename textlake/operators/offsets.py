"""Byte positions of matches inside texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import (
    PAD,
    byte_view,
    byte_view_of_binary,
    contains_bytes,
    java_quote,
    needle_bytes,
)


def _is_binary(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.BinaryType)


def bytes_of(df: DataFrame, name: str) -> Column:
    """Byte view of a text or binary column."""
    return byte_view_of_binary(name) if _is_binary(df, name) else byte_view(name)


def holds(df: DataFrame, name: str, needle: str) -> Column:
    """Case-sensitive substring test on a text or binary column, without decoding it.

    An empty needle matches nothing.
    """
    if _is_binary(df, name) and needle:
        return F.contains(F.col(name), F.lit(needle.encode("utf-8")))
    return contains_bytes(name, needle)


def match_rows(df: DataFrame, ids, b: Column, at: str, carry=(), measure=None, tag=None) -> DataFrame:
    """One row per match of ``at`` plus a head row (``ord`` 0) per text.

    Splitting at a lookahead cuts the text in front of every match, overlapping
    ones included; the padding character keeps a match at byte 0 from swallowing
    the head. Only sizes and small values leave the projection, never the text.
    ``measure`` maps a name to a function of a piece; ``tag`` is a regex whose
    group 1 is kept for every match.
    """
    # Separate steps: a generator does not share work between its arguments, and
    # columns used several times are not merged into their users.
    texts = df.select(*ids, *carry, b.alias("_b"))
    pieces = F.split(F.concat(F.lit(PAD), "_b"), f"(?={at})").alias("_pieces")
    values = {"size": F.length, **(measure or {})}
    if tag is None:
        cut = texts.select(*ids, *carry, pieces)
        found = F.transform("_pieces", lambda p: F.struct(*[f(p).alias(n) for n, f in values.items()]))
    else:
        tags = F.concat(F.array(F.lit("")), F.regexp_extract_all("_b", F.lit(f"(?={tag})"), F.lit(1)))
        cut = texts.select(*ids, *carry, pieces, tags.alias("_tags"))
        found = F.zip_with(
            "_pieces", "_tags", lambda p, t: F.struct(*[f(p).alias(n) for n, f in values.items()], t.alias("tag"))
        )
    return cut.select(*ids, *carry, F.posexplode(found).alias("ord", "m")).select(*ids, *carry, "ord", "m.*")


def running_position(ids) -> Column:
    """Byte position of each row of ``match_rows``: the sizes before it, less the padding."""
    before = W.partitionBy(*ids).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return (F.coalesce(F.sum("size").over(before), F.lit(0)) - 1).cast("bigint")


def tagged_positions(df: DataFrame, ids, b: Column, at: str) -> DataFrame:
    """(ids, position, tag) for every match of ``at``; tag is its group 1."""
    rows = match_rows(df, ids, b, at, tag=at)
    return rows.withColumn("position", running_position(ids)).where("ord > 0").select(*ids, "position", "tag")


def find_offsets(df: DataFrame, ids, text, needle: str, max_results: int | None = None) -> DataFrame:
    """(ids, ord, position): every occurrence of ``needle``, overlapping ones too.

    ``ids`` must identify a row. Texts without the needle are dropped in the
    scan; the shuffle by id carries three integers per hit.
    """
    at = java_quote(needle_bytes(needle)) or "(?!)"
    rows = match_rows(df.where(holds(df, text, needle)), ids, bytes_of(df, text), at)
    if max_results is not None:
        rows = rows.where(F.col("ord") <= max_results)
    return (
        rows.withColumn("position", running_position(ids))
        .where("ord > 0")
        .select(*ids, F.col("ord").cast("bigint").alias("ord"), "position")
    )


def contains_batch(df: DataFrame, ids, text, needle: str) -> DataFrame:
    """(ids, hit): whether each text contains ``needle``; an empty needle never hits."""
    return df.select(*ids, F.coalesce(holds(df, text, needle), F.lit(False)).alias("hit"))


def arrow_lines(df: DataFrame, ids, text) -> DataFrame:
    """(ids, line_no, line): lines that contain ``->``, once each, numbered from 1."""
    arrow = F.lit("->")
    lines = F.posexplode(F.split(text, "\n")).alias("pos", "line")
    return (
        df.where(F.contains(F.col(text), arrow))
        .select(*ids, lines)
        .where(F.contains(F.col("line"), arrow))
        .select(*ids, (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    )
