"""Benchmark histories: rows (name, pos, accepted, correct, time_us, hypothesis).

``pos`` is the place of an iteration in its file; a time of 0 counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import contains_nocase

# Fixed values.
KEYWORDS = [
    ("unroll", "Loop unrolling (2x-8x)"),
    ("prefetch", "Prefetch tuning (add or remove)"),
    ("f32x8", "SIMD width: f32x4 -> f32x8"),
    ("f32x16", "SIMD width: f32x8 -> f32x16 (AVX-512)"),
    ("stream_store", "Non-temporal stores (bypass cache)"),
    ("accumulator", "Multiple independent accumulators"),
    ("restrict", "Pointer restrict for alias analysis"),
    ("fuse", "Operation fusion"),
]


def _flag(c) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def _time() -> Column:
    return F.when(F.col("time_us") != 0, F.col("time_us"))


def history_summary(hist: DataFrame) -> DataFrame:
    """Per benchmark: iterations, accepted ones, and the time of the last accepted."""
    accepted_pos = F.when(_flag("accepted"), F.col("pos"))
    return hist.groupBy("name").agg(
        F.count(F.lit(1)).alias("iterations"),
        F.count_if(_flag("accepted")).alias("accepted"),
        F.max_by(_time(), accepted_pos).alias("last_time_us"),
    )


def latest_accepted(hist: DataFrame) -> DataFrame:
    """The last accepted iteration per benchmark, in file order.

    ``row_number = 1`` leaves one row per benchmark and task before the shuffle.
    """
    latest = W.partitionBy("name").orderBy(F.desc("pos"))
    accepted = hist.where(_flag("accepted"))
    return accepted.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select(*hist.columns)


def what_works(hist: DataFrame, total: int | None = None) -> DataFrame:
    """Last accepted time and hypothesis of every improved benchmark, with the shares."""
    counts = hist.groupBy("name").agg(F.count(F.lit(1)).alias("iterations"))
    improved = F.count_if(F.col("accepted") > 0).alias("improved")
    summary = history_summary(hist).groupBy().agg(F.struct(improved, F.count(F.lit(1)).alias("benchmarks")).alias("t"))
    totals = summary.scalar()
    benchmarks = F.lit(total).cast("bigint") if total is not None else totals["benchmarks"]
    wins = latest_accepted(hist).select(
        "name", _time().alias("time_us"), F.coalesce("hypothesis", F.lit("")).alias("strategy")
    )
    return wins.join(counts, "name").select(
        "name",
        "time_us",
        "strategy",
        "iterations",
        totals["improved"].alias("improved"),
        benchmarks.alias("benchmarks"),
    )


def winning_keywords(hist: DataFrame) -> DataFrame:
    """(ord, keyword, description) of the keywords in any last accepted hypothesis."""
    text = F.lower(F.coalesce("hypothesis", F.lit("")))
    # One pass of eight flags; the empty input yields none.
    found = latest_accepted(hist).agg(
        *[F.bool_or(F.contains(text, F.lit(k))).alias(f"k{i}") for i, (k, _) in enumerate(KEYWORDS)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("ord"),
                F.lit(k).alias("keyword"),
                F.lit(d).alias("description"),
                F.col(f"k{i}").alias("hit"),
            )
            for i, (k, d) in enumerate(KEYWORDS)
        ]
    )
    return found.select(F.explode(rows).alias("r")).where("r.hit").select("r.ord", "r.keyword", "r.description")


def history_detail(hist: DataFrame, query: str = "") -> DataFrame:
    """Every iteration of the benchmarks whose name holds ``query`` in any case."""
    return hist.where(contains_nocase("name", query)).select(
        "name",
        "pos",
        F.when(_flag("accepted"), "ACCEPTED").otherwise("rejected").alias("status"),
        _time().alias("time_us"),
        F.when(_flag("correct"), "correct").otherwise("WRONG").alias("verdict"),
        F.coalesce("hypothesis", F.lit("")).alias("hypothesis"),
    )


def accepted_iterations(hist: DataFrame, query: str = "") -> DataFrame:
    """What worked: every accepted iteration of the benchmarks whose name holds ``query``, with its whole hypothesis."""
    return hist.where(_flag("accepted") & contains_nocase("name", query)).select(
        "name", "pos", _time().alias("time_us"), F.coalesce("hypothesis", F.lit("n/a")).alias("hypothesis")
    )


def recent_failures(hist: DataFrame, limit: int = 5) -> DataFrame:
    """The last ``limit`` rejected iterations per benchmark, each with its reason."""
    latest = W.partitionBy("name").orderBy(F.desc("pos"))
    reason = (
        F.when(_time().isNull(), "compile error or timeout")
        .when(~_flag("correct"), "wrong output")
        .otherwise("no improvement")
    )
    return (
        hist.where(~_flag("accepted"))
        .withColumn("_n", F.row_number().over(latest))
        .where(F.col("_n") <= limit)
        .select(
            "name",
            "pos",
            reason.alias("reason"),
            F.coalesce("hypothesis", F.lit("n/a")).alias("hypothesis"),
        )
    )
