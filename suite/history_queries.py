"""Benchmark histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.operators import history
from textlake.sources import files

from .views import oracle, query, spark_view


def hist(spark, sf):
    return spark_view(spark, sf, "v_hist")


_LAST = "SELECT * FROM v_hist WHERE accepted QUALIFY row_number() OVER (PARTITION BY name ORDER BY pos DESC) = 1"
_TIME = "CASE WHEN time_us <> 0 THEN time_us END"


@query(
    "history_iterations",
    """SELECT event_id, 0::BIGINT AS pos, 0::BIGINT AS iteration, event_type = 'purchase' AS accepted,
      CAST(NULL AS BOOLEAN) AS correct, CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS time_us,
      concat('é ', event_type) AS hypothesis FROM events
    UNION ALL SELECT event_id, 1, user_id, NULL, true, NULL, NULL FROM events""",
)
def _(spark, sf):
    return files.history_iterations(spark_view(spark, sf, "v_history"), ["event_id"], "text")


@query(
    "strategy_notes",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN NULL
      ELSE concat(CASE p_partkey % 4 WHEN 3 THEN concat('x', chr(10), chr(10)) ELSE '' END,
        '- ', p_type, chr(10), chr(10), '- ', p_brand) END AS strategy FROM part""",
)
def _(spark, sf):
    programs = spark_view(spark, sf, "v_program")
    return programs.select("p_partkey", files.strategy_section(F.col("text")).alias("strategy"))


@query("latest_accepted", oracle("SELECT * FROM last", "v_hist", last=_LAST))
def _(spark, sf):
    return history.latest_accepted(hist(spark, sf))


@query(
    "history_summary",
    oracle(
        f"""SELECT h.name, count(*) AS iterations, count(*) FILTER (WHERE h.accepted) AS accepted,
        (SELECT {_TIME} FROM last l WHERE l.name = h.name) AS last_time_us FROM v_hist h GROUP BY h.name""",
        "v_hist",
        last=_LAST,
    ),
)
def _(spark, sf):
    return history.history_summary(hist(spark, sf))


@query(
    "what_works",
    oracle(
        f"""SELECT l.name, {_TIME} AS time_us, hypothesis AS strategy, n.iterations,
        (SELECT count(*) FROM last) AS improved, (SELECT count(DISTINCT name) FROM v_hist) AS benchmarks
        FROM last l JOIN (SELECT name, count(*) AS iterations FROM v_hist GROUP BY 1) n ON n.name = l.name""",
        "v_hist",
        last=_LAST,
    ),
)
def _(spark, sf):
    return history.what_works(hist(spark, sf))


# Fixed values, written out so that a wrong entry of the library shows.
_KEYWORDS = """(0, 'unroll', 'Loop unrolling (2x-8x)'), (1, 'prefetch', 'Prefetch tuning (add or remove)'),
    (2, 'f32x8', 'SIMD width: f32x4 -> f32x8'), (3, 'f32x16', 'SIMD width: f32x8 -> f32x16 (AVX-512)'),
    (4, 'stream_store', 'Non-temporal stores (bypass cache)'), (5, 'accumulator', 'Multiple independent accumulators'),
    (6, 'restrict', 'Pointer restrict for alias analysis'), (7, 'fuse', 'Operation fusion')"""


@query(
    "winning_keywords",
    oracle(
        f"""SELECT ord::BIGINT AS ord, keyword, description FROM (VALUES {_KEYWORDS}) t(ord, keyword, description)
        WHERE EXISTS (SELECT 1 FROM last WHERE contains(lower(hypothesis), keyword))""",
        "v_hist",
        last=_LAST,
    ),
)
def _(spark, sf):
    return history.winning_keywords(hist(spark, sf))


@query(
    "history_detail",
    oracle(
        f"""SELECT name, pos, CASE WHEN accepted THEN 'ACCEPTED' ELSE 'rejected' END AS status, {_TIME} AS time_us,
        CASE WHEN correct THEN 'correct' ELSE 'WRONG' END AS verdict, hypothesis
        FROM v_hist WHERE contains(lower(name), 'k1')""",
        "v_hist",
    ),
)
def _(spark, sf):
    return history.history_detail(hist(spark, sf), "K1")


@query(
    "recent_failures",
    oracle(
        f"""SELECT name, pos, CASE WHEN {_TIME} IS NULL THEN 'compile error or timeout'
          WHEN NOT correct THEN 'wrong output' ELSE 'no improvement' END AS reason, hypothesis
        FROM v_hist WHERE NOT accepted QUALIFY row_number() OVER (PARTITION BY name ORDER BY pos DESC) <= 5""",
        "v_hist",
    ),
)
def _(spark, sf):
    return history.recent_failures(hist(spark, sf))


@query(
    "accepted_iterations",
    oracle(f"SELECT name, pos, {_TIME} AS time_us, hypothesis FROM v_hist WHERE accepted AND contains(lower(name), 'k1')", "v_hist"),
)
def _(spark, sf):
    return history.accepted_iterations(hist(spark, sf), "K1")
