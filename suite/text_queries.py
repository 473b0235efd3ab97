"""Text search, byte histograms, similarity, and the safety screen."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import text as tx
from textlake.functions import vectors as vec
from textlake.operators import offsets, safety, vectors

from .views import oracle, query, spark_view

NEEDLE = "ene"
# Occurrences overlap ("enene"): split on the two bytes that cannot, then test the rest.
_PIECES = "SELECT doc_id, string_split(text, 'en') AS parts FROM documents WHERE contains(text, 'ene')"
_OFFSETS = """
    SELECT doc_id, position FROM (
      SELECT doc_id, k, n, starts_with(parts[k + 1], 'e') OR (parts[k + 1] = '' AND k + 1 < n) AS hit,
        CAST(sum(octet_length(encode(parts[k])) + 2) OVER (PARTITION BY doc_id ORDER BY k) - 2 AS BIGINT) AS position
      FROM (SELECT doc_id, parts, len(parts) AS n, unnest(range(1, len(parts))) AS k FROM pieces)) WHERE hit"""


@query(
    "find_offsets",
    oracle(
        """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY position) AS BIGINT) AS ord, position
        FROM hits""",
        pieces=_PIECES,
        hits=_OFFSETS,
    ),
)
def _(spark, sf):
    return offsets.find_offsets(spark_view(spark, sf, "documents"), ["doc_id"], "text", NEEDLE)


@query(
    "find_offsets_capped",
    oracle(
        """SELECT * FROM (
          SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY position) AS BIGINT) AS ord, position
          FROM hits) WHERE ord <= 3""",
        pieces=_PIECES,
        hits=_OFFSETS,
    ),
)
def _(spark, sf):
    return offsets.find_offsets(spark_view(spark, sf, "documents"), ["doc_id"], "text", NEEDLE, 3)


@query("contains_batch", "SELECT doc_id, contains(text, 'ère') AS hit FROM documents")
def _(spark, sf):
    return offsets.contains_batch(spark_view(spark, sf, "documents"), ["doc_id"], "text", "ère")


@query(
    "arrow_lines",
    """SELECT page_id, CAST(k AS BIGINT) AS line_no, lines[k] AS line
    FROM (SELECT page_id, lines, unnest(range(1, len(lines) + 1)) AS k
          FROM (SELECT page_id, string_split(html, chr(10)) AS lines FROM pages)) WHERE contains(lines[k], '->')""",
)
def _(spark, sf):
    return offsets.arrow_lines(spark_view(spark, sf, "pages"), ["page_id"], "html")


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(spark, sf):
    return spark_view(spark, sf, "documents").select("doc_id", tx.content_hash("text").alias("content_hash"))


@query("estimate_tokens", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def _(spark, sf):
    return spark_view(spark, sf, "documents").select("doc_id", tx.estimate_tokens("text").alias("tokens"))


@query(
    "time_ago",
    """SELECT event_id, CASE WHEN d < 60 THEN concat(CAST(d AS STRING), 's ago')
      WHEN d < 3600 THEN concat(CAST(d // 60 AS STRING), 'm ago')
      WHEN d < 86400 THEN concat(CAST(d // 3600 AS STRING), 'h ago')
      ELSE concat(CAST(d // 86400 AS STRING), 'd ago') END AS ago
    FROM (SELECT event_id, max(s) OVER () - s AS d
          FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events))""",
)
def _(spark, sf):
    events = spark_view(spark, sf, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    now = events.groupBy().agg(F.max("s").alias("now")).scalar()
    return events.select("event_id", tx.time_ago("s", now).alias("ago"))


@query(
    "truncate_bytes",
    """SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 127 THEN text ELSE concat((
        SELECT max(p) FROM (SELECT substr(text, 1, n) AS p FROM range(1, 125) t(n))
        WHERE octet_length(encode(p)) <= 124), '...') END AS cut FROM documents""",
)
def _(spark, sf):
    return spark_view(spark, sf, "documents").select("doc_id", tx.truncate_bytes("text", 127).alias("cut"))


# --- histograms and vectors -----------------------------------------------

_BYTES = """
    SELECT doc_id, CAST(concat('0x', h) AS BIGINT) AS byte, count(*) AS cnt
    FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) GROUP BY ALL"""


@query("byte_histogram", oracle("SELECT doc_id, byte, cnt FROM b", b=_BYTES))
def _(spark, sf):
    return vectors.byte_histogram(spark_view(spark, sf, "documents"), ["doc_id"], "text")


@query(
    "l2_normalize",
    """SELECT vec_id, CAST(i AS BIGINT) AS i, round(CAST(embedding[i + 1] AS DOUBLE) / n, 6) AS x
    FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i,
            sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))) AS n
          FROM embeddings)""",
)
def _(spark, sf):
    unit = spark_view(spark, sf, "embeddings").select("vec_id", F.posexplode(vec.l2_normalize("embedding")).alias("i", "x"))
    return unit.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


_SCORES = """
    SELECT v.vec_id, v.label,
      round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))
        / sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))
        / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS score
    FROM embeddings v, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"""


def _scored(spark, sf):
    table = spark_view(spark, sf, "embeddings")
    q = vectors.query_vector(table.orderBy("vec_id").limit(1), "embedding")
    scored = vectors.score_vectors(table, "embedding", q)
    return scored.select("vec_id", F.col("label").cast("bigint").alias("label"), F.round("score", 6).alias("score"))


@query("score_vectors", oracle("SELECT vec_id, label::BIGINT AS label, score FROM s", s=_SCORES))
def _(spark, sf):
    return _scored(spark, sf)


@query("cosine", oracle("SELECT vec_id, score AS cosine FROM s", s=_SCORES))
def _(spark, sf):
    return _scored(spark, sf).select("vec_id", F.col("score").alias("cosine"))


_TOP = """SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS BIGINT) AS rank
    FROM s ORDER BY score DESC, vec_id LIMIT 10"""


@query("top_k", oracle(_TOP, s=_SCORES))
def _(spark, sf):
    return vectors.top_k(_scored(spark, sf), 10, ties=["vec_id"]).select("vec_id", "score", "rank")


@query(
    "fetch_hits",
    oracle(
        "SELECT t.vec_id, t.score, t.rank, e.label::BIGINT AS label FROM t JOIN embeddings e USING (vec_id)",
        s=_SCORES,
        t=_TOP,
    ),
)
def _(spark, sf):
    hits = vectors.top_k(_scored(spark, sf), 10, ties=["vec_id"]).select("vec_id", "score", "rank")
    table = spark_view(spark, sf, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"))
    return vectors.fetch_hits(hits, table, "vec_id").select("vec_id", "score", "rank", "label")


_MANY = """
    SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))
        / sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))
        / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS score
    FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0"""


def _many(spark, sf, **options):
    """Every fiftieth vector asks for all."""
    table = spark_view(spark, sf, "embeddings")
    queries = table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    scored = vectors.score_many(table, queries, id_col="vec_id", **options)
    return scored.select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("score_vectors_many", oracle("SELECT query_id, vec_id, score FROM s", s=_MANY))
def _(spark, sf):
    return _many(spark, sf)


@query("score_vectors_least", oracle("SELECT query_id, vec_id, score FROM s WHERE score >= 0.3", s=_MANY))
def _(spark, sf):
    return _many(spark, sf, least=0.3)


@query(
    "top_k_by_query",
    oracle(
        """SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::BIGINT AS rank
        FROM s QUALIFY rank <= 10""",
        s=_MANY,
    ),
)
def _(spark, sf):
    return vectors.top_k_by(_many(spark, sf, best=10, digits=6), "query_id", 10, ties=["vec_id"])


@query("with_embedding", "SELECT vec_id, len(embedding)::BIGINT AS dim FROM embeddings WHERE embedding IS NOT NULL")
def _(spark, sf):
    rows = vectors.with_embedding(spark_view(spark, sf, "embeddings"), id_col="vec_id")
    return rows.select("vec_id", F.size("embedding").cast("bigint").alias("dim"))


@query("drop_embedding", "SELECT vec_id, label::BIGINT AS label FROM embeddings")
def _(spark, sf):
    return vectors.drop_embedding(spark_view(spark, sf, "embeddings")).withColumn("label", F.col("label").cast("bigint"))


FUZZY = "the nation of ents"


def byte_scores(table: str, key: str, text: str, needle: str) -> dict[str, str]:
    """Oracle parts: cosine of each text's byte counts with those of ``needle``."""
    return {
        "q": f"""SELECT CAST(concat('0x', h) AS BIGINT) AS byte, count(*) AS qc
          FROM (SELECT unnest(regexp_extract_all(hex(encode('{needle}')), '..')) AS h) GROUP BY 1""",
        "c": f"""SELECT {key}, CAST(concat('0x', h) AS BIGINT) AS byte, count(*) AS cnt
          FROM (SELECT {key}, unnest(regexp_extract_all(hex(encode({text})), '..')) AS h FROM {table}) GROUP BY ALL""",
        "scores": f"""SELECT {key}, round(CAST(sum(cnt * coalesce(qc, 0)) AS DOUBLE)
            / sqrt(CAST(sum(cnt * cnt) AS DOUBLE)) / (SELECT sqrt(CAST(sum(qc * qc) AS DOUBLE)) FROM q), 6) AS score
          FROM c LEFT JOIN q USING (byte) GROUP BY {key}""",
    }


@query(
    "fuzzy_search_observations",
    oracle(
        """SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM scores
        WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 5""",
        **byte_scores("documents", "doc_id", "text", FUZZY),
    ),
)
def _(spark, sf):
    docs = spark_view(spark, sf, "documents").select("doc_id", vec.byte_counts("text").alias("embedding"))
    return vectors.fuzzy_search(docs, FUZZY, 5, ties=["doc_id"]).select("doc_id", "score", "rank")


# --- safety ---------------------------------------------------------------

# Fixed values, written out so that a wrong entry of the library shows: number, prefix, least bytes behind it, hex
# pairs that these may be, description.
_UPPER = "(?:3[0-9]|4[1-9A-F]|5[0-9A])*"
_WORD = "(?:3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|5F)*"
_DASH = "(?:3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|5F|2D)*"
_DOT = "(?:3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A]|5F|2D|2E)*"
_ANY = "(?:..)*"
_LEAK_ROWS = f"""
    (0, 'sk-ant-api', 10, '{_DASH}', 'Anthropic API key'), (1, 'sk-proj-', 12, '{_DASH}', 'OpenAI API key (project)'),
    (2, 'sk-', 17, '{_DASH}', 'OpenAI API key'), (3, 'AKIA', 16, '{_UPPER}', 'AWS access key'),
    (4, 'ghp_', 36, '{_WORD}', 'GitHub personal token'), (5, 'gho_', 36, '{_WORD}', 'GitHub OAuth token'),
    (6, 'ghu_', 36, '{_WORD}', 'GitHub user token'), (7, 'ghs_', 36, '{_WORD}', 'GitHub server token'),
    (8, 'ghr_', 36, '{_WORD}', 'GitHub refresh token'), (9, 'github_pat_', 29, '{_WORD}', 'GitHub fine-grained PAT'),
    (10, 'xoxb-', 10, '{_DASH}', 'Slack bot token'), (11, 'xoxp-', 10, '{_DASH}', 'Slack user token'),
    (12, 'xoxa-', 10, '{_DASH}', 'Slack app token'), (13, 'SG.', 37, '{_DOT}', 'SendGrid API key'),
    (14, 'sk_live_', 16, '{_WORD}', 'Stripe live API key'), (15, 'sk_test_', 16, '{_WORD}', 'Stripe test API key'),
    (16, 'sess_', 27, '{_WORD}', 'Session token'), (17, '-----BEGIN', 0, '{_ANY}', 'PEM private key'),
    (18, 'AIza', 35, '{_DASH}', 'Google API key'), (19, 'Bearer ', 20, '{_ANY}', 'Bearer token')"""
# Offsets by splitting, tails by walking the hex pairs up to a whitespace byte.
LEAKS = {
    "lp": f"SELECT * FROM (VALUES {_LEAK_ROWS}) t(i, prefix, least, hexclass, descr)",
    "lparts": """SELECT doc_id, i, prefix, least, hexclass, descr, text, string_split(text, prefix) AS parts
      FROM v_planted, lp WHERE contains(text, prefix)""",
    "lcut": """SELECT doc_id, i, least, hexclass, descr, text,
        CAST(sum(octet_length(encode(parts[k])) + length(prefix)) OVER w - length(prefix) AS BIGINT) AS position,
        CAST(sum(length(parts[k]) + length(prefix)) OVER w AS BIGINT) AS chars
      FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM lparts) WINDOW w AS (PARTITION BY doc_id, i ORDER BY k)""",
    "lcand": """SELECT doc_id, i, least, hexclass, descr, position, regexp_extract(hex(encode(substr(text, chars + 1))),
        '^((?:..)*?)(?:09|0A|0B|0C|0D|1C|1D|1E|1F|20|85|A0|$)', 1) AS tail FROM lcut""",
    "leaks": """SELECT doc_id, 'secret_leak' AS kind, descr AS pattern, position FROM lcand
      WHERE length(tail) // 2 >= least AND regexp_full_match(tail, hexclass)
      QUALIFY row_number() OVER (PARTITION BY doc_id, position ORDER BY i) = 1""",
}
# Number, phrase, what a text is split by, description. "disregard" overlaps itself by its last letter,
# so it is split without it.
_PHRASE_ROWS = """
    (0, 'ignore previous', 'ignore previous', 'override previous instructions'),
    (1, 'ignore all previous', 'ignore all previous', 'override ALL previous instructions'),
    (2, 'disregard', 'disregar', 'potential instruction override'),
    (3, 'forget everything', 'forget everything', 'attempt to reset context'),
    (4, 'you are now', 'you are now', 'role change attempt'), (5, 'act as', 'act as', 'role manipulation'),
    (6, 'pretend to be', 'pretend to be', 'role manipulation'), (7, 'system:', 'system:', 'system message injection'),
    (8, 'assistant:', 'assistant:', 'assistant response injection'), (9, 'user:', 'user:', 'user message injection'),
    (10, '<|', '<|', 'special token injection'), (11, '|>', '|>', 'special token injection'),
    (12, '[inst]', '[inst]', 'instruction token injection'), (13, '[/inst]', '[/inst]', 'instruction token injection'),
    (14, 'new instructions', 'new instructions', 'new instruction attempt'),
    (15, 'updated instructions', 'updated instructions', 'instruction update attempt')"""
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
INJECTIONS = {
    "ip": f"SELECT * FROM (VALUES {_PHRASE_ROWS}) t(i, phrase, head, descr)",
    "iparts": f"""SELECT doc_id, i, phrase, head, descr, {_LOWERED} AS low, string_split({_LOWERED}, head) AS parts
      FROM v_planted, ip WHERE contains({_LOWERED}, phrase)""",
    "icand": """SELECT doc_id, i, descr, phrase, low,
        CAST(sum(octet_length(encode(parts[k])) + length(head)) OVER w - length(head) AS BIGINT) AS position,
        CAST(sum(length(parts[k]) + length(head)) OVER w - length(head) AS BIGINT) AS chars
      FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM iparts) WINDOW w AS (PARTITION BY doc_id, i ORDER BY k)""",
    "injections": """SELECT doc_id, 'injection' AS kind, descr AS pattern, position FROM icand
      WHERE substr(low, chars + 1, length(phrase)) = phrase
      QUALIFY row_number() OVER (PARTITION BY doc_id, position ORDER BY i) = 1""",
}


@query("scan_leaks", oracle("SELECT * FROM leaks", "v_planted", **LEAKS))
def _(spark, sf):
    return safety.scan_leaks(spark_view(spark, sf, "v_planted"), ["doc_id"], "text")


@query("scan_injection", oracle("SELECT * FROM injections", "v_planted", **INJECTIONS))
def _(spark, sf):
    return safety.scan_injection(spark_view(spark, sf, "v_planted"), ["doc_id"], "text")


@query(
    "scan_safety",
    oracle("SELECT * FROM leaks UNION ALL SELECT * FROM injections", "v_planted", **LEAKS, **INJECTIONS),
)
def _(spark, sf):
    return safety.scan(spark_view(spark, sf, "v_planted"), ["doc_id"], "text")


@query(
    "partition_by_safety",
    oracle(
        """SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM leaks) AS accepted,
        (SELECT count(*) FROM leaks l WHERE l.doc_id = v.doc_id) AS warnings FROM v_planted v""",
        "v_planted",
        **LEAKS,
    ),
)
def _(spark, sf):
    accepted, rejected, warnings = safety.partition_by_safety(spark_view(spark, sf, "v_planted"), ["doc_id"], "text")
    counts = warnings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("warnings"))
    kept = accepted.select("doc_id", F.lit(True).alias("accepted"), F.lit(0).cast("bigint").alias("warnings"))
    return kept.unionByName(rejected.select("doc_id", F.lit(False).alias("accepted")).join(counts, "doc_id"))
