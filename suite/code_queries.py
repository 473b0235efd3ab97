"""Function tables of sources, snippets, searches, and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import code as flags
from textlake.functions import text as tx
from textlake.functions import vectors as vec
from textlake.operators import catalog, code, vectors
from textlake.plans.index import build_index, search_all
from textlake.sources import files

from .log_queries import observations
from .text_queries import byte_scores
from .views import ORACLES, VIEWS, oracle, query, spark_view

KEYS = ["path"]


def sources(spark, sf):
    return spark_view(spark, sf, "v_src")


def functions(spark, sf):
    return code.extract_functions(sources(spark, sf), KEYS)


# One row per character with the brace depth after it; the sources are ASCII.
CODE = {
    "ch": """SELECT path, k - 1 AS pos, chars[k] AS ch FROM (
      SELECT path, chars, unnest(range(1, len(chars) + 1)) AS k
      FROM (SELECT path, string_split(content, '') AS chars FROM v_src))""",
    "walk": """SELECT path, pos, ch,
        sum(CASE ch WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS depth,
        sum(CASE WHEN ch = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS nl
      FROM ch""",
    "braces": """SELECT o.path, o.pos AS open_pos, o.depth - 1 AS level, min(c.pos) AS close_pos
      FROM walk o LEFT JOIN walk c ON c.path = o.path AND c.pos > o.pos AND c.ch = '}' AND c.depth = o.depth - 1
      WHERE o.ch = '{' GROUP BY ALL""",
    "exports": """SELECT path, position, content, CAST(k AS BIGINT) AS nth,
        parts[k + 1] AS body, array_to_string(parts[k + 1:], 'export func ') AS rest
      FROM (SELECT path, content, parts, k, CAST(sum(length(parts[k]) + 12) OVER (PARTITION BY path ORDER BY k) - 12 AS BIGINT) AS position
        FROM (SELECT path, content, parts, unnest(range(1, len(parts))) AS k
          FROM (SELECT path, content, string_split(content, 'export func ') AS parts FROM v_src)))""",
    "opened": """SELECT e.path, e.position, min(b.open_pos) AS open_pos FROM exports e
      LEFT JOIN braces b ON b.path = e.path AND b.open_pos >= e.position GROUP BY ALL""",
    "flags": """SELECT path,
        (CASE WHEN contains(content, 'f32x4') THEN 1 ELSE 0 END + CASE WHEN contains(content, 'f32x8') THEN 2 ELSE 0 END
         + CASE WHEN contains(content, 'f32x16') THEN 4 ELSE 0 END + CASE WHEN contains(content, 'i32x4') THEN 8 ELSE 0 END
         + CASE WHEN contains(content, 'i32x8') THEN 16 ELSE 0 END + CASE WHEN contains(content, 'i32x16') THEN 32 ELSE 0 END
         + CASE WHEN contains(content, 'u8x16') THEN 64 ELSE 0 END)::BIGINT AS type_mask,
        (CASE WHEN regexp_matches(content, '(^|[^A-Za-z0-9_])reduce_add\\(') THEN 1 ELSE 0 END
         + CASE WHEN regexp_matches(content, '(^|[^A-Za-z0-9_])fma\\(') THEN 2 ELSE 0 END
         + CASE WHEN regexp_matches(content, '(^|[^A-Za-z0-9_])splat\\(') THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(content, '(^|[^A-Za-z0-9_])load\\(') THEN 8 ELSE 0 END
         + CASE WHEN regexp_matches(content, '(^|[^A-Za-z0-9_])store\\(') THEN 16 ELSE 0 END
         + CASE WHEN regexp_matches(content, '(^|[^A-Za-z0-9_])select\\(') THEN 32 ELSE 0 END
         + CASE WHEN regexp_matches(content, '(^|[^A-Za-z0-9_])sqrt\\(') THEN 64 ELSE 0 END)::BIGINT AS intrinsics_mask,
        CASE WHEN contains(lower(content), 'aarch64') THEN 'aarch64' ELSE 'x86_64' END AS arch,
        len(string_split(content, 'export func ')) - 1 AS exports
      FROM v_src""",
    "fn": """SELECT e.path, trim(regexp_extract(e.body, '^[^({}\\n]*'), ' ' || chr(9) || chr(13)) AS func_name,
        e.position, pt.nl + 1 AS line_start,
        CASE WHEN p.open_pos IS NULL THEN 1
             ELSE coalesce(cl.nl, (SELECT max(nl) FROM walk w WHERE w.path = e.path)) - pt.nl + 1 END AS line_count,
        f.arch, CASE WHEN f.type_mask & 4 > 0 THEN 16 WHEN f.type_mask & 2 > 0 THEN 8
                     WHEN f.type_mask & 1 > 0 THEN 4 ELSE 0 END AS simd_width, f.type_mask, f.intrinsics_mask
      FROM exports e JOIN opened p ON p.path = e.path AND p.position = e.position
      JOIN walk pt ON pt.path = e.path AND pt.pos = e.position
      JOIN flags f ON f.path = e.path
      LEFT JOIN braces b ON b.path = e.path AND b.open_pos = p.open_pos
      LEFT JOIN walk cl ON cl.path = e.path AND cl.pos = b.close_pos
      WHERE contains(e.rest, '(')""",
}
_FN = """path, func_name, position, line_start::BIGINT AS line_start, line_count::BIGINT AS line_count, arch,
    simd_width::BIGINT AS simd_width, type_mask, intrinsics_mask"""


def code_oracle(body, **more):
    return oracle(body, "v_src", **CODE, **more)


@query("extract_functions", code_oracle(f"SELECT {_FN} FROM fn"))
def _(spark, sf):
    return functions(spark, sf)


@query("count_exports", code_oracle("SELECT path, exports::BIGINT AS exports FROM flags"))
def _(spark, sf):
    return sources(spark, sf).select("path", flags.count_exports(tx.byte_view("content")).alias("exports"))


@query("type_flags", code_oracle("SELECT path, type_mask FROM flags"))
def _(spark, sf):
    return sources(spark, sf).select("path", flags.type_flags(tx.byte_view("content")).cast("bigint").alias("type_mask"))


@query("call_flags", code_oracle("SELECT path, intrinsics_mask FROM flags"))
def _(spark, sf):
    return sources(spark, sf).select("path", flags.call_flags(tx.byte_view("content")).cast("bigint").alias("intrinsics_mask"))


@query(
    "simd_width",
    code_oracle(
        """SELECT path, (CASE WHEN type_mask & 4 > 0 THEN 16 WHEN type_mask & 2 > 0 THEN 8
        WHEN type_mask & 1 > 0 THEN 4 ELSE 0 END)::BIGINT AS simd_width FROM flags"""
    ),
)
def _(spark, sf):
    return code.file_flags(sources(spark, sf), KEYS).select("path", "simd_width")


@query("arch_tag", code_oracle("SELECT path, arch FROM flags"))
def _(spark, sf):
    return sources(spark, sf).select("path", flags.arch_tag(tx.byte_view("content")).alias("arch"))


@query("first_open_brace", code_oracle("SELECT path, position, open_pos::BIGINT AS open_position FROM opened"))
def _(spark, sf):
    return code.first_open_brace(sources(spark, sf), KEYS)


@query(
    "brace_depth",
    """WITH ch AS (
      SELECT page_id, k, chars[k] AS ch FROM (
        SELECT page_id, chars, unnest(range(1, len(chars) + 1)) AS k
        FROM (SELECT page_id, string_split(html, '') AS chars FROM pages))),
    walk AS (
      SELECT * FROM (
        SELECT page_id, ch,
          sum(octet_length(encode(ch))) OVER (PARTITION BY page_id ORDER BY k) - octet_length(encode(ch)) AS pos,
          sum(CASE ch WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k) AS depth
        FROM ch) WHERE ch IN ('{', '}'))
    SELECT o.page_id, o.pos::BIGINT AS open_position, (o.depth - 1)::BIGINT AS level, min(c.pos)::BIGINT AS close_position
    FROM walk o LEFT JOIN walk c ON c.page_id = o.page_id AND c.pos > o.pos AND c.ch = '}' AND c.depth = o.depth - 1
    WHERE o.ch = '{' GROUP BY ALL""",
)
def _(spark, sf):
    return code.brace_depth(spark_view(spark, sf, "pages"), ["page_id"], "html")


# Slices far smaller than the default, so that the given pages have several.
@query("brace_depth_sliced", ORACLES["brace_depth"])
def _(spark, sf):
    return code.brace_depth_sliced(spark_view(spark, sf, "pages"), ["page_id"], "html", slice_bytes=1024)


@query(
    "index_stats",
    code_oracle(
        """SELECT (SELECT count(*) FROM fn) AS function_count, (SELECT count(*) FROM part) AS ref_count,
        count(*) AS file_count FROM v_src"""
    ),
)
def _(spark, sf):
    return code.index_stats(functions(spark, sf), sources(spark, sf), spark_view(spark, sf, "part"))


@query("search_functions", code_oracle(f"SELECT {_FN} FROM fn WHERE contains(lower(func_name), 'second') OR contains(lower(path), 'second')"))
def _(spark, sf):
    return code.search_functions(functions(spark, sf), "SECOND")


@query(
    "search_functions_top",
    code_oracle(
        """SELECT path, func_name, line_start::BIGINT AS line_start, (SELECT count(*) FROM fn WHERE contains(path, 'proj1/')) AS total
        FROM fn WHERE contains(path, 'proj1/') ORDER BY path, line_start LIMIT 10"""
    ),
)
def _(spark, sf):
    hits = code.first_matches(code.search_functions(functions(spark, sf), "Proj1/"))
    return hits.select("path", "func_name", "line_start", "total")


@query(
    "filter_arch",
    code_oracle("SELECT path, func_name, arch FROM fn WHERE contains(func_name, 'second') AND arch = 'aarch64'"),
)
def _(spark, sf):
    hits = code.filter_arch(code.search_functions(functions(spark, sf), "second"), "aarch64")
    return hits.select("path", "func_name", "arch")


@query(
    "source_snippet",
    code_oracle(
        """SELECT f.path, f.func_name, f.line_start::BIGINT AS line_start,
          rtrim(array_to_string(string_split(s.content, chr(10))[f.line_start:f.line_start + f.line_count - 1], chr(10)),
            ' ' || chr(10)) AS snippet
        FROM fn f JOIN v_src s ON s.path = f.path"""
    ),
)
def _(spark, sf):
    return code.source_snippet(functions(spark, sf), sources(spark, sf)).select("path", "func_name", "line_start", "snippet")


QUERY_TEXT = "export func second f32x16"


def _vectors(spark, sf):
    return sources(spark, sf).select("path", vec.byte_counts("content").alias("embedding"))


def _embedded(spark, sf):
    return code.attach_embeddings(functions(spark, sf), _vectors(spark, sf))


@query(
    "attach_embeddings",
    code_oracle(
        """SELECT f.path, f.func_name, length(s.content)::BIGINT AS bytes, CAST(256 AS BIGINT) AS dim
        FROM fn f JOIN v_src s ON s.path = f.path"""
    ),
)
def _(spark, sf):
    total = F.aggregate("embedding", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return _embedded(spark, sf).select(
        "path", "func_name", total.alias("bytes"), F.size("embedding").cast("bigint").alias("dim")
    )


_FUZZY_FN = """SELECT fn.path, fn.func_name, fn.line_start::BIGINT AS line_start, fn.arch, score,
    CAST(row_number() OVER (ORDER BY score DESC, fn.path, fn.line_start) AS BIGINT) AS rank
    FROM fn JOIN scores USING (path) ORDER BY score DESC, fn.path, fn.line_start LIMIT 10"""
_SRC_SCORES = byte_scores("v_src", "path", "content", QUERY_TEXT)


@query(
    "fuzzy_search_functions",
    code_oracle("SELECT * FROM top WHERE score > 0 AND arch = 'x86_64'", **_SRC_SCORES, top=_FUZZY_FN),
)
def _(spark, sf):
    best = vectors.fuzzy_search_functions(functions(spark, sf), _vectors(spark, sf), QUERY_TEXT, 10, "x86_64")
    return best.select("path", "func_name", "line_start", "arch", "score", "rank")


_SNIPPET = """rtrim(array_to_string(string_split(s.content, chr(10))[f.line_start:f.line_start + f.line_count - 1], chr(10)),
            ' ' || chr(10))"""
_FUNCTION_HITS = f"""SELECT 'function' AS scope, rank, concat(f.path, ':', CAST(f.line_start AS STRING)) AS id, func_name AS title,
    arch AS text, simd_width::BIGINT AS simd_width, line_count::BIGINT AS line_count, total, {_SNIPPET} AS snippet
  FROM hits f JOIN v_src s ON s.path = f.path"""
_MEMORY_HITS = """SELECT 'memory' AS scope, rank, CAST(id AS STRING) AS id, type AS title, content AS text,
    CAST(NULL AS BIGINT) AS simd_width, CAST(NULL AS BIGINT) AS line_count, total, CAST(NULL AS STRING) AS snippet FROM found"""


def _found(needle):
    return f"""SELECT *, CAST(row_number() OVER (ORDER BY created_s DESC, id) AS BIGINT) AS rank, count(*) OVER () AS total
      FROM v_obs WHERE contains(content, '{needle}') ORDER BY created_s DESC, id LIMIT 5"""


@query(
    "search_all",
    oracle(
        f"{_FUNCTION_HITS} UNION ALL {_MEMORY_HITS}",
        "v_src",
        "v_obs",
        **CODE,
        hits="""SELECT *, CAST(row_number() OVER (ORDER BY path, line_start) AS BIGINT) AS rank, count(*) OVER () AS total
          FROM fn WHERE contains(lower(func_name), 'cond') OR contains(lower(path), 'cond') ORDER BY path, line_start LIMIT 10""",
        found=_found("cond"),
    ),
)
def _(spark, sf):
    return search_all(functions(spark, sf), observations(spark, sf), "cond", files=sources(spark, sf))


@query("search_all_memory", oracle(_MEMORY_HITS, "v_obs", found=_found("Repeated")))
def _(spark, sf):
    return search_all(None, observations(spark, sf), "Repeated", scope="memory")


@query(
    "search_all_unlimited",
    oracle(
        """SELECT 'memory' AS scope, CAST(NULL AS BIGINT) AS rank, CAST(id AS STRING) AS id, type AS title, content AS text,
        CAST(NULL AS BIGINT) AS simd_width, CAST(NULL AS BIGINT) AS line_count, count(*) OVER () AS total,
        CAST(NULL AS STRING) AS snippet FROM v_obs WHERE contains(content, 'Repeated')""",
        "v_obs",
    ),
)
def _(spark, sf):
    return search_all(None, observations(spark, sf), "Repeated", scope="memory", observation_limit=None)


_OBS_SCORES = {f"o_{k}": v.replace(" q)", " o_q)").replace("FROM c LEFT JOIN q", "FROM o_c LEFT JOIN o_q").replace("FROM c ", "FROM o_c ") for k, v in byte_scores("v_obs", "id", "content", QUERY_TEXT).items()}


@query(
    "search_all_fuzzy",
    oracle(
        f"""{_FUNCTION_HITS} UNION ALL {_MEMORY_HITS}""",
        "v_src",
        "v_obs",
        **CODE,
        **_SRC_SCORES,
        **_OBS_SCORES,
        hits="""SELECT fn.*, CAST(row_number() OVER (ORDER BY score DESC, fn.path, fn.line_start) AS BIGINT) AS rank,
          CAST(NULL AS BIGINT) AS total FROM fn JOIN scores USING (path) ORDER BY score DESC, fn.path, fn.line_start LIMIT 10""",
        found="""SELECT v_obs.*, CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) AS rank, CAST(NULL AS BIGINT) AS total
          FROM v_obs JOIN o_scores USING (id) ORDER BY score DESC, id LIMIT 5""",
    ),
)
def _(spark, sf):
    obs = observations(spark, sf).withColumn("embedding", vec.byte_counts("content"))
    return search_all(functions(spark, sf), obs, QUERY_TEXT, fuzzy=True, embeddings=_vectors(spark, sf), files=sources(spark, sf))


# --- catalog --------------------------------------------------------------

_DOC_LINES = """
    SELECT p_partkey, CAST(k AS BIGINT) AS line_no, lines[k] AS line FROM (
      SELECT p_partkey, lines, unnest(range(1, len(lines) + 1)) AS k
      FROM (SELECT p_partkey, string_split(text, chr(10)) AS lines FROM v_doc))
    WHERE regexp_matches(lines[k], '^[ \\t]*///') AND contains(lines[k], '->')"""
_SIGS = r"""
    SELECT p_partkey, line_no, CAST(k - 1 AS BIGINT) AS idx, names[k] AS name,
      concat(names[k], '(', trim(args[k]), ') -> ', rets[k]) AS signature, tags
    FROM (SELECT *, unnest(range(1, len(names) + 1)) AS k FROM (
      SELECT p_partkey, line_no,
        regexp_extract_all(line, '(\w+)\(([^)]*)\)\s*->\s*([A-Za-z_]\w*)', 1) AS names,
        regexp_extract_all(line, '(\w+)\(([^)]*)\)\s*->\s*([A-Za-z_]\w*)', 2) AS args,
        regexp_extract_all(line, '(\w+)\(([^)]*)\)\s*->\s*([A-Za-z_]\w*)', 3) AS rets,
        list_filter(list_transform(list_filter(regexp_extract_all(line, '\(([^()]*)\)', 1),
          lambda t: NOT contains(t, '->') AND NOT regexp_matches(t, '\d+x\d+|:\s*\w')), lambda t: trim(t)),
          lambda t: t <> '') AS tags
      FROM lines))"""


def signatures(spark, sf):
    return catalog.extract_signatures(spark_view(spark, sf, "v_doc"), ["p_partkey"], "text")


@query(
    "extract_signatures",
    oracle(
        "SELECT p_partkey, line_no, idx, name, signature, array_to_string(tags, '|') AS tags FROM s",
        "v_doc",
        lines=_DOC_LINES,
        s=_SIGS,
    ),
)
def _(spark, sf):
    return signatures(spark, sf).withColumn("tags", F.array_join("tags", "|"))


@query(
    "extract_dispatch_names",
    oracle(
        r"""SELECT DISTINCT unnest(regexp_extract_all(text, '"([a-z]\w*)"\s*(?:\||=>|if)', 1)) AS name FROM v_doc""",
        "v_doc",
    ),
)
def _(spark, sf):
    return catalog.extract_dispatch_names(spark_view(spark, sf, "v_doc"), "text")


# The longest prefix of at most the given bytes is the longest of its prefixes that fit.
def _cut(column, limit):
    return f"""CASE WHEN octet_length(encode({column})) <= {limit} THEN {column} ELSE concat((
        SELECT max(p) FROM (SELECT substr({column}, 1, n) AS p FROM range(1, {limit - 2}) t(n))
        WHERE octet_length(encode(p)) <= {limit - 3}), '...') END"""


COLLAPSE = {
    "lines": _DOC_LINES,
    "s": _SIGS,
    "sj": """SELECT name, string_agg(signature, '; ' ORDER BY r) AS j FROM (
      SELECT name, signature, min((p_partkey, line_no, idx)) AS r FROM s GROUP BY 1, 2) GROUP BY name""",
    "tj": """SELECT name, string_agg(tag, '; ' ORDER BY r) AS j FROM (
      SELECT name, tags[t] AS tag, min((p_partkey, line_no, idx, t)) AS r
      FROM (SELECT *, unnest(range(1, len(tags) + 1)) AS t FROM s) GROUP BY 1, 2) GROUP BY name""",
    "collapsed": """SELECT sj.name, 'intrinsic' AS category, sj.j AS signature,
        coalesce(tj.j, 'auto-extracted, not yet curated') AS description FROM sj LEFT JOIN tj ON tj.name = sj.name""",
}
_SHOWN = f"""SELECT sj.name, 'intrinsic' AS category, {_cut('sj.j', 127)} AS signature,
    CASE WHEN tj.j IS NULL THEN 'auto-extracted, not yet curated' ELSE {_cut('tj.j', 255)} END AS description
  FROM sj LEFT JOIN tj ON tj.name = sj.name"""
_PLACE = ["p_partkey", "line_no", "idx"]


def collapsed(spark, sf):
    return catalog.collapse_signatures(signatures(spark, sf), _PLACE)


@query("collapse_signatures", oracle("SELECT * FROM collapsed", "v_doc", **COLLAPSE))
def _(spark, sf):
    return collapsed(spark, sf)


@query("collapse_signatures_shown", oracle("SELECT * FROM shown", "v_doc", **COLLAPSE, shown=_SHOWN))
def _(spark, sf):
    return catalog.collapse_signatures(signatures(spark, sf), _PLACE, signature_bytes=127, description_bytes=255)


@query(
    "signature_rows",
    oracle("SELECT name, signature, min(p_partkey) AS first_key, count(*) OVER () AS n FROM s GROUP BY ALL", "v_doc", lines=_DOC_LINES, s=_SIGS),
)
def _(spark, sf):
    rows = catalog.signature_rows(signatures(spark, sf), _PLACE).select("name", "signature", F.col("first_seen.p_partkey").alias("first_key"))
    return rows.withColumn("n", rows.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar())


@query(
    "tag_rows",
    oracle(
        "SELECT name, tag, min(p_partkey) AS first_key FROM (SELECT name, p_partkey, unnest(tags) AS tag FROM s) GROUP BY ALL",
        "v_doc",
        lines=_DOC_LINES,
        s=_SIGS,
    ),
)
def _(spark, sf):
    return catalog.tag_rows(signatures(spark, sf), _PLACE).select("name", "tag", F.col("first_seen.p_partkey").alias("first_key"))


DISPATCHED = r"""SELECT DISTINCT unnest(regexp_extract_all(text, '"([a-z]\w*)"\s*(?:\||=>|if)', 1)) AS name FROM v_doc"""


@query(
    "undocumented_names",
    oracle(
        """SELECT name, 'intrinsic' AS category, concat(name, '(...) -> ?') AS signature, 'no doc comment' AS description
        FROM d WHERE name NOT IN (SELECT name FROM s)""",
        "v_doc",
        d=DISPATCHED,
        lines=_DOC_LINES,
        s=_SIGS,
    ),
)
def _(spark, sf):
    names = catalog.extract_dispatch_names(spark_view(spark, sf, "v_doc"), "text")
    return catalog.undocumented_names(names, signatures(spark, sf))


_CURATED = """SELECT min(p_partkey) AS ordinal, concat('cvt_', lower(p_type)) AS name, 'type' AS category,
    max(p_brand) AS signature, concat('made of ', max(p_name)) AS description FROM part GROUP BY p_type"""


def _curated(spark, sf):
    return (
        spark_view(spark, sf, "part")
        .groupBy(F.concat(F.lit("cvt_"), F.lower("p_type")).alias("name"))
        .agg(
            F.min("p_partkey").alias("ordinal"),
            F.lit("type").alias("category"),
            F.max("p_brand").alias("signature"),
            F.concat(F.lit("made of "), F.max("p_name")).alias("description"),
        )
    )


_MERGED = """SELECT 0::BIGINT AS origin, ordinal, name, category, signature, description FROM cur
    UNION ALL SELECT 1, NULL, name, category, signature, description FROM collapsed
    WHERE name NOT IN (SELECT name FROM cur)"""


def _merged(spark, sf):
    return catalog.merge_catalog(_curated(spark, sf), collapsed(spark, sf))


@query("merge_catalog", oracle("SELECT * FROM m", "v_doc", **COLLAPSE, cur=_CURATED, m=_MERGED))
def _(spark, sf):
    return _merged(spark, sf)


@query(
    "lookup_reference_exact",
    oracle("SELECT * FROM m WHERE lower(name) = 'large_ring'", "v_doc", **COLLAPSE, cur=_CURATED, m=_MERGED),
)
def _(spark, sf):
    return catalog.lookup_reference(_merged(spark, sf), "Large_Ring")


@query(
    "lookup_reference",
    oracle(
        """SELECT * FROM m WHERE contains(lower(name), 'ring') OR contains(lower(description), 'ring')
        ORDER BY origin, ordinal NULLS FIRST, name LIMIT 5""",
        "v_doc",
        **COLLAPSE,
        cur=_CURATED,
        m=_MERGED,
    ),
)
def _(spark, sf):
    return catalog.lookup_reference(_merged(spark, sf), "RING")


@query(
    "catalog_entries",
    """SELECT p_partkey, 0::BIGINT AS ordinal, p_name AS name, 'type' AS category, p_brand AS signature,
      concat('a ->', p_type) AS description FROM part
    UNION ALL SELECT p_partkey, 1, lower(p_type), NULL, NULL, NULL FROM part""",
)
def _(spark, sf):
    return files.catalog_entries(spark_view(spark, sf, "v_catalog"), ["p_partkey"], "text")


@query(
    "distinct_first_seen",
    "SELECT p_name, min(p_partkey) AS first_seen FROM part GROUP BY p_name",
)
def _(spark, sf):
    return catalog.distinct_first_seen(spark_view(spark, sf, "part"), "p_name", ["p_partkey"])


# A tree of three overlapping roots: all sources, those of two projects, and half of one of these.
_ROOTED = """SELECT 0 AS root_no, path, content FROM v_src
    UNION ALL SELECT 1, path, content FROM v_src WHERE path LIKE 'proj1/%' OR path LIKE 'proj2/%'
    UNION ALL SELECT 2, path, content FROM v_src WHERE path LIKE 'proj2/%' AND length(path) % 2 = 0"""


@query(
    "build_index",
    code_oracle(
        """SELECT (SELECT count(*) FROM fn JOIN rooted USING (path)) AS functions,
        (SELECT count(DISTINCT path) FROM rooted) AS embeddings, (SELECT sum(length(content)) FROM v_src)::BIGINT AS bytes,
        (SELECT count(DISTINCT path) FROM rooted) AS unit_vectors, (SELECT count(*) FROM m) AS catalog""",
        rooted=_ROOTED,
        v_doc=VIEWS["v_doc"],
        **COLLAPSE,
        d=DISPATCHED,
        cur=_CURATED,
        m="""SELECT name FROM cur UNION SELECT name FROM collapsed UNION SELECT name FROM d""",
    ),
)
def _(spark, sf):
    files_of = spark.sql(_ROOTED.replace("v_src", "{v_src}"), v_src=sources(spark, sf))
    docs = spark_view(spark, sf, "v_doc").select(F.col("p_partkey").cast("string").alias("path"), "text")
    fns, vectors_of, cat = build_index(files_of, _curated(spark, sf), docs, docs)
    norms = vectors_of.join(sources(spark, sf).select("path", F.octet_length("content").alias("n")).hint("merge"), "path")
    one = lambda df, c, name: df.groupBy().agg(c.alias("x")).scalar().alias(name)
    return spark.range(1).select(
        one(fns, F.count(F.lit(1)), "functions"),
        one(vectors_of, F.count(F.lit(1)), "embeddings"),
        one(norms, F.sum("n"), "bytes"),
        one(vectors_of, F.count_if(F.abs(vec.norm("embedding") - 1) < 1e-5), "unit_vectors"),
        one(cat, F.count(F.lit(1)), "catalog"),
    )


@query(
    "source_paths",
    oracle(
        """SELECT p_partkey, ends_with(below, '.ea') AND p_partkey % 9 NOT IN (0, 3, 5, 8) AS is_source FROM v_paths""",
        "v_paths",
    ),
)
def _(spark, sf):
    return spark_view(spark, sf, "v_paths").select("p_partkey", files.is_source(F.col("below")).alias("is_source"))
