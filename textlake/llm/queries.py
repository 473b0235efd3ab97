"""Queries of this subpackage over the given tables, with an SQL text where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from textlake.llm import (
    divergence,
    exact_dedup,
    html_extract,
    lexical_search,
    license_scan,
    line_dedup,
    near_dup,
    packing,
    personal_data,
    quality,
    sentence_pieces,
    sharding,
    url_filter,
)
from textlake.llm.common import benchmark, documents, labels, pages, ready, stored


def word_tokenizer() -> str:
    """The vocabulary that op1 uses, a file of the package of public tokenizers."""
    return public_tokenizers.path("word_bpe_49k.json")


def piece_model() -> str:
    """The model that op7 uses."""
    return public_tokenizers.path("piece_bpe_32k.model")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function and its SQL text."""

    def register(fn):
        def run(spark, sf_dir):
            ready(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op9_hash_tree_shards")
def op9(spark, sf_dir):
    tree = sharding.even_tree(regions=2, racks=3, shards=4)
    placed = sharding.shard_rows(documents(spark, sf_dir), tree, sharding.grown(tree))
    return placed.withColumn("law", F.lit("key"))


@query(
    "op4_streaming_exact_dedup",
    r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n""",
)
def op4(spark, sf_dir):
    marked = exact_dedup.mark_copies_of_table(spark, sf_dir)
    return marked.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest", "keep_file", "keep_row")


# The rules of op2, and the hosts that its block list names.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
SPAM_HOSTS = ["cheap-pills.example.com", "spam-farm.example.org"]


@query(
    "op2_bloom_url_filter",
    r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
       ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (SELECT page_id, url, row_number() OVER () AS n,
        CASE WHEN url LIKE '%://%' THEN
          translate(split_part(split_part(split_part(substr(url, instr(url, '://') + 3), '/', 1), '?', 1), '#', 1),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN url LIKE '%://%' THEN split_part(split_part(substr(url, instr(url, '://') + 3), '?', 1), '#', 1)
          ELSE '' END AS rest,
        CASE WHEN url LIKE '%?%' THEN split_part(substr(split_part(url, '#', 1), instr(url, '?') + 1), '#', 1) ELSE '' END AS q
      FROM pages),
h AS (SELECT *, substr(rest, length(host) + 1) AS path FROM p),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') ||
        CASE WHEN k = '' THEN '' ELSE '?' || k END AS canonical
      FROM (SELECT *, regexp_replace(regexp_replace(q, '(?:^|&)(?:utm_\w+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS k FROM h)),
fit AS (SELECT c.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
          arg_max(r.verdict, length(r.host || r.path)) AS verdict
        FROM c JOIN rules r ON (c.host = r.host OR c.host LIKE '%.' || r.host) AND starts_with(c.path, r.path) GROUP BY c.n)
SELECT page_id, c.host, c.path, fit.rule,
       coalesce(fit.verdict, CASE WHEN host IN ('cheap-pills.example.com', 'spam-farm.example.org')
           OR host LIKE '%.cheap-pills.example.com' OR host LIKE '%.spam-farm.example.org'
           OR (url LIKE '%://%' AND canonical IN (SELECT canonical FROM c WHERE page_id % 50 = 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit USING (n)""",
)
def op2(spark, sf_dir):
    """Judges all pages by the rules, a list of hosts, and the canonical URLs of every fiftieth page as listed ones."""
    rows = pages(spark, sf_dir)
    rules = url_filter.prefixes(spark, URL_RULES)
    hosts = url_filter.prefixes(spark, [("block", h, "") for h in SPAM_HOSTS]).withColumn("rule", F.lit(None).cast("string"))
    seen = rows.where("page_id % 50 = 0").select(*url_filter.whole(F.col("url"), "block"))
    return url_filter.judge(rows, rules.unionByName(hosts).unionByName(seen))


@query("op6_license_scan")
def op6(spark, sf_dir):
    return license_scan.scan(documents(spark, sf_dir))


@query("op8_site_style_tree")
def op8(spark, sf_dir):
    found = html_extract.extract(pages(spark, sf_dir))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))


@query("op10_isolation_forest")
def op10(spark, sf_dir):
    measured = stored(quality.measure(documents(spark, sf_dir)), "statistics")
    model = quality.fit(measured, quality.labelled(labels(spark, sf_dir)))
    return quality.judge(measured, model)


@query("op1_cutting_stock_packing")
def op1(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), word_tokenizer(), payload="crc32")


@query(
    "op5_deletion_neighbourhood_lines",
    r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
l AS (SELECT doc_id, n - 1 AS line, doc_id * 10000000 + n - 1 AS place, trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS w
      FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS n FROM parts)),
d AS (SELECT w, min(place) AS place, string_split(w, ' ') AS ws FROM l WHERE w <> '' GROUP BY w),
v AS (SELECT place, 0 AS i, w AS variant FROM d WHERE len(ws) >= 10
      UNION ALL SELECT place, i, array_to_string(ws[1:i - 1], ' ') || ' ' || array_to_string(ws[i + 1:], ' ')
      FROM (SELECT place, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) >= 10)),
u AS (SELECT place, i, md5(trim(variant, ' ')) AS variant FROM v),
g AS (SELECT variant, i, min(place) AS first FROM u GROUP BY ALL),
k AS (SELECT variant, min(first) FILTER (WHERE i = 0) AS whole, min(first) FILTER (WHERE i > 0) AS cut FROM g GROUP BY variant),
m AS (SELECT u.place, min(CASE WHEN u.i = 0 THEN k.cut ELSE least(g.first, k.whole) END) AS first
      FROM u JOIN k USING (variant) JOIN g USING (variant, i) GROUP BY u.place),
f AS (SELECT d.w, least(d.place, m.first) AS first FROM d LEFT JOIN m USING (place))
SELECT l.doc_id, l.line, f.first // 10000000 AS keep_doc_id, f.first % 10000000 AS keep_line, f.first = l.place AS kept
FROM l JOIN f USING (w)""",
)
def op5(spark, sf_dir):
    marked = line_dedup.mark_lines(documents(spark, sf_dir))
    return marked.select(
        "place.doc_id",
        "place.line",
        F.col("first.doc_id").alias("keep_doc_id"),
        F.col("first.line").alias("keep_line"),
        "kept",
    )


@query(
    "op3_lsh_forest_join",
    r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT w, min(doc_id) AS rep FROM t WHERE len(w) > 0 GROUP BY w),
s AS (SELECT DISTINCT rep, array_to_string(w[i:i + 4], ' ') AS run
      FROM (SELECT rep, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM c)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k FROM s a JOIN s b ON a.run = b.run AND a.rep < b.rep GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reached AS (SELECT DISTINCT a AS node, a AS other FROM links
            UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other),
class AS (SELECT node AS rep, min(other) AS class_id FROM reached GROUP BY node),
degree AS (SELECT a AS rep, count(*) AS n_links FROM links GROUP BY a)
SELECT t.doc_id, coalesce(c.rep, t.doc_id) AS rep_id, coalesce(class.class_id, c.rep, t.doc_id) AS class_id,
       coalesce(degree.n_links, 0) AS n_links, t.doc_id = coalesce(class.class_id, c.rep, t.doc_id) AS kept
FROM t LEFT JOIN c ON t.w = c.w LEFT JOIN class ON class.rep = c.rep LEFT JOIN degree ON degree.rep = c.rep""",
)
def op3(spark, sf_dir):
    return near_dup.join(documents(spark, sf_dir)).drop("text_hash")


@query("op7_max_plus_pieces")
def op7(spark, sf_dir):
    encoded = sentence_pieces.encode(documents(spark, sf_dir), piece_model())
    return encoded.withColumn("n_ids", F.size("ids").cast("bigint"))


@query("op11_skip_chain_personal_data")
def op11(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return personal_data.find(docs, personal_data.fit(docs)).drop("added")


@query(
    "op12_prefix_refined_divergence",
    r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT d, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT d) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, sum(coalesce(n, 0))::HUGEINT AS total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, 1 + 1000000000 * (coalesce(n, 0)::HUGEINT + 5) // (total + 5 * v) AS p, coalesce(n, 0) AS n
      FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + 1000000000 * (sum(n) + 5)::HUGEINT // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v))::HUGEINT AS q
      FROM p JOIN v USING (lang) GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
more AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM more))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
)
def op12(spark, sf_dir):
    return divergence.audit(documents(spark, sf_dir))


@query(
    "op13_pipelined_lexical_search",
    r"""
WITH w AS (SELECT row_number() OVER () AS d, doc_id,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT d, doc_id, len(terms)::BIGINT AS n, terms FROM w WHERE len(terms) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM d),
m AS (SELECT d, doc_id, 100 - 50 + (50 * n * docs) // l AS m FROM d, c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
x AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c),
s AS (SELECT q.item_id, d, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN x USING (term) JOIN m USING (d) GROUP BY q.item_id, d),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
)
def op13(spark, sf_dir):
    return lexical_search.search(documents(spark, sf_dir), benchmark(spark, sf_dir))
