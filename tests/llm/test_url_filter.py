import random
import re

from pyspark.sql import functions as F

from textlake.llm import bloom, url_filter

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
SCHEMA = "page_id bigint, url string, html string, host string, rule string, verdict string"


def judged(spark, urls, listed, **options):
    rows = [(i, u, "x", "clash", "clash", "clash") for i, u in enumerate(urls)] + ([(None, urls[0], None, None, None, None)] if urls else [])
    got = url_filter.judge(spark.createDataFrame(rows, SCHEMA), listed, **options).collect()
    return sorted([tuple(r) for r in got], key=repr)


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def wanted(urls, rules, whole=()):
    out = []
    for i, u in [*enumerate(urls), *([(None, urls[0])] if urls else [])]:
        host, path = plain(u)
        fit = [
            (len(h + p), len(h), v, h + p)
            for v, h, p in rules
            if u is not None and "://" in u and (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        if fit:
            *_, verdict, rule = max(fit)
        else:
            rule, verdict = None, "block" if u in whole else "allow"
        out.append((i, host, path, rule, verdict))
    return sorted(out, key=repr)


ODD = [
    "http://a.example.org/es/1",
    None,
    "",
    "no scheme",
    "://",
    "http://",
    "HTTP://EXAMPLE.ORG/en/12?x=/es/",
    "http://example.org",
    "http://example.org?/es/",
    "http://example.org#/es/",
    "http://notexample.org/es/",
    "http://xexample.com/de/a",
    "http://com/fr/",
    "http://.com/de/",
    "http://É.COM/de/é",
    "a\nb://x.org/\n/c",
    "http://a.b://c.org/",
    "x://" + "a." * 2000 + "com/de/" + "p" * 5000,
    "http://example.org/en/1",
    "http://example.org/en/1",
]


def test_odd_urls(spark):
    assert judged(spark, ODD, url_filter.prefixes(spark, RULES)) == wanted(ODD, RULES)


def test_empty_table_and_empty_list(spark):
    assert judged(spark, [], url_filter.prefixes(spark, RULES)) == []
    nothing = url_filter.prefixes(spark, RULES).limit(0)
    assert judged(spark, ODD, nothing) == wanted(ODD, [])


def test_many_rules_and_a_crowded_filter(spark):
    rnd = random.Random(3)
    hosts = [".".join(rnd.choices("ab", k=rnd.randint(1, 4))) for _ in range(300)]
    paths = ["/" + "".join(rnd.choices("/xy", k=rnd.randint(0, 4))) for _ in range(300)]
    rules = [(rnd.choice(["allow", "block"]), h, p) for h, p in dict.fromkeys(zip(hosts[:60], paths, strict=False))]
    urls = [f"http://{h}{p}" for h, p in zip(hosts, paths, strict=True)]
    # A filter of two words lets nearly all pass; the join decides.
    for log2_words in (1, 10):
        assert judged(spark, urls, url_filter.prefixes(spark, rules), log2_words=log2_words) == wanted(urls, rules)


def test_canonical_urls(spark):
    urls = [
        "https://www.Site.net/a/?utm_source=feed&b=1&ref=z#top",
        "http://site.net/a?b=1",
        "http://site.net/a?ref=q",
        "http://m.site.net/a",
        "nothing",
        None,
    ]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(url_filter.canonical(F.col("url"))).collect()]
    assert got == ["site.net/a?b=1", "site.net/a?b=1", "site.net/a", "m.site.net/a", None, None]
    listed = spark.createDataFrame([(u,) for u in (urls[0], None, "nothing")], "u string").select(*url_filter.whole(F.col("u"), "block"))
    verdicts = {r[0]: r[4] for r in judged(spark, urls, listed)}
    assert [verdicts[i] for i in range(6)] == ["block", "block", "allow", "allow", "allow", "allow"]


def test_filter_passes_all_that_it_holds_and_little_else(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"))
    passed, others = bloom.split(keys, keys.where("substring(k, 2) % 2 = 0"), [F.col("k")], 12)
    n = {
        (r["held"], p): r["count"]
        for p, rows in ((True, passed), (False, others))
        for r in rows.groupBy(F.expr("substring(k, 2) % 2 = 0").alias("held")).count().collect()
    }
    assert passed.columns == others.columns == ["k"] and sum(n.values()) == 20_000
    assert (True, False) not in n and n[True, True] == 10_000 and n.get((False, True), 0) < 500
