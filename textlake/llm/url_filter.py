"""Verdicts on URLs: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A list has prefixes (a host with all its subdomains, and the start of the path) and whole canonical URLs. A URL's
candidates are its canonical form and, for every shape of prefix in the list (number of host labels, length of the
path), its own prefix of that shape. Candidates that the filter lets pass are joined with the list by their text,
which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm import bloom
from textlake.llm.common import lower_ascii

TRACKING = r"(?:utm_\w+|ref|fbclid|gclid)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading ``www.``, path without a last slash, and the query without tracking parameters.

    Scheme and fragment go. Null and texts without ``://`` have no canonical form.
    """
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, rf"(?:^|&){TRACKING}=[^&]*", ""), "^&", "")
    plain = F.concat(
        F.regexp_replace(host_of(url), r"^www\.", ""),
        F.regexp_replace(path_of(url), "/$", ""),
        F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)),
    )
    return F.when(F.instr(url, "://") > 0, plain)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def prefixes(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    """A list of (verdict, host, path) prefixes."""
    names = ("kind", "verdict", "host", "path", "rule")
    entries = [[F.lit(x).alias(n) for n, x in zip(names, ("prefix", v, h, p, f"{h}{p}"), strict=True)] for v, h, p in rows]
    return spark.range(1).select(F.inline(F.array(*[F.struct(*e) for e in entries])))


def whole(urls: Column, verdict: str) -> list[Column]:
    """Columns of a list of whole canonical URLs."""
    return [
        F.lit("whole").alias("kind"),
        F.lit(verdict).alias("verdict"),
        canonical(urls).alias("host"),
        F.lit("").alias("path"),
        F.lit(None).cast("string").alias("rule"),
    ]


def judge(pages: DataFrame, listed: DataFrame, default="allow", id_col="page_id", url_col="url", log2_words=bloom.LOG2_WORDS) -> DataFrame:
    """Host, path, rule and verdict of every row.

    ``listed`` has kind (``prefix`` or ``whole``), verdict, host, path and rule (null for entries that name none).
    Entries with a rule go before those without; then the longest host and path wins, then the longer host, then the
    verdict that sorts last (block). What no entry fits gets ``default``. Null URLs and URLs without ``://`` have
    empty host and path and fit nothing; null entries and empty lists are harmless. Rows that repeat are judged one
    by one; each different URL is looked up once, whatever the number of its rows. Further columns are not carried
    along.
    """
    entries = listed.where("host IS NOT NULL").select("kind", "verdict", "host", "path", "rule").distinct()
    shapes = (
        entries.where("kind = 'prefix'")
        .agg(F.sort_array(F.collect_set(F.struct(_labels(F.col("host")).alias("labels"), F.length("path").alias("chars")))))
        .scalar()
    )
    urls = pages.where(F.instr(url_col, "://") > 0).select(F.col(url_col).alias("url")).distinct()
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), shapes.alias("shapes"))
    fitting = F.filter("shapes", lambda s: (s["labels"] <= _labels(F.col("host"))) & (s["chars"] <= F.length("path")))
    own = F.transform(
        fitting,
        lambda s: F.struct(
            F.lit("prefix").alias("kind"),
            F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]).alias("host"),
            F.substring(F.col("path"), F.lit(1), s["chars"]).alias("path"),
        ),
    )
    itself = F.struct(F.lit("whole").alias("kind"), canonical(F.col("url")).alias("host"), F.lit("").alias("path"))
    candidates = parts.select("url", F.inline(F.concat(F.array(itself), own)))
    key = ["kind", "host", "path"]
    passed, _ = bloom.split(candidates, entries.select(*key), [F.col(c) for c in key], log2_words)
    exact = passed.join(entries.hint("shuffle_hash"), ["kind", "host", "path"])
    order = F.struct(F.col("rule").isNotNull(), F.length("host") + F.length("path"), F.length("host"), F.col("verdict"))
    best = exact.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    return rows.join(best, "url", "left").select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
