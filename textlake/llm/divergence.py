"""Source divergence audit: how far the sources of a language use its frequent terms in other shares.

The frequent terms (those in at least so many documents of their language) are found by prefix refinement. A level
counts the documents that hold a prefix of some bytes; a prefix below the threshold is discarded with all that begins
with it, since no term is in more documents than its prefix; the others are extended by the next level, some times as
long, until only complete terms are left. A term is followed by a zero byte, which no term holds, so that a complete
term is a prefix like any other. A task counts what it reads before anything is shuffled.

Shares are compared as integers: p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import stored
from textlake.llm.terms import LETTERS, SENT_TERMS, sent, separators

_SPLIT = separators(LETTERS)
_END = b"\0"
# A task's counts go to Spark when there are this many of them; counts of known terms are arrays, which go at more.
FLUSH, FLUSH_CELLS = 400_000, 4_000_000
# A block of the pairwise sums has about so many cells (terms x sources), and at least so many terms.
CELLS, LEAST_TERMS = 1 << 16, 1 << 10


def _counted(docs: DataFrame, keys: list[str], count: Callable) -> DataFrame:
    """Sums over all rows of what ``count(lang, text, counter)`` adds to the counter of a row's keys: keys, term, n. The
    text has single spaces or more between its terms and nothing else beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[tuple, Counter] = {}

        def flushed():
            rows = [(*k, t, n) for k, c in counters.items() for t, n in c.items()]
            counters.clear()
            if rows:
                *names, terms, counts = zip(*rows, strict=True)
                columns = [*[pa.array(x, pa.string()) for x in names], pa.array(terms, pa.binary()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "term", "n"])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for *key, text in zip(*[batch.column(k).to_pylist() for k in keys], texts, strict=True):
                counter = counters.setdefault(tuple(key), Counter())
                count(key[0], text.as_py().translate(_SPLIT), counter)
                if len(counter) > FLUSH:
                    yield from flushed()
            if sum(map(len, counters.values())) > FLUSH:
                yield from flushed()
        yield from flushed()

    return _summed(docs.select(*keys, "text").mapInArrow(run, _schema(keys)), keys)


def _schema(keys: list[str]) -> str:
    return f"{', '.join(f'{k} string' for k in keys)}, term binary, n bigint"


def _summed(partial: DataFrame, keys: list[str]) -> DataFrame:
    return partial.groupBy(*keys, "term").agg(F.sum("n").alias("n"))


def _counted_known(docs: DataFrame, known) -> DataFrame:
    """lang, source, term and n of the terms of a broadcast set of each language; a task counts in one array for each
    language and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = {lang: sorted(own) for lang, own in known.value.items()}
        number = {lang: {t: i for i, t in enumerate(own)} for lang, own in terms.items()}
        column = {lang: pa.array(own, pa.binary()) for lang, own in terms.items()}
        counts: dict[tuple[str, str], np.ndarray] = {}

        def flushed():
            for (lang, source), n in counts.items():
                there = np.flatnonzero(n)
                names = [pa.array([x] * len(there), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, column[lang].take(pa.array(there)), pa.array(n[there])], ["lang", "source", "term", "n"])
            counts.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                if own := number.get(lang):
                    if (lang, source) not in counts:
                        counts[lang, source] = np.zeros(len(own), np.int64)
                    found = [i for i in map(own.get, text.as_py().translate(_SPLIT).split()) if i is not None]
                    np.add.at(counts[lang, source], found, 1)
            if sum(map(len, counts.values())) > FLUSH_CELLS:
                yield from flushed()
        yield from flushed()

    keys = ["lang", "source"]
    return _summed(docs.select(*keys, "text").mapInArrow(run, _schema(keys)), keys)


def frequent_terms(docs: DataFrame, least_docs: int = 30, first_bytes: int = 4, growth: int = 3, most_sent: int = SENT_TERMS) -> DataFrame:
    """lang and term (binary) of the terms in at least ``least_docs`` rows of their language.

    ``docs`` has lang and text without nulls. Every level reads the texts once. Its parents, the prefixes that the
    level before has kept, go to the tasks if there are at most ``most_sent`` of them, so that what hangs below
    discarded ones is not even counted; beyond that the counts are joined with their parents before they are summed.
    """
    complete, parents, short, long = [], None, 0, first_bytes
    while True:
        known = sent(parents, most_sent) if parents is not None else None
        # A term that is shorter was complete at a level before.
        longer = re.compile(rb"[^ ]{%d,}" % short).findall if short else bytes.split

        # What differs between levels is bound now: the function runs later.
        def count(lang, text, counter, known=known, longer=longer, short=short, long=long):
            terms = longer(text)
            if known:
                alive = known.value.get(lang, ())
                counter.update({t[:long] if len(t) >= long else t + _END for t in set(terms) if t[:short] in alive})
            else:
                counter.update({t[:long] if len(t) >= long else t + _END for t in terms})

        counts = _counted(docs, ["lang"], count)
        if parents is not None and known is None:
            above = parents.select("lang", F.col("term").alias("parent"))
            counts = counts.withColumn("parent", F.substring("term", 1, short)).join(above, ["lang", "parent"], "left_semi").drop("parent")
        kept = stored(counts.where(F.col("n") >= least_docs).select("lang", "term"), "prefixes")
        ended = F.substring("term", -1, 1) == F.lit(_END)
        complete.append(kept.where(ended))
        parents = kept.where(~ended)
        if parents.isEmpty():
            break
        short, long = long, growth * long
    every = complete[0]
    for level in complete[1:]:
        every = every.unionByName(level)
    return every.select("lang", F.expr("substring(term, 1, length(term) - 1)").alias("term"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """p in exact arithmetic; 0 where a language has no frequent term."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * wide(count + 5)
    return F.when(terms > 0, F.call_function("div", above, wide(total + 5 * terms)) + 1).otherwise(0).cast("bigint")


def _distances(block: pd.DataFrame) -> pd.DataFrame:
    """Sums of abs(p - q) over a block's terms for all ordered pairs of sources. Rows without a term hold a source's
    share of a term that it has not."""
    absent = block[block["term"].isna()].sort_values("source")
    sources = absent["source"].to_numpy()
    there = block[block["term"].notna()]
    row, terms = pd.factorize(there["term"])
    shares = np.tile(absent["p"].to_numpy(), (len(terms), 1))
    shares[row, pd.Index(sources).get_indexer(there["source"])] = there["p"].to_numpy()
    sums = np.array([np.abs(shares - shares[:, [i]]).sum(0) for i in range(len(sources))])
    one, other = np.nonzero(~np.eye(len(sources), dtype=bool))
    return pd.DataFrame({"lang": block["lang"].iloc[0], "source": sources[one], "item": sources[other], "value": sums[one, other]})


def audit(
    docs: DataFrame,
    least_docs: int = 30,
    top: int = 50,
    first_bytes: int = 4,
    growth: int = 3,
    most_sent: int = SENT_TERMS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language with the sum of abs(p - q) over all frequent terms (0 if there
    are none). Part ``term``: the ``top`` terms of a source that it uses more than the language does. Ranks go from 1
    by value descending, then by the item's bytes.

    Null texts, languages and sources count as empty, and the empty language or source is one like any other. Every
    row is a document, so repeated rows count as often as they come. An empty table gives no rows; a language with
    one source has no pairs. Columns other than the three named are not read, whatever their names. A text of any
    length is split in one piece; only its different terms are counted.

    The pairs of a language are its result, so their number has no bound but the sources'; a block of terms keeps
    ``LEAST_TERMS`` x sources integers in memory.
    """
    empty = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    rows = docs.select(empty(lang_col, "lang"), empty(source_col, "source"), empty(text_col, "text"))
    kept = stored(frequent_terms(rows, least_docs, first_bytes, growth, most_sent), "frequent-terms")
    if known := sent(kept, most_sent):
        counts = _counted_known(rows, known)
    else:
        counts = _counted(rows, ["lang", "source"], lambda lang, text, counter: counter.update(text.split()))
        counts = counts.join(kept, ["lang", "term"], "left_semi")
    counts = stored(counts, "term-counts")

    # Tables of a row for each source or language are written: Spark then knows how small they are, and joins the terms
    # with them without a shuffle by language.
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v"])
    groups = stored(groups, "sources")
    in_block = F.greatest(F.lit(LEAST_TERMS), F.floor(F.lit(CELLS) / F.count(F.lit(1))))
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.max("v").alias("v"), F.greatest(F.lit(1), F.ceil(F.max("v") / in_block)).cast("int").alias("blocks")
    )
    langs = stored(langs, "languages")
    groups = stored(groups.join(langs.drop("v"), "lang"), "groups")

    each = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "blocks"
    )
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(langs, "lang")
    of_lang = of_lang.select("lang", "term", _share(F.col("n"), F.col("lang_total"), F.col("v")).alias("q"))
    more = each.join(of_lang, ["lang", "term"]).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )

    absent = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", "block", "source", F.lit(None).cast("binary").alias("term"), _share(F.lit(0), F.col("total"), F.col("v")).alias("p")
    )
    dealt = each.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p")
    sums = dealt.unionByName(absent).groupBy("lang", "block").applyInPandas(_distances, "lang string, source string, item string, value bigint")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = more.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(best)
