"""Ranked lexical search by pipelined term partitioning.

The terms of all items are dealt over owners by how many documents hold them, rare terms first. Items travel in
bundles from owner to owner; a bundle carries, for every block of documents, the sparse scores that its items have
gathered so far. At an owner it meets the owner's postings of the block (a cogroup), adds their contributions, which
are integers, and goes on. Before the next owner a score is dropped if all that can still be added does not lift it
to the item's fiftieth best score so far: that is exact, since no contribution is negative. Rare terms come first, so
that scores are few and bounds high when the frequent terms are met.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import stored
from textlake.llm.terms import DIGITS, LETTERS, SENT_TERMS, sent, separators

_SPLIT = separators(LETTERS + DIGITS)
# An owner's terms are in more than the share before and at most this share of the documents.
OWNERS = (0.001, 0.01, 0.1, 1.0)
# A bundle's scores over a block are one array of at most 256 x 4,096 integers.
BUNDLE_ITEMS, BLOCK_DOCS = 256, 4096


def _split_terms(texts: DataFrame, keys: str, known=None) -> DataFrame:
    """The columns ``keys`` of every row with n (its terms with repeats), words (its different terms) and times; with
    ``known``, words only has terms of that set. A null text has no terms."""
    names = [c.split()[0] for c in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, words, times, ends = [], [], [], [0]
            held = known and known.value.get(None, set())
            for text in batch.column("text").cast(pa.binary()):
                terms = (text.as_py() or b"").translate(_SPLIT).split()
                found = Counter(terms if held is None else filter(held.__contains__, terms))
                sizes.append(len(terms))
                words += found.keys()
                times += found.values()
                ends.append(len(words))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in (pa.array(words, pa.binary()), pa.array(times, pa.int64()))]
            columns = [*[batch.column(c) for c in names], pa.array(sizes, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n", "words", "times"])

    return texts.select(*names, "text").mapInArrow(run, f"{keys}, n bigint, words array<binary>, times array<bigint>")


def _visit(left: pa.Table, right: pa.Table) -> pa.Table:
    """A bundle's items and their scores over a block meet the block's postings of one owner.

    left: item, terms (its terms that this owner has), bound (what a score has to reach), docs and scores; right: term,
    doc and value. Gives block, item, docs and scores.
    """
    block = (left if left.num_rows else right)["block"][0].as_py()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(left["docs"]).to_numpy(zero_copy_only=False))]).astype(np.int64)
    old_docs, old_scores = (pc.list_flatten(left[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("docs", "scores"))
    term, doc, value = (right[c].to_numpy().astype(np.int64) for c in ("term", "doc", "value"))
    docs = np.unique(np.concatenate([old_docs, doc]))
    order = np.argsort(term, kind="stable")
    term, place, value = term[order], np.searchsorted(docs, doc)[order], value[order]
    old_places = np.searchsorted(docs, old_docs)
    out: list[tuple] = []
    for i, (item, terms, bound) in enumerate(zip(*(left[c].to_pylist() for c in ("item", "terms", "bound")), strict=True)):
        scores = np.zeros(len(docs), np.int64)
        own = slice(ends[i], ends[i + 1])
        scores[old_places[own]] = old_scores[own]  # a document is there once
        first, last = np.searchsorted(term, terms, "left"), np.searchsorted(term, terms, "right")
        for a, b in zip(first, last, strict=True):
            scores[place[a:b]] += value[a:b]  # and once among a term's postings
        stay = np.flatnonzero((scores > 0) & (scores >= bound))
        if len(stay):
            out.append((block, item, docs[stay], scores[stay]))
    return pa.table(
        {
            "block": pa.array([r[0] for r in out], pa.int64()),
            "item": pa.array([r[1] for r in out], pa.int64()),
            "docs": pa.array([r[2] for r in out], pa.list_(pa.int64())),
            "scores": pa.array([r[3] for r in out], pa.list_(pa.int64())),
        }
    )


_SCORES = "block bigint, item bigint, docs array<bigint>, scores array<bigint>"


def _least_scores(scores: DataFrame, top: int) -> DataFrame:
    """item and least: its ``top``-th best score so far, for items that have as many."""
    best = scores.select("item", F.explode(F.slice(F.sort_array("scores", False), 1, top)).alias("score"))
    by = Window.partitionBy("item").orderBy(F.desc("score"))
    return best.withColumn("r", F.row_number().over(by)).where(F.col("r") <= top).where(F.col("r") == top).select("item", F.col("score").alias("least"))


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = 50,
    bundle_items: int = BUNDLE_ITEMS,
    block_docs: int = BLOCK_DOCS,
    owners: tuple[float, ...] = OWNERS,
    most_sent: int = SENT_TERMS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item with the highest scores above 0.

    Equal scores are ordered by doc_id, a null id first. Null and empty texts have no terms: such documents count
    nowhere and such items have no rows; neither have items whose terms no document holds. Rows of documents that
    repeat are documents of their own, and each can be found. Item rows that repeat word for word are one item; other
    texts under the same id are items of their own, ranked apart. Empty tables give no rows. Columns other than the
    named ones are not read, whatever their names. A document's terms are counted in one piece, however long it is.

    Only terms of the items are kept of a document. No group grows with a key: a bundle meets a block of about
    ``block_docs`` documents, dealt by a hash, whatever its terms. ``most_sent`` bounds the item terms that tasks hold
    to leave out others early; beyond it the join with the item terms does that alone.
    """
    spark = docs.sparkSession
    texts = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    wanted = stored(
        _split_terms(texts.withColumn("item", F.monotonically_increasing_id()), "item bigint, item_id bigint").where("n > 0"), "items"
    )
    item_words = wanted.select("item", F.explode("words").alias("word"))
    vocabulary = stored(item_words.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "item-terms")
    known = sent(vocabulary.select("word"), most_sent)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("doc", F.monotonically_increasing_id())
    # The numbers of rows hold from here on, since the table is written.
    counted = stored(_split_terms(rows, "doc bigint, doc_id bigint", known).where("n > 0"), "counted")
    size = counted.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = size["docs"], max(1, size["terms"])

    m = F.expr(f"100 - 50 + (50 * n * {n_docs}L) div {n_terms}L")
    held = (
        counted.select("doc", m.alias("m"), F.explode(F.arrays_zip("words", "times")).alias("w"))
        .select("doc", F.col("w.words").alias("word"), F.expr("(1000000000L * w.times) div (1000 * w.times + 20 * m)").alias("part"))
        .join(vocabulary, "word")
    )
    df = F.col("df")
    weight = F.floor(F.lit(1000) * F.ln(F.lit(2.0 * n_docs + 2) / (F.lit(2) * df + 1).cast("double"))).cast("bigint")
    owner = F.lit(len(owners) - 1)
    for i, share in reversed(list(enumerate(owners[:-1]))):
        owner = F.when(df <= share * n_docs, i).otherwise(owner)
    terms = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("part").alias("most"))
    terms = stored(terms.select("term", weight.alias("weight"), (weight * F.col("most")).alias("most"), owner.alias("owner")).where("weight > 0"), "weights")

    blocks = max(1, math.ceil(n_docs / block_docs))
    block = F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("bigint").alias("block")
    postings = held.join(terms, "term").select("owner", block, "term", "doc", (F.col("weight") * F.col("part")).alias("value"))
    postings = stored(postings, "postings")

    bundles_of = max(1, math.ceil(wanted.count() / bundle_items))
    bundle = F.pmod(F.xxhash64("item"), F.lit(bundles_of)).cast("bigint")
    item_terms = stored(
        item_words.join(vocabulary, "word").join(terms, "term").select("item", bundle.alias("bundle"), "term", "owner", "most"), "item-weights"
    )
    scores = spark.range(0).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _SCORES.split(", ")])
    for at in range(len(owners)):
        # What the owners after this one can add to an item's score at most.
        plan = item_terms.groupBy("item", "bundle").agg(
            F.collect_list(F.when(F.col("owner") == at, F.col("term"))).alias("terms"),
            F.sum(F.when(F.col("owner") > at, F.col("most")).otherwise(0)).alias("rest"),
            F.sum(F.when(F.col("owner") >= at, F.col("most")).otherwise(0)).alias("ahead"),
        )
        plan = plan.join(_least_scores(scores, top), "item", "left").na.fill(0, ["least"])
        plan = plan.withColumn("bound", F.col("least") - F.col("rest"))
        routes = item_terms.where(F.col("owner") == at).select("term", "bundle").distinct()
        arrived = postings.where(F.col("owner") == at).join(routes, "term").select("bundle", "block", "term", "doc", "value")
        # Scores that can't come into the best any more stay behind before anything is shuffled.
        carried = scores.join(plan.select("item", (F.col("least") - F.col("ahead")).alias("reach")), "item").withColumn(
            "kept", F.filter(F.arrays_zip("docs", "scores"), lambda x: x["scores"] >= F.col("reach"))
        )
        carried = carried.select("item", "block", F.col("kept.docs").alias("docs"), F.col("kept.scores").alias("scores"))
        bundles = (
            plan.select("bundle", "item", "terms", "bound", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
            .join(carried, ["item", "block"], "left")
            .select("bundle", "block", "item", "terms", "bound", *[F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("docs", "scores")])
        )
        # Both sides have the bundle out of one table: the columns of one side are named anew.
        met = bundles.toDF(*bundles.columns).groupBy("bundle", "block").cogroup(arrived.groupBy("bundle", "block"))
        scores = stored(met.applyInArrow(_visit, _SCORES), f"scores-{at}")

    least = _least_scores(scores, top)
    last = scores.join(least, "item", "left").select("item", F.explode(F.arrays_zip("docs", "scores")).alias("s"), F.coalesce("least", F.lit(0)).alias("least"))
    last = last.where("s.scores >= least").select("item", F.col("s.docs").alias("doc"), F.col("s.scores").alias("score"))
    found = last.join(counted.select("doc", "doc_id"), "doc").join(wanted.select("item", "item_id"), "item")
    by = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id", "doc")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
