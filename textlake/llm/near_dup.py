"""Near-duplicate join on shingles of words by a MinHash LSH forest.

Texts with the same words are one class, which is looked up once. A class has a signature of ``TREES`` labels of
``DEPTH`` MinHash values; the labels of one tree, sorted, are a prefix trie. Classes that share a prefix in a tree
are candidates. The join starts with whole labels and shortens the prefix until every link is found with the target's
probability: a pair of similarity s shares a prefix of d values in one of t trees with probability 1 - (1 - s^d)^t,
which is smallest at the bound, so that no pair's chance depends on what else the table holds.

Candidates are verified on their whole sets of shingles. They meet block by block: the classes that hang together by
shared prefixes are dealt over blocks of bounded size, and a task compares two blocks and gives counts and the
links that span its classes, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm import bloom
from textlake.llm.common import stored
from textlake.llm.components import components

WORDS = 5
TREES, DEPTH = 20, 6
# Similarity of a link, as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)
# Least probability to be found, for each pair by itself.
TARGET_RECALL = 0.9999
# A block holds about this many classes, and about this many shingles (8 bytes each).
BLOCK_CLASSES, BLOCK_SHINGLES = 192, 500_000

_MULTIPLIERS = np.random.default_rng(2024).integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: Column) -> Column:
    """Words between runs of ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles_of(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``WORDS`` words; a shorter text has one run of all its words."""
    words = words.view(np.uint64)
    n = len(words)
    if not n:
        return words
    run = min(n, WORDS)
    out = np.full(n - run + 1, run, np.uint64)
    for i in range(run):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - run + 1 + i])
    return np.unique(out)


def labels_of(shingles: np.ndarray) -> bytes:
    """The labels of all trees, one after the other: MinHash values of 32 bits, the first one first."""
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 4096):
        values = (shingles[i : i + 4096, None] * _MULTIPLIERS[None, :]) >> np.uint64(32)
        np.minimum(least, values.min(0), out=least)
    return least.astype(">u4").tobytes()


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node (a digest of the words in order), hashes of the text and of its words, for texts that have words."""
    of = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), of.alias("text_hash"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    node = F.substring(F.unhex(F.sha2(F.array_join("w", " "), 256)), 1, 16)
    return rows.select("doc_id", node.alias("node"), "text_hash", F.transform("w", lambda w: F.xxhash64(w)).alias("words"))


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, text_hash, number of shingles and labels of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles_of(w.values.to_numpy()) for w in batch.column("words")]
            columns = [pa.array([len(s) for s in own], pa.int64()), pa.array([labels_of(s) for s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc_id", "node", "text_hash", "shingles", "labels"])

    return _hashed(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, node binary, text_hash bigint, shingles bigint, labels binary")


def _prefix(tree: Column, depth: int) -> Column:
    return F.xxhash64(tree, F.call_function("substring", F.col("labels"), tree * (4 * DEPTH) + 1, F.lit(4 * depth)))


def _stars(nodes: DataFrame, depth: int) -> DataFrame:
    """Links (a, b) between every class and the smallest class that shares a prefix of ``depth`` values with it."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    keys = nodes.select("node", "labels", tree).select("node", _prefix(F.col("tree"), depth).alias("key"))
    shared = stored(
        keys.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "first"), "prefixes"
    )
    passed, _ = bloom.split(keys, shared.select("key"), [F.col("key")])
    return passed.join(shared, "key").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()


def _sharing(left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Which pairs of two blocks share a prefix of ``depth`` values in any tree."""
    found = np.zeros((len(left), len(right)), bool)
    if depth > DEPTH:
        return found
    for t in range(TREES):
        both = np.concatenate([left[:, t, :depth], right[:, t, :depth]])
        code = np.unique(both, axis=0, return_inverse=True)[1].ravel()
        found |= code[: len(left), None] == code[None, len(left) :]
    return found


def _verify(block: pd.DataFrame, depth: int, done: int, least: tuple[int, int]) -> pd.DataFrame:
    """Compares the classes of two blocks, or those of one with each other.

    Only pairs that share a prefix of ``depth`` values and none of ``done`` are looked at. Rows: classes with their
    numbers of links, and links that connect what is linked.
    """
    block = block.sort_values("node", ignore_index=True)
    one = block["first"].iloc[0] == block["second"].iloc[0]
    sides = [np.arange(len(block))] * 2 if one else [np.flatnonzero(block["side"] == s) for s in (0, 1)]
    labels = np.stack([np.frombuffer(b, ">u4").reshape(TREES, DEPTH) for b in block["labels"]])
    sets = [np.frombuffer(b, "<u8") for b in block["set"]]
    a, b = sides
    wanted = _sharing(labels[a], labels[b], depth) & ~_sharing(labels[a], labels[b], done)
    if one:
        wanted = np.triu(wanted, 1)
    links = np.zeros(len(block), np.int64)
    root = list(range(len(block)))
    spanning = []

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, row in zip(a, wanted, strict=True):
        others = b[np.flatnonzero(row)]
        if not len(others):
            continue
        own = sets[i]
        sizes = np.array([len(sets[j]) for j in others])
        # Too unequal in size to be similar.
        near = np.minimum(sizes, len(own)) * least[1] >= np.maximum(sizes, len(own)) * least[0]
        others, sizes = others[near], sizes[near]
        if not len(others):
            continue
        flat = np.concatenate([sets[j] for j in others])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        common = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        union = len(own) + sizes - common
        similar = common * least[1] >= union * least[0]
        links[i] += similar.sum()
        links[others[similar]] += 1
        for j in others[similar]:
            x, y = top(i), top(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                spanning.append((i, j))
    node = block["node"].tolist()
    rows = [(node[i], None, int(links[i])) for i in np.flatnonzero(links)]
    rows += [(node[i], node[j], 0) for i, j in spanning]
    return pd.DataFrame(rows, columns=["a", "b", "links"])


def _chance(similarity: float, depth: int) -> float:
    """Probability that a pair shares a prefix of ``depth`` values in any tree."""
    return 1 - (1 - similarity**depth) ** TREES


def _verified(
    docs: DataFrame, nodes: DataFrame, depth: int, done: int, least: tuple[int, int], id_col: str, text_col: str
) -> DataFrame:
    """Rows of ``_verify`` for all pairs whose longest shared prefix has ``depth`` values or more, but less than ``done``."""
    together = stored(components(_stars(nodes, depth)), "together")
    sizes = (
        together.join(nodes.select("node", "shingles"), "node")
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("m"))
    )
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("m") / BLOCK_SHINGLES)).cast("int")
    # A class is read from its first document.
    first = nodes.select("node", F.col("rep_id").alias("doc_id"), "labels")
    dealt = stored(
        together.join(sizes.select("component", blocks.alias("blocks")), "component")
        .join(first, "node")
        .select("node", "doc_id", "labels", "component", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("block")),
        "blocks",
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles_of(w.values.to_numpy()).astype("<u8").tobytes() for w in batch.column("words")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.binary())], ["doc_id", "node", "set"])

    among, _ = bloom.split(docs, dealt.select("doc_id"), [F.col(id_col)])
    read = (
        _hashed(among, id_col, text_col)
        .mapInArrow(sets, "doc_id bigint, node binary, set binary")
        .join(dealt.withColumnRenamed("doc_id", "rep_id"), "node")
        .where(F.col("doc_id").eqNullSafe(F.col("rep_id")))
        .dropDuplicates(["node"])
    )
    other = read.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = other.select(
        "component",
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
        "node",
        "labels",
        "set",
    )
    return paired.groupBy("component", "first", "second").applyInPandas(
        lambda block: _verify(block, depth, done, least), "a binary, b binary, links bigint"
    )


def join(
    docs: DataFrame, least: tuple[int, int] = LEAST, target: float = TARGET_RECALL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, text_hash, rep_id, class_id, n_links, and kept.

    rep_id is the smallest id of a document with the same words, n_links the number of other texts (each counted
    once, however many copies it has) at a similarity of at least ``least``, class_id the smallest id of the
    documents that are connected by links, and kept whether the row is that document; of different texts of a class
    under that id the one with the smallest text_hash is. text_hash is xxhash64 of the text, null as empty.

    Texts without words, null included, are similar to nothing: their class is the row itself and they are kept. A
    text of fewer than five words has one shingle. Rows that repeat with the same id and words are one document. A
    null id is smaller than none: a class has it only if no row of the class has an id. An empty table gives no
    rows; further columns are not read.
    """
    signatures = stored(signed(docs, id_col, text_col), "signatures")
    nodes = stored(
        signatures.groupBy("node").agg(
            F.min("doc_id").alias("rep_id"),
            F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("row"),
            F.first("labels").alias("labels"),
            F.first("shingles").alias("shingles"),
        ),
        "classes",
    )
    last = max((d for d in range(1, DEPTH + 1) if _chance(least[0] / least[1], d) >= target), default=1)
    found = stored(_verified(docs, nodes, DEPTH, DEPTH + 1, least, id_col, text_col), "verified")
    if last < DEPTH:
        found = found.unionByName(stored(_verified(docs, nodes, last, DEPTH, least, id_col, text_col), "verified"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    linked = components(found.where("b IS NOT NULL").select("a", "b"))
    named = linked.join(nodes.select("node", "row"), "node").groupBy("component").agg(F.min("row").alias("first"))
    classes = linked.join(named, "component").select("node", "first").join(links, "node")
    about = nodes.select("node", "rep_id", "row").join(classes, "node", "left").withColumn("first", F.coalesce("first", "row"))
    with_words = signatures.select("doc_id", "node", "text_hash").join(about, "node").select(
        "doc_id",
        "text_hash",
        "rep_id",
        F.col("first.doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("kept"),
    )
    own = F.col(id_col)
    without = docs.where(F.size(words_of(F.col(text_col))) == 0).select(
        own.alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
        own.alias("rep_id"),
        own.alias("class_id"),
        F.lit(0).cast("bigint").alias("n_links"),
        F.lit(True).alias("kept"),
    )
    return with_words.unionByName(without)
