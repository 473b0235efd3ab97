"""Byte histograms, similarity scores and top-k."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import vectors as V


def byte_histogram(df: DataFrame, ids, text) -> DataFrame:
    """Sparse form (ids, byte, cnt), non-zero counts only; no shuffle."""
    counts = df.select(*ids, V.byte_counts(text).alias("counts"))
    return (
        counts.select(*ids, F.posexplode("counts").alias("byte", "cnt"))
        .where("cnt > 0")
        .select(*ids, F.col("byte").cast("bigint").alias("byte"), F.col("cnt").cast("bigint").alias("cnt"))
    )


def embed(df: DataFrame, text, out="embedding") -> DataFrame:
    """Adds the unit byte histogram of ``text`` as a dense float vector."""
    return df.withColumn(out, V.unit_byte_counts(text))


def with_embedding(df: DataFrame, vector="embedding", project=None, id_col="id") -> DataFrame:
    """(id, vector) of the rows that have one."""
    rows = df.where(F.col(vector).isNotNull())
    if project:
        rows = rows.where(F.col("project") == project)
    return rows.select(id_col, vector)


def drop_embedding(df: DataFrame, vector="embedding") -> DataFrame:
    return df.drop(vector)


def query_vector(df: DataFrame, vector) -> Column:
    """The vector of a one-row DataFrame, scaled to length 1, as a scalar subquery.

    Spark evaluates it once and binds the value as a literal, so scoring needs
    neither a join nor a driver-side value.
    """
    return df.select(V.l2_normalize(vector).alias(vector)).scalar()


def score_vectors(df: DataFrame, vector, query: Column, out="score") -> DataFrame:
    """Adds the cosine of every vector with one query vector; a narrow projection.

    The query has length 1 (or is zero and scores 0 everywhere), as a byte
    histogram has, so its norm is not worked out per row.
    """
    # Bound to a column first: a subquery may not stand inside a lambda.
    bound = df.withColumn("_query", query)
    return bound.withColumn(out, V.cosine(vector, "_query", 1.0)).drop("_query")


def top_k(df: DataFrame, k: int, score="score", ties=()) -> DataFrame:
    """The k best rows, best first, with their rank; ``ties`` makes the order total."""
    order = [F.desc(score), *[F.asc(c) for c in ties]]
    best = df.orderBy(*order).limit(k)
    # At most k rows are left, so one task can number them.
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("bigint"))


def top_k_by(df: DataFrame, group, k: int, score="score", ties=(), parts: int = 16) -> DataFrame:
    """The k best rows of every group, with their rank; ``ties`` makes the order total.

    Every task keeps at most k rows of a group before the first shuffle. That one deals a group over ``parts`` tasks, so
    that a group that most rows belong to is not brought together in one place until k rows of each part are left.
    """
    keys = [group] if isinstance(group, str) else list(group)
    order = [F.desc(score), *[F.asc(c) for c in ties]]
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(score, *ties), F.lit(parts)))
    some = dealt.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_n") <= k).drop("_n", "_part")
    return some.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)


def _units(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows scaled to length 1, as ``l2_normalize`` gives them, filled up with zeros; a null weight counts as 0."""
    flat = vectors.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), width))
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    length = np.sqrt((out * out).sum(1))
    # A vector with a null in it has no length and stays as it is.
    length[row[flat.is_null().to_numpy(zero_copy_only=False)]] = 1
    return out / np.where(length == 0, 1, length)[:, None]


def _summed(rows: pa.StructArray, width: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids in ascending order, the sum of each id's unit vectors, and the dimensions in which it has one."""
    ids = rows.field("id").dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(ids.dictionary, null_placement="at_start").to_numpy()
    place = np.argsort(order)[ids.indices.to_numpy()]
    units = _units(rows.field("vector"), width)
    total, held = np.zeros((len(order), width)), np.zeros((len(order), width), bool)
    if len(order) == len(place):
        total[place], held[place] = units, units != 0
    else:
        np.add.at(total, place, units)
        np.logical_or.at(held, place, units != 0)
    return ids.dictionary.take(pa.array(order)), total, held


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: halves of the shortest decimal form away from zero."""
    scaled = np.abs(x) * 10.0**digits
    out = np.copysign(np.floor(scaled + 0.5), x) / 10.0**digits + 0.0
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-5
    if near.any():
        values, back = np.unique(x[near], return_inverse=True)
        exact = [float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) for v in values]
        out[near] = np.array(exact)[back] + 0.0
    return out


def _best(scores: np.ndarray, shared: np.ndarray, k: int) -> np.ndarray:
    """Where the k best shared scores of every row stand, the first ones of equal scores; NaN is above all."""
    ranked = np.where(shared, np.where(np.isnan(scores), np.inf, scores), -np.inf)
    if ranked.shape[1] <= k:
        return shared
    least = -np.partition(-ranked, k - 1, axis=1)[:, k - 1 : k]
    above, equal = ranked > least, ranked == least
    return shared & (above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True))))


def score_many(
    vectors: DataFrame, queries: DataFrame, vector="embedding", id_col="id", query_id="query_id", least: float | None = None, parts: int = 32,
    best: int | None = None, digits: int | None = None, block_rows: int = 2048,
) -> DataFrame:
    """(query_id, id, score): the cosine of every query with every vector that shares a dimension with it.

    ``queries`` has ``query_id`` and ``vector``; both ids are unique. Without a shared dimension a score would be 0, and
    the pair is no row. Vectors and queries are grouped in blocks of about ``block_rows``, and a block of vectors is
    multiplied with one of queries as two matrices inside a task. Blocks of vectors are dealt over ``parts``, those of
    queries come once in each part: what is shuffled are vectors, never pairs. A task holds the queries and works on
    one pair of blocks at a time, so that its memory grows with the queries alone.

    With ``least`` (above 0) only pairs that reach it come. With ``best`` only the so many highest scores of each query
    in each part come, smaller ids first, which is enough to take as many or fewer from; ``digits`` rounds the scores
    before that.
    """

    def blocks(df: DataFrame, id_of: str, *parted) -> DataFrame:
        rows = df.where(F.col(vector).isNotNull()).select(F.col(id_of).alias("id"), F.col(vector).alias("vector"))
        n = rows.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
        dealt = rows.withColumn("_block", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(n / F.lit(block_rows)))))
        return dealt.select("_block", F.struct("id", "vector").alias("_row"), *parted)

    many = blocks(vectors, id_col, F.pmod(F.col("_block"), F.lit(parts)).cast("int").alias("_part"))
    many = many.repartition("_part").groupBy("_part", "_block").agg(F.collect_list("_row").alias("_vectors")).drop("_block")
    asked = blocks(queries, query_id).groupBy("_block").agg(F.collect_list("_row").alias("_queries"))
    asked = asked.select(F.col("_block").alias("_asked"), "_queries", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    # Blocks look small to the planner; they are not sent whole.
    pairs = many.join(asked.hint("merge"), "_part").select("_part", "_asked", "_queries", "_vectors")
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def multiplied(q: pa.StructArray, v: pa.StructArray) -> Iterator[pa.Table]:
        width = max([1, *(pc.max(x.field("vector").value_lengths()).as_py() or 0 for x in (q, v))])
        (q_ids, q_sums, q_held), (v_ids, v_sums, v_held) = _summed(q, width), _summed(v, width)
        whole = q_held.all() and v_held.all()
        step = max(1, (1 << 18) // max(1, len(v_ids)))
        for at in range(0, len(q_ids), step):
            scores = q_sums[at : at + step] @ v_sums.T
            shared = np.ones(scores.shape, bool) if whole else q_held[at : at + step].astype(np.float32) @ v_held.T.astype(np.float32) > 0
            if least is not None:
                # NaN is above all numbers, as it is for Spark.
                shared &= ~(scores < least)
            if digits is not None:
                scores = _rounded(scores, digits)
            row, column = np.nonzero(shared if best is None else _best(scores, shared, best))
            yield pa.table({query_id: q_ids.take(pa.array(row + at)), id_col: v_ids.take(pa.array(column)), "score": scores[row, column]})

    def first(found: pa.Table) -> pa.Table:
        """The best rows of each query."""
        above = pc.if_else(pc.is_nan(found["score"]), np.inf, found["score"])
        asked_by = found[query_id].combine_chunks().dictionary_encode(null_encoding="encode").indices
        keyed = pa.table({"q": asked_by, "s": above, "i": found[id_col]})
        order = pc.sort_indices(keyed, [("q", "ascending"), ("s", "descending"), ("i", "ascending")], null_placement="at_start").to_numpy()
        q = asked_by.to_numpy()[order]
        start = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], np.arange(len(q)), 0)) if len(q) else q
        return found.take(pa.array(order[np.arange(len(q)) - start < best]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], list[pa.Table]] = {}
        for batch in batches:
            for i in range(len(batch)):
                key = batch.column("_part")[i].as_py(), batch.column("_asked")[i].as_py()
                for found in multiplied(batch.column("_queries")[i].values, batch.column("_vectors")[i].values):
                    if best is None:
                        yield from found.to_batches()
                    else:
                        kept.setdefault(key, []).append(found)
                if best is not None:
                    # What is held of a block of queries is cut back whenever it has doubled.
                    tables = kept[key]
                    if sum(map(len, tables[1:])) > len(tables[0]):
                        kept[key] = [first(pa.concat_tables(tables).combine_chunks())]
        for tables in kept.values():
            yield from first(pa.concat_tables(tables).combine_chunks()).to_batches()

    return pairs.mapInArrow(run, schema)


def similarity(df: DataFrame, query: str, vector="embedding", out="score", digits=6) -> DataFrame:
    """Adds the similarity to the byte histogram of ``query``.

    It is rounded, so that the last digits of a sum make no order between equal vectors.
    """
    q = V.literal_vector(V.text_vector(query))
    return score_vectors(df, vector, q, out).withColumn(out, F.round(out, digits))


def fuzzy_search(df: DataFrame, query: str, k: int, vector="embedding", ties=(), project=None, arch=None) -> DataFrame:
    """Top k by similarity to the byte histogram of ``query``, in one project if it is named.

    Rows with a score above 0 are kept after the top k is taken, and the
    architecture filter comes last, so it can leave fewer than exist.
    """
    rows = df.where(F.col("project") == project) if project else df
    best = top_k(similarity(rows.where(F.col(vector).isNotNull()), query, vector), k, ties=ties).where("score > 0")
    return best.where(F.col("arch") == arch) if arch else best


def fuzzy_search_functions(functions: DataFrame, embeddings: DataFrame, query: str, k: int, arch=None) -> DataFrame:
    """Top k functions by the similarity of their files to ``query``.

    Each file is scored once and only (path, score) is joined to its functions. The architecture filter comes last,
    so it can leave fewer than exist.
    """
    scores = similarity(embeddings, query).select("path", "score")
    best = top_k(functions.join(scores, "path"), k, ties=("path", "line_start")).where("score > 0")
    return best.where(F.col("arch") == arch) if arch else best


def fetch_hits(hits: DataFrame, table: DataFrame, key="id") -> DataFrame:
    """Rows of ``table`` for the keys of a top-k, in rank order.

    ``hits`` comes out of a limit, so Spark knows that it is small, broadcasts
    it and reads the table once without a shuffle.
    """
    return table.join(hits, key).orderBy("rank")
