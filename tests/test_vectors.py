import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import plan, rows
from textlake.functions import vectors as V
from textlake.operators import vectors


def test_byte_counts_of_text_and_binary(spark):
    blobs = [b"aab", b"", bytes([0, 1, 2, 255, 255]) * 40, bytes([0, 0x7F, 0x80, 0xFE, 0xFF, 0xFF, 0xC3, 0xA4]), None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "id int, b binary").coalesce(1)
    for i, counts in rows(df.select("id", V.byte_counts("b"))):
        if blobs[i] is None:
            assert counts is None
        else:
            assert counts == [blobs[i].count(bytes([k])) for k in range(256)]
    # A filter in front gives Arrow batches that do not start at the first row.
    text = spark.range(3000).select("id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("t"))
    sums = text.where("id % 7 = 3").select("id", V.byte_counts("t").alias("c"))
    for i, c in rows(sums):
        t = f"é{i}".encode()
        assert sum(c) == len(t) and c[t[-1]] == t.count(t[-1:])


def test_sparse_histogram(spark):
    df = spark.createDataFrame([(1, "aab"), (2, "")], "id int, t string")
    assert rows(vectors.byte_histogram(df, ["id"], "t")) == [(1, 97, 2), (1, 98, 1)]


@pytest.mark.parametrize("values", [[3.0, 4.0], [0.5] * 7, [0.5] * 10, [0.0] * 4, []])
def test_l2_normalize(spark, values):
    df = spark.createDataFrame([(values,)], "v array<float>")
    got = df.select(V.l2_normalize("v").alias("u")).first().u
    length = math.sqrt(sum(x * x for x in values))
    assert got == pytest.approx([x / length if length else x for x in values])


@pytest.mark.parametrize(
    "a, b, want", [([1.0, 2.0], [1.0, 2.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([0.5] * 10, [0.5] * 10, 1), ([0.0] * 3, [1.0] * 3, 0)]
)
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert df.select(V.cosine("a", "b")).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("n", [0, 1, 5, 10, 200])
@pytest.mark.parametrize("k", [5, 10])
def test_top_k_is_the_head_of_a_full_sort(spark, n, k):
    rng = random.Random(n * k)
    data = [(i, rng.choice([0.1, 0.5, rng.random()])) for i in range(n)]
    df = spark.createDataFrame(data, "id int, score double")
    want = sorted(data, key=lambda r: (-r[1], r[0]))[:k]
    got = rows(vectors.top_k(df, k, ties=["id"]))
    assert got == [(i, s, rank + 1) for rank, (i, s) in enumerate(want)]


def test_fuzzy_search_takes_top_k_before_the_filters(spark):
    texts = ["zzzz", "search text", "text search!", "quiet", ""]
    archs = ["x86_64", "aarch64", "x86_64", "x86_64", "x86_64"]
    df = spark.createDataFrame(list(zip(range(5), texts, archs)), "id int, content string, arch string")
    embedded = vectors.embed(df, "content")
    best = vectors.fuzzy_search(embedded, "search text", 3, ties=["id"])
    assert [r.id for r in best.collect()][:2] == [1, 2]
    assert [r.id for r in vectors.fuzzy_search(embedded, "search text", 2, ties=["id"], arch="x86_64").collect()] == [2]
    assert vectors.fuzzy_search(embedded, "", 3, ties=["id"]).count() == 0
    assert vectors.fuzzy_search(embedded.where("id = 4"), "a", 3).count() == 0


def test_query_from_a_table_needs_no_join(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id int, v array<float>")
    q = vectors.query_vector(df.where("id = 7"), "v")
    best = vectors.top_k(vectors.score_vectors(df, "v", q), 3, ties=["id"])
    assert [r.id for r in best.collect()][0] == 7
    text = plan(best)
    assert "Join" not in text and "CartesianProduct" not in text


def test_fetch_hits_keeps_rank_order(spark):
    table = spark.createDataFrame([(i, f"t{i}", float(i % 5)) for i in range(30)], "id int, t string, score double")
    hits = vectors.top_k(table.select("id", "score"), 4, ties=["id"])
    got = vectors.fetch_hits(hits.select("id", "rank"), table)
    assert [r.id for r in got.collect()] == [4, 9, 14, 19]
    assert "BroadcastHashJoin" in plan(got)


def test_with_and_drop_embedding(spark):
    df = spark.createDataFrame([(1, "p", [1.0]), (2, "q", None), (3, "q", [2.0])], "id int, project string, embedding array<float>")
    assert rows(vectors.with_embedding(df, project="q")) == [(3, [2.0])]
    assert vectors.drop_embedding(df).columns == ["id", "project"]


def test_unit_counts_equal_normalized_counts(spark):
    df = spark.createDataFrame([("aab",), ("",), ("é字 long text " * 9,), (None,)], "t string")
    counted = df.select(V.unit_byte_counts("t").alias("u"), V.byte_counts("t").alias("c"))
    for r in counted.select("u", V.l2_normalize("c").alias("n")).collect():
        assert r.u == (None if r.n is None else pytest.approx(r.n, abs=1e-6))


def cosines(vectors_, queries):
    out = {}
    for q, a in queries:
        for i, b in vectors_:
            if a and b and any(x and y for x, y in zip(a, b, strict=True)):
                out[q, i] = sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    return out


@pytest.mark.parametrize("least", [None, 0.21, 0.81, 0.999])
@pytest.mark.parametrize("parts", [1, 5])
def test_many_queries(spark, least, parts):
    rnd = random.Random(7)
    sparse = [[rnd.choice([0, 0, 0, 1, 2, -1]) * 1.0 for _ in range(12)] for _ in range(60)]
    held = list(enumerate([*sparse, [0.0] * 12, [1.0] + [0.0] * 11, None]))
    asked = [(f"q{i}", v) for i, v in held[::7]] + [("none", None), ("zero", [0.0] * 12)]
    table = spark.createDataFrame(held, "id int, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    got = {(r.query_id, r.id): r.score for r in vectors.score_many(table, queries, least=least, parts=parts).collect()}
    want = {k: v for k, v in cosines(held, asked).items() if least is None or v >= least - 1e-12}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_many_queries_join_by_dimension(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0])], "id int, embedding array<double>")
    queries = table.withColumnRenamed("id", "query_id")
    for least in (None, 0.5):
        p = plan(vectors.score_many(table, queries, least=least))
        assert "NestedLoop" not in p and "Cartesian" not in p


def test_a_giant_text_is_counted_in_little_room():
    """Three bytes of room for each byte of a text would be too many."""
    text = pa.array(["ab" * (10 << 20), "", "b" * 200_000, "aab"])
    tracemalloc.start()
    counts = V._byte_counts_udf(False).func(text).to_pylist()
    room = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(c[97], c[98], sum(c)) for c in counts] == [(10 << 20, 10 << 20, 20 << 20), (0, 0, 0), (0, 200_000, 200_000), (2, 1, 3)]
    assert room < 10 << 20


@pytest.mark.parametrize("least", [None, 0.5])
def test_many_scores_pass_no_shuffle(spark, least):
    """What is shuffled are the vectors in blocks; pairs leave the task that makes them."""
    table = spark.range(40).selectExpr("id", "array(1.0D, id, id % 7) AS embedding")
    scored = vectors.score_many(table, table.withColumnRenamed("id", "query_id"), least=least)
    assert "MapInArrow" in plan(scored).splitlines()[1]


@pytest.mark.parametrize(("parts", "block_rows"), [(1, 2048), (3, 8)])
def test_the_best_scores_of_each_part(spark, parts, block_rows):
    """Equal scores by id, also where the unrounded ones differ; copies, NaN and rows without a shared dimension."""
    rnd = random.Random(5)
    held = [(i, [float(rnd.randint(0, 2)) for _ in range(4)] + [0.0] * (i % 2)) for i in range(90)]
    held += [(i, [1.0, 1.0, 1.0 + i * 1e-9, 1.0]) for i in range(90, 110)] + [(110, [float("nan"), 0.0, 0.0, 1.0]), (111, [0.0] * 4)]
    table = spark.createDataFrame(held, "vec_id bigint, embedding array<double>")
    queries = table.where("vec_id % 10 = 0 AND vec_id < 110").withColumnRenamed("vec_id", "query_id")
    options = {"id_col": "vec_id", "parts": parts, "block_rows": block_rows}
    every = vectors.score_many(table, queries, **options).withColumn("score", F.round("score", 6))
    some = vectors.score_many(table, queries, **options, best=5, digits=6)
    top = lambda df: sorted(rows(vectors.top_k_by(df, "query_id", 5, ties=["vec_id"]), "query_id", "rank", "vec_id"))
    assert top(some) == top(every) and len(top(some)) >= 5 * 10
    counts = dict(rows(some.groupBy("query_id").count()))
    assert max(counts.values()) <= 5 * parts
    values = {(r.query_id, r.vec_id): r.score for r in every.collect()}
    assert all(str(values[r.query_id, r.vec_id]) == str(r.score) for r in some.collect())


def test_rounding_is_that_of_spark(spark):
    values = [0.1234565, -0.1234565, 2.5e-06, 1.5e-06, -4e-07, 0.9999995, 0.30000049999999999, float("nan"), 1.0]
    df = spark.createDataFrame([(v,) for v in values], "x double").select(F.round("x", 6).alias("x"))
    assert [str(r.x) for r in df.collect()] == [str(float(x)) for x in vectors._rounded(np.array(values), 6)]


def test_pairs_below_the_bound_are_never_made(spark):
    """A query whose weight is in one dimension is only compared with vectors that have it."""
    table = spark.createDataFrame([(i, [0.0 if i else 1.0, 1.0, 1.0]) for i in range(50)], "id int, embedding array<double>")
    queries = spark.createDataFrame([("q", [9.0, 1.0, 1.0])], "query_id string, embedding array<double>")
    assert rows(vectors.score_many(table, queries, least=0.5), "id") == [(0,)]
    assert vectors.score_many(table, queries).count() == 50


@pytest.mark.parametrize("parts", [1, 4])
def test_top_k_of_every_group(spark, parts):
    rnd = random.Random(3)
    data = [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), i, float(rnd.randint(0, 9))) for i in range(300)]
    df = spark.createDataFrame(data, "g string, id int, score double").repartition(5)
    best = vectors.top_k_by(df, "g", 4, ties=["id"], parts=parts)
    want = []
    for g in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == g), key=lambda d: (-d[2], d[1]))[:4]
        want += [(*d, n + 1) for n, d in enumerate(own)]
    assert sorted(rows(best, "g", "id", "score", "rank"), key=str) == sorted(want, key=str)
    # Every task keeps k rows of a part before anything is shuffled.
    p = plan(best)
    assert p.index("WindowGroupLimit") and p.count("Partial") >= 1
