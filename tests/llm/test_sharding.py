import math
import zlib
from collections import Counter

import pytest
from cases import frame

from textlake.llm import sharding


def placed(df):
    return [r.asDict() for r in df.collect()]


def test_slots_sizes_and_checksums(spark):
    docs = frame(spark)
    tree = sharding.even_tree(2, 3, 4)
    got = placed(sharding.shard_rows(docs, tree, sharding.grown(tree)))
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == Counter(
        (i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts
    )
    by = {}
    for g in got:
        by.setdefault(g["shard"], []).append(g["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(0 <= s < 24 for s in by)
    # An id has one shard, whatever its text.
    assert len({(g["doc_id"], g["shard"]) for g in got}) == len({g["doc_id"] for g in got})


def test_empty_table(spark):
    assert placed(sharding.shard_rows(frame(spark, []), sharding.even_tree(1, 1, 2))) == []


def test_slots_over_several_chunks(spark):
    from textlake.llm.common import ranked

    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 7 as string)) AS g")
    got = ranked(rows, ["g"], ["id"], "slot", chunk_rows=100).collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append(r["slot"])
    assert sum(map(len, by.values())) == 5000
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def shards(spark, tree, n=20_000):
    return {r[0]: r[1] for r in spark.range(n).select("id", sharding.assign(sharding.F.col("id"), tree)).collect()}


def test_a_further_shard_takes_rows_only_into_itself(spark):
    tree = sharding.even_tree(2, 3, 4)
    before, after = shards(spark, tree), shards(spark, sharding.grown(tree))
    moved = [i for i in before if before[i] != after[i]]
    assert {after[i] for i in moved} == {24}
    assert abs(len(moved) - 20_000 / 25) < 5 * math.sqrt(20_000 / 25)
    assert max(Counter(before.values()).values()) < 1.3 * 20_000 / 24


def test_rows_follow_weights(spark):
    tree = [("a", "x", 0, 1.0), ("a", "x", 1, 3.0), ("b", "y", 2, 4.0), ("b", "y", 3, 0.0)]
    n = Counter(shards(spark, tree).values())
    assert abs(n[0] - 2500) < 300 and abs(n[1] - 7500) < 400 and abs(n[2] - 10_000) < 500 and n[3] == 0


def test_movement_stays_in_the_subtrees_whose_weights_change(spark):
    tree = [("a", "x", 0, 1.0), ("a", "x", 1, 1.0), ("a", "y", 2, 2.0), ("b", "z", 3, 2.0), ("b", "z", 4, 2.0)]
    swapped = [("a", "x", 0, 0.5), ("a", "x", 1, 1.5), *tree[2:]]  # the rack weighs as much as before
    before, after = shards(spark, tree), shards(spark, swapped)
    moved = {(before[i], after[i]) for i in before if before[i] != after[i]}
    assert moved == {(0, 1)}


def test_bad_trees():
    with pytest.raises(ValueError):
        sharding.assign(sharding.F.lit(1), [])
    with pytest.raises(ValueError):
        sharding.assign(sharding.F.lit(1), [("a", "x", 0, -1.0)])
