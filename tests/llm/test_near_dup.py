import random

import pytest
from cases import frame, odd_texts, words
from pyspark.sql import functions as F

from textlake.llm import near_dup
from textlake.llm.components import components


def brute(rows, least=(4, 5)):
    """rep_id, class_id and n_links of every row by comparing all pairs of different texts."""
    own = [(i, tuple((t or "").encode().split())) for i, t in rows]
    rep = {}
    for i, w in own:
        rep[w] = i if w not in rep else min([x for x in (rep[w], i) if x is not None], default=None)
    texts = [w for w in rep if w]
    sets = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} for w in texts]
    group, links = list(range(len(texts))), [0] * len(texts)
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common * least[1] >= (len(sets[a]) + len(sets[b]) - common) * least[0]:
                links[a] += 1
                links[b] += 1
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    at = {w: n for n, w in enumerate(texts)}
    first = {}
    for n, w in enumerate(texts):
        first[group[n]] = min([x for x in (first.get(group[n]), rep[w]) if x is not None], default=None)
    return sorted(
        [(i, rep[w], first[group[at[w]]], links[at[w]]) if w else (i, i, i, 0) for i, w in own], key=repr
    )


def joined(docs):
    return sorted([tuple(r) for r in near_dup.join(docs).select("doc_id", "rep_id", "class_id", "n_links").collect()], key=repr)


def near_copies(seed=6, bases=12, copies=25):
    rnd = random.Random(seed)
    out = []
    for _ in range(bases):
        base = words(rnd, rnd.randint(60, 300))
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, len(base) // 40 + 1)):
                own[rnd.randrange(len(own))] = words(rnd, 1)[0]
            out.append(" ".join(own))
    rnd.shuffle(out)
    return out


def test_all_links_are_found(spark):
    texts = near_copies()
    docs = frame(spark, texts)
    assert joined(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_prefixes_are_shortened_to_the_target(spark, monkeypatch):
    depths = []
    verified = near_dup._verified
    monkeypatch.setattr(near_dup, "_verified", lambda *a: depths.append(a[2:4]) or verified(*a))
    docs = frame(spark, near_copies(seed=8, bases=2))
    near_dup.join(docs)
    assert depths[0] == (6, 7) and depths[-1][0] <= 4 and all(a[1] == b[0] for a, b in zip(depths[1:], depths, strict=False))
    depths.clear()
    near_dup.join(docs, target=0.5)
    assert depths == [(6, 7)]


def test_a_hot_group_costs_no_other_pair_its_link(spark):
    rnd = random.Random(9)
    base = words(rnd, 400)
    hot = [" ".join([*base[:at], f"own{at}", *base[at + 1 :]]) for at in range(20, 320)]  # 44,850 pairs above 0.95
    texts = [words(rnd, 44) for _ in range(1500)]
    pairs = [" ".join(w[:n]) for w in texts for n in (44, 36)]  # 32 of 40 shingles
    docs = spark.createDataFrame(list(enumerate(hot + pairs)), "doc_id bigint, text string").repartition(8)
    links = dict(near_dup.join(docs).select("doc_id", "n_links").collect())
    assert [links[i] for i in range(len(hot) + len(pairs))] == [299] * 300 + [1] * 3000


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_CLASSES", 4)
    docs = frame(spark, near_copies(seed=7, bases=4))
    assert joined(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark):
    docs = frame(spark, [*odd_texts(), "a b c d", "a b c d e", "a b c d e f", " a  b c\td e"])
    got = near_dup.join(docs)
    assert sorted([tuple(r) for r in got.select("doc_id", "rep_id", "class_id", "n_links").collect()], key=repr) == brute(
        [(r["doc_id"], r["text"]) for r in docs.collect()]
    )
    assert got.where("kept").select("class_id").distinct().count() == got.select("class_id").distinct().count()


@pytest.mark.parametrize("texts", [[], ["", None, " "]])
def test_nothing_to_compare(spark, texts):
    docs = frame(spark, texts).where("text IS NULL OR trim(text) = ''")
    assert joined(docs) == sorted([(r[0], r[0], r[0], 0) for r in docs.select("doc_id").collect()], key=repr)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    edges += [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)]
    rnd.shuffle(edges)
    group = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: g for x, g in group.items() if x in got}
    assert set(group) - set(got) == {x for x in group if all(a == b for a, b in edges if x in (a, b))}
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).collect() == []
