import math
import random
import re
from collections import Counter

import pytest
from cases import frame, odd_texts

from textlake.llm import lexical_search


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, top):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, size = len(counts), sum(s for *_, s in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, s in counts:
            m = 100 - 50 + (50 * s * n) // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item, r + 1, i if there else None, -score) for r, (score, there, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def corpus(n=300, seed=2):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["Über", "x1", "世界"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 40)))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(30)] + [(n + 40, None), (n + 41, ""), (n + 42, "?! -")]
    items = [(i, " ".join(rnd.choices(words, k=12))) for i in range(12)] + [(90, docs[7][1]), (91, "nowhere"), (92, None), (93, "")]
    return docs, items


@pytest.mark.parametrize("top", [1, 5, 50])
@pytest.mark.parametrize(("bundle_items", "block_docs", "most_sent"), [(256, 4096, 1000), (4, 37, 0)])
def test_search_equals_brute_force(spark, top, bundle_items, block_docs, most_sent):
    docs, items = corpus()
    got = lexical_search.search(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
        spark.createDataFrame(items, "item_id bigint, text string"),
        top, bundle_items, block_docs, owners=(0.02, 0.1, 0.3, 1.0), most_sent=most_sent,
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, top)


def test_scores_that_cannot_come_into_the_best_are_dropped_on_the_way(spark, monkeypatch):
    """One document has the item's rare words; the others only words that most documents have."""
    docs = [(i, "common words here " + ("rare odd seldom" if i < 3 else f"filler{i}")) for i in range(200)]
    sizes = {}
    real = lexical_search.stored

    def spied(df, label, *more):
        out = real(df, label, *more)
        if label.startswith("scores"):
            sizes[label] = sum(len(r["docs"]) for r in out.collect())
        return out

    monkeypatch.setattr(lexical_search, "stored", spied)
    got = lexical_search.search(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame([(1, "rare odd seldom common words")], "item_id bigint, text string"),
        top=3, owners=(0.05, 0.5, 0.9, 1.0),
    )
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2]
    assert set(sizes) == {f"scores-{i}" for i in range(4)} and max(sizes.values()) == 3


def test_odd_rows(spark):
    texts = [*odd_texts(), "one two " * 60_000]
    docs = frame(spark, texts).selectExpr("*", "1 AS item", "2 AS block", "3 AS term", "4 AS score", "5 AS bundle", "6 AS doc")
    items = spark.createDataFrame(
        [(1, "one two", "a"), (1, "one two", "b"), (1, "feed tab", "c"), (None, "one", "d"), (2, None, "e"), (3, "世界", "f")],
        "item_id bigint, text string, doc_id string",
    )
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 50)
    got = lexical_search.search(docs, items)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert lexical_search.search(docs.limit(0), items).collect() == []
    assert lexical_search.search(docs, items.limit(0)).collect() == []
