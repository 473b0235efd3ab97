import random
import re
from collections import Counter

import numpy as np
from cases import frame, odd_texts, words

from textlake.llm import quality


def counts(text):
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_counts():
    rnd = random.Random(2)
    texts = [*odd_texts(), "a a a", "a a a a", "a b a b a b", "x y z x y z", "# * | <\n<\n<", "\x1c\x85 a b\x00c"]
    texts += [" ".join(rnd.choices("abc", k=n)) + "\n" * (n % 3) for n in range(60)]
    for t in texts:
        assert quality.statistics_of(t)[0] == counts(t)


def good(rnd):
    return "\n".join(" ".join(words(rnd, rnd.randint(8, 20))) + "." for _ in range(rnd.randint(8, 30)))


def bad(rnd):
    kind = rnd.randint(0, 2)
    if kind == 0:
        return " ".join(w + "###" for w in words(rnd, 200))
    if kind == 1:
        return "\n".join(" | ".join(words(rnd, 12)) for _ in range(15))
    return " ".join(w.upper() + "!!" for w in words(rnd, 200))


def labelled_rows(spark, n=600, seed=5):
    rnd = random.Random(seed)
    kinds = [rnd.random() < 0.85 for _ in range(n)]
    docs = spark.createDataFrame([(i, good(rnd) if k else bad(rnd)) for i, k in enumerate(kinds)], "doc_id bigint, text string")
    return docs.repartition(4), kinds


def test_held_out_documents(spark):
    docs, kinds = labelled_rows(spark)
    rows = [(i, int(k), 0) for i, k in enumerate(kinds) if i % 2] + [(None, 1, 0), (3, None, 0), (10**9, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    measured = quality.measure(docs)
    model = quality.fit(measured, quality.labelled(labels))
    got = {r["doc_id"]: r for r in quality.judge(measured, model).collect()}
    held = [i for i in got if not i % 2]
    assert not [i for i in held if kinds[i] and not got[i]["kept"]]
    assert sum(got[i]["kept"] for i in held if not kinds[i]) <= 1
    kept = {r["doc_id"] for r in quality.keep(docs, model).collect()}
    assert kept == {i for i in got if got[i]["kept"]}
    # The same again: nothing hangs on the order of rows.
    again = quality.fit(measured.repartition(7), quality.labelled(labels.repartition(5)))
    assert again.threshold == model.threshold


def test_odd_rows_and_no_labels(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    measured = quality.measure(docs)
    model = quality.fit(measured, quality.labelled(none))
    assert model.forest is None
    got = quality.judge(measured, model).collect()
    want = []
    for r in docs.collect():
        c = counts(r["text"])
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((r["doc_id"], *c, failed, not failed))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted([tuple(r[c] for c in columns) for r in got], key=repr) == sorted(want, key=repr)
    kept = quality.keep(docs, model)
    assert kept.schema == docs.schema
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == sorted([w[0] for w in want if w[-1]], key=repr)


def test_empty_table(spark):
    docs = frame(spark, [])
    model = quality.Model(None, 1.0)
    assert quality.judge(quality.measure(docs), model).collect() == []
    assert quality.keep(docs, model).collect() == []


def test_far_points_have_short_paths():
    random_points = np.random.default_rng(1).uniform(size=(400, 3))
    forest = quality.grow(random_points)
    scores = forest.scores(np.array([[0.5, 0.5, 0.5], [1.9, 1.9, 1.9], [0.5, 1.9, 0.5]]))
    assert scores[0] < scores[2] < scores[1]
    same = quality.grow(np.ones((50, 2)))
    assert np.ptp(same.scores(np.ones((2, 2)))) == 0 and same.scores(np.array([[1.9, 1.0]]))[0] > same.scores(np.ones((1, 2)))[0]


def test_two_features_together_make_the_anomaly():
    """Good points have two features that go together; a bad one has a small value of one and a large one of the other,
    each of them well inside the range of the good points."""
    rnd = np.random.default_rng(4)
    n = 3000
    x = np.full((n, len(quality.FEATURES)), 0.5)
    good = rnd.uniform(size=n) < 0.9
    x[:, 0] = np.where(good, rnd.uniform(size=n), rnd.uniform(0.05, 0.2, n))
    x[:, 1] = np.where(good, x[:, 0], 1 - x[:, 0])
    held = np.arange(n) % 3 == 0
    model = quality.fitted(x[~held], good[~held])
    low, high = x[good].min(0), x[good].max(0)
    assert ((x[~good] >= low) & (x[~good] <= high)).all() and 0 < model.threshold < 1
    refused = model.scores(x[held]) > model.threshold
    # No rule on one feature could refuse any of them.
    assert refused[~good[held]].mean() > 0.5 and refused[good[held]].mean() < 0.02


def test_verdicts_come_from_the_forest(spark):
    """On the given labels: the threshold is a path score, held-out documents are told apart, and another forest gives
    other verdicts."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    measured = quality.measure(docs).where(~quality.base_failed()).join(labels.select("doc_id", "quality"), "doc_id").orderBy("doc_id").collect()
    x = np.array([r["features"] for r in measured])
    good = np.array([r["quality"] == 1 for r in measured])
    held = np.arange(len(x)) % 2 == 0
    model = quality.fitted(x[~held], good[~held])
    assert 0 < model.threshold < 1
    refused = model.scores(x[held]) > model.threshold
    assert refused[~good[held]].mean() >= 0.9 and refused[good[held]].mean() <= 0.01
    blind = quality.Model(quality.grow(model.scale(x[good]) * 0 + 0.5), model.threshold, model.scale)
    assert (blind.scores(x[held]) > model.threshold).sum() != refused.sum()


def test_judged_by(spark):
    docs, kinds = labelled_rows(spark, 100)
    labels = spark.createDataFrame([(i, int(k), 0) for i, k in enumerate(kinds)], "doc_id bigint, quality int, toxic int")
    measured = quality.measure(docs)
    for given, said in ((labels, "forest"), (labels.limit(0), "base rules")):
        got = quality.judge(measured, quality.fit(measured, quality.labelled(given)))
        assert {r["judged_by"] for r in got.collect()} == {said}
