import random

import pytest
from cases import frame, odd_texts, words
from pyspark.sql import functions as F

from textlake.llm import line_dedup


def near(a, b):
    """Whether the edit distance in words is at most 1, by the table of all distances."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1] <= 1


def brute(rows, near_words):
    docs = sorted({(i if i is not None else -1, t or "") for i, t in rows})
    lines = [((i, n), tuple(x.encode().split())) for i, t in docs for n, x in enumerate(t.split("\n")) if x.encode().split()]
    lines.sort()
    place = {}
    for p, w in lines:
        place.setdefault(w, p)
    different = sorted(place, key=place.get)
    first = {}
    for k, w in enumerate(different):
        match = [v for v in different[:k] if len(v) >= near_words and len(w) >= near_words and near(v, w)]
        first[w] = place[match[0]] if match else place[w]
    return {p: first[w] for p, w in lines}


def marked(docs, near_words):
    got = line_dedup.mark_lines(docs, near_words).select("place.doc_id", "place.line", "first.doc_id", "first.line", "kept").collect()
    id_ = lambda i: -1 if i is None else i
    for a, b, c, d, kept in map(tuple, got):
        assert kept == ((a, b) == (c, d))
    return {(id_(a), b): (id_(c), d) for a, b, c, d, _ in map(tuple, got)}


def edited(rnd, own):
    own = list(own)
    kind = rnd.randint(0, 3)
    at = rnd.randrange(len(own))
    if kind == 0:
        own[at] = words(rnd, 1, "ab")[0]
    elif kind == 1 and len(own) > 1:
        del own[at]
    elif kind == 2:
        own.insert(at, words(rnd, 1, "ab")[0])
    return own


@pytest.mark.parametrize("near_words", [1, 5])
def test_lines_one_word_apart(spark, near_words):
    rnd = random.Random(near_words)
    bases = [words(rnd, rnd.randint(1, 14), "ab") for _ in range(25)]
    texts = ["\n".join(" ".join(edited(rnd, edited(rnd, rnd.choice(bases)))) for _ in range(8)) for _ in range(60)]
    docs = frame(spark, texts)
    assert marked(docs, near_words) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], near_words)


def test_odd_rows(spark):
    docs = frame(spark, odd_texts())
    assert marked(docs, 10) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 10)


def test_a_hot_template(spark):
    texts = [f"this line stands on many pages with number {i} as its end" for i in range(1500)] + ["alone"] * 700
    got = marked(frame(spark, texts), 10)
    assert all(got[i, 0] == (0, 0) for i in range(1500)) and all(got[1500 + i, 0] == (-1, 0) or got[1500 + i, 0] == (1500, 0) for i in range(700))


def test_dropping_lines(spark):
    line = "a line of ten words that comes in two documents"
    texts = [f"{line}\n\nfirst", f"second\n{line}\n  {line} \nthird", line, None, "", "\n \n", "first", f"{line} more\nx"]
    docs = frame(spark, texts).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = line_dedup.drop_lines(docs)
    assert got.schema == docs.schema
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert by == {0: texts[0], 1: "second\nthird", 3: None, 4: "", 5: "\n \n", 7: "x"}


def test_empty_table(spark):
    docs = frame(spark, [])
    assert line_dedup.mark_lines(docs).collect() == [] and line_dedup.drop_lines(docs).collect() == []


def test_edit_test_by_the_table(spark):
    rnd = random.Random(3)
    pairs = [(rnd.choices("ab", k=rnd.randint(1, 5)), rnd.choices("ab", k=rnd.randint(1, 5))) for _ in range(400)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    got = df.select("a", "b", line_dedup._within_one_word(df.a, df.b).alias("near")).collect()
    assert all(r["near"] == near(r["a"], r["b"]) for r in got)


def test_lines_whose_keys_clash_are_looked_up_again(spark, monkeypatch):
    """Keys cut to a few bits agree for many different variants, under every seed."""
    rnd = random.Random(9)
    bases = [words(rnd, rnd.randint(5, 9), "abcde") for _ in range(25)]
    texts = ["\n".join(" ".join(edited(rnd, rnd.choice(bases))) for _ in range(6)) for _ in range(40)]
    docs = frame(spark, texts)
    real, seeds = line_dedup.deletion_variants, []

    def cut(lines, seed):
        seeds.append(seed)
        return real(lines, seed).withColumn("key", F.pmod("key", F.lit(1 << 11)))

    monkeypatch.setattr(line_dedup, "deletion_variants", cut)
    assert marked(docs, 5) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5)
    assert max(seeds) >= 1
