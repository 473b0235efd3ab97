import random
import re
from collections import Counter, defaultdict

import pytest
from cases import frame, odd_texts

from textlake.llm import divergence


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, least, top=50):
    docs = [(lang or "", source or "", Counter(terms(text))) for lang, source, text in rows]
    df, out = Counter(), []
    for lang, _, c in docs:
        df.update((lang, t) for t in c)
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)
    groups, langs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, c in docs:
        own = Counter({t: c[t] for t in kept[lang] if c[t]})
        groups[lang, source] += own
        langs[lang] += own

    def p(c, lang, t):
        return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept[lang]))

    for (lang, source), c in groups.items():
        pairs = [(-sum(abs(p(c, lang, t) - p(o, lang, t)) for t in kept[lang]), other) for (x, other), o in groups.items() if x == lang and other != source]
        more = [(p(langs[lang], lang, t) - p(c, lang, t), t) for t in kept[lang] if c[t]]
        for part, found in (("pair", pairs), ("term", [m for m in more if m[0] < 0])):
            found = sorted(found, key=lambda f: (f[0], f[1].encode()))
            out += [(lang, source, part, item, -v, i + 1) for i, (v, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def corpus(seed=3, n=150):
    rnd = random.Random(seed)
    words = ["the", "über", "Zß", "a", "abcdefgh", "abcdefgi", "abcdefghijklmnopq", "abcdefghijklmnopr", "世界", "x" * 70, *("w" + c * k for c in "abc" for k in range(1, 9))]
    rows = [(rnd.choice(["en", "de", None]), rnd.choice(["s", "s", "s", "t", None]), " ".join(rnd.choices(words, k=rnd.randint(0, 15))) + f" rare{'abcdefghij'[i % 10] * (i % 40)}.") for i in range(n)]
    return [*rows, ("en", "s", None), ("zz", "alone", "one"), ("yy", "a", ""), ("yy", "b", None)]


@pytest.mark.parametrize("first_bytes", [1, 2, 4])
@pytest.mark.parametrize("most_sent", [0, 1000])
def test_audit_equals_brute_force(spark, first_bytes, most_sent):
    rows = corpus()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    got = divergence.audit(docs, least_docs=10, top=5, first_bytes=first_bytes, most_sent=most_sent)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 5)


def test_prefixes_below_the_threshold_are_not_extended(spark, monkeypatch):
    """Terms below a discarded prefix are not counted at the next level, whichever way the parents are looked up."""
    rows = [("en", "s", f"commonly{c} rarely{c * 5}") for c in "abcdefghijkl"]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    seen = []
    real = divergence._counted

    def spied(*args):
        out = real(*args)
        seen.append({bytes(r["term"]) for r in out.collect()})
        return out

    monkeypatch.setattr(divergence, "_counted", spied)
    kept = divergence.frequent_terms(docs, least_docs=13, first_bytes=2, growth=2)
    assert kept.collect() == [] and len(seen) == 1
    seen.clear()
    docs = spark.createDataFrame([*rows, ("en", "s", "common"), ("de", "s", "rare")], "lang string, source string, text string")
    kept = divergence.frequent_terms(docs, least_docs=13, first_bytes=2, growth=2)
    assert kept.collect() == []
    # The 13th document shares "co", "comm" and "common" but not what follows; "ra" of the others fails at once.
    assert seen[1] == {b"comm"} and all(t.startswith(b"common") for t in seen[2]) and len(seen) == 3


def test_a_task_sends_on_what_it_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH", 3)
    monkeypatch.setattr(divergence, "FLUSH_CELLS", 3)
    rows = corpus(5, 60)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    assert sorted(map(tuple, divergence.audit(docs, 5).collect())) == brute(rows, 5)


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "LEAST_TERMS", 2)
    monkeypatch.setattr(divergence, "CELLS", 4)
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audit(docs, 10).collect())) == brute(rows, 10)


def test_counts_beyond_long_arithmetic(spark):
    """10^9 times a count of 10^12 needs more than 64 bits."""
    from pyspark.sql import functions as F

    row = spark.sql("SELECT 1000000000000L AS n, 3000000000007L AS total, 11L AS v")
    got = row.select(divergence._share(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (10**12 + 5) // (3 * 10**12 + 7 + 55)


def test_odd_rows(spark):
    texts = odd_texts()
    docs = frame(spark, texts).selectExpr("*", "place AS source", "1 AS term", "2 AS n", "3 AS value", "4 AS block", "5 AS rank")
    rows = [(r["lang"], r["source"], r["text"]) for r in docs.collect()]
    for least in (1, 2):
        assert sorted(map(tuple, divergence.audit(docs, least).collect())) == brute(rows, least)
    assert divergence.audit(docs.limit(0)).collect() == []
