import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from textlake.functions import text as tx
from textlake.operators import offsets


def brute_offsets(text, needle):
    hay, ndl = text.encode(), needle.encode()
    return [i for i in range(len(hay) - len(ndl) + 1) if ndl and hay[i : i + len(ndl)] == ndl]


def offsets_of(spark, texts, needle, cap=None):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {i: [] for i in range(len(texts))}
    for i, ord_, pos in sorted(rows(offsets.find_offsets(df, ["id"], "text", needle, cap))):
        assert ord_ == len(out[i]) + 1
        out[i].append(pos)
    return out


@pytest.mark.parametrize(
    "text, needle, want",
    [
        ("switched to SQLite for storage", "SQLite", [12]),
        ("abc abc abc", "abc", [0, 4, 8]),
        ("aaaa", "aa", [0, 1, 2]),
        ("é é", "é", [0, 3]),
        ("a.b(c)[d]\\E", "\\E", [9]),
        ("x\ny\nz", "\n", [1, 3]),
        (" a a", " a", [0, 2]),
        ("", "a", []),
        ("abc", "", []),
        ("abc", "abcd", []),
    ],
)
def test_offsets(spark, text, needle, want):
    assert offsets_of(spark, [text], needle)[0] == want


def test_offsets_cap_and_long_text(spark):
    text = "x" * 100 + "needle" + "y" * 100 + "needle"
    assert offsets_of(spark, [text, "abc abc abc"], "needle")[0] == [100, 206]
    assert offsets_of(spark, ["abc abc abc"], "abc", 2)[0] == [0, 4]


def test_offsets_against_search(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé{\n 字") for _ in range(rng.randrange(60))) for _ in range(200)]
    for needle in ["a", "ab", "aa", "aba", "é", "é{", "字a", "\n "]:
        assert offsets_of(spark, texts, needle) == {i: brute_offsets(t, needle) for i, t in enumerate(texts)}


def test_offsets_in_binary_columns(spark):
    df = spark.createDataFrame([(1, b"\xff\xfeab\xffab"), (2, b"")], "id int, b binary")
    assert sorted(rows(offsets.find_offsets(df, ["id"], "b", "ab"))) == [(1, 1, 2), (1, 2, 5)]
    assert sorted(rows(offsets.contains_batch(df, ["id"], "b", "ab"))) == [(1, True), (2, False)]


def test_contains_batch_never_crosses_rows(spark):
    df = spark.createDataFrame([(0, "abc"), (1, "def"), (2, "xabcdefx"), (3, None)], "id int, text string")
    hit = lambda needle: dict(rows(offsets.contains_batch(df, ["id"], "text", needle)))
    assert hit("abcdef") == {0: False, 1: False, 2: True, 3: False}
    assert not any(hit("").values())
    assert hit("ABC") == dict.fromkeys(range(4), False)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("limit", [4, 7, 127, 255])
def test_truncate_bytes(spark, limit):
    rng = random.Random(limit)
    texts = ["a" * limit, "é" * limit, "字" * limit, "😀" * limit, ""]
    texts += ["".join(rng.choice("aé字😀") for _ in range(rng.randrange(2 * limit))) for _ in range(60)]

    def want(t):
        b = t.encode()
        return t if len(b) <= limit else b[: limit - 3].decode("utf-8", "ignore") + "..."

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows(df.select("t", tx.truncate_bytes("t", limit).alias("cut")))
    assert got == [(t, want(t)) for t in texts]


def test_time_ago(spark):
    now = 1_000_000
    want = {0: "0s ago", 59: "59s ago", 60: "1m ago", 3599: "59m ago", 3600: "1h ago", 86399: "23h ago", 86400: "1d ago", 900000: "10d ago"}
    df = spark.createDataFrame([(now - d, d) for d in want], "ts bigint, d bigint")
    assert dict(rows(df.select("d", tx.time_ago("ts", F.lit(now))))) == want


def test_estimate_tokens_counts_characters(spark):
    df = spark.createDataFrame([("",), ("abc",), ("éééé",), ("字" * 9,)], "t string")
    assert [r[0] for r in rows(df.select(tx.estimate_tokens("t")))] == [0, 0, 1, 2]


def test_strip_and_lines(spark):
    texts = ["", "  a \t\n", "a\xa0\x1f ", "\x1c\x85 b c", " \n "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows(df.select(tx.strip("t"), tx.rstrip("t")))
    assert got == [(t.strip(), t.rstrip()) for t in texts]
    df = spark.createDataFrame([("a\r\nb\rc\nd",), ("a\n",), ("",), ("\n\n",)], "t string")
    assert [r[0] for r in rows(df.select(tx.lines_universal("t")))] == [["a", "b", "c", "d"], ["a"], [], ["", ""]]


@pytest.mark.parametrize(
    "needle, want",
    [("100%", [0, 2]), ("CASES", [0]), ("the_c", [0, 3]), ("é", [1]), ("É", []), ("\\", [4]), ("", [0, 1, 2, 3, 4])],
)
def test_like_is_ascii_insensitive_with_wildcards(spark, needle, want):
    texts = ["about 100% of the_Cases", "été", "1000 times", "the canal", "back\\slash"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r[0] for r in rows(df.where(tx.like_anywhere("t", needle)).select("id"))] == want


def test_arrow_lines(spark):
    text = "fn a() -> i32 { 1 }\n/// foo(a) -> b, c(d) -> e\n// minus- sign\n->"
    df = spark.createDataFrame([(1, text), (2, "none")], "id int, t string")
    got = rows(offsets.arrow_lines(df, ["id"], "t"))
    assert [(i, n) for i, n, _ in got] == [(1, 1), (1, 2), (1, 4)]


def test_content_hash(spark):
    import hashlib

    assert one(spark, tx.content_hash(F.lit("é"))) == hashlib.sha256("é".encode()).hexdigest()
