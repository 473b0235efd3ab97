"""Rows that every operator of the subpackage has to stand."""

import random

SCHEMA = "doc_id bigint, text string, lang string, node string, place string, ids string, key string, _id string, _of string, _dropped string, _whole string, _spread string, _id_ string"


def words(rnd, n, letters="abcdefgh"):
    return ["".join(rnd.choices(letters, k=rnd.randint(2, 7))) for _ in range(n)]


def odd_texts():
    """Nulls, empty and blank texts, one word, white space of all kinds, copies, letters beyond ASCII, a long text."""
    rnd = random.Random(11)
    long = "\n".join(" ".join(words(rnd, 12)) for _ in range(900))
    line = " ".join(words(rnd, 30))
    return [
        None,
        "",
        " \t\n ",
        "one",
        "one",
        "two words",
        "tab\tand\x0bfeed\x0c and\r\nreturn",
        "tab and feed and return",
        "É Übung 世界 \U0001f600 é",
        "nbsp\u00a0stays\u2003a word",
        line,
        line,
        line + " more",
        "\n".join([line, "", line, " " + line]),
        "\n\n",
        long,
        long,
    ]


def frame(spark, texts=None):
    """The odd texts as documents with further columns whose names operators use inside; ids repeat and are null."""
    texts = odd_texts() if texts is None else texts
    inner = ("A", "B", "C", "D", "E", "F")
    rows = [(i, t, "en", "n", "p", "i", "k", *inner) for i, t in enumerate(texts)]
    if texts:
        rows += [(None, "one", *[None] * 11), (len(texts) - 1, texts[-1], "en", "n", "p", "i", "k", *inner)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
