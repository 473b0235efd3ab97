import random

import public_tokenizers
import pytest
from cases import frame, odd_texts
from hypothesis import given, settings
from hypothesis import strategies as st

from textlake.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


def by_chunks(text, chunk):
    m = sp.model(PATH)
    seen = sp.marked(text)
    parts = []
    for low in range(0, len(seen), chunk):
        begin, high = max(0, low - m.longest), min(len(seen), low + chunk)
        parts.append((seen[begin : high + m.longest], low - begin, high - begin))
    states = sp.boundaries([sp.transfer(m, *p) for p in parts])
    return [i for p, a, b in zip(parts, states, states[1:], strict=False) for i in sp.trace(m, *p, a, b)]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.sampled_from(["a", "e", "th", "ing", " ", "  ", "\n", "é", "世", "0", "...", "ER", "▁", "\U0001f600"]), min_size=1, max_size=120),
    st.sampled_from([17, 23, 40, 200]),
)
def test_chunks_give_the_encoding_of_the_whole(parts, chunk):
    text = "".join(parts)
    assert by_chunks(text, chunk) == sp.model(PATH).library.encode(text)


def test_a_text_without_spaces():
    rnd = random.Random(4)
    text = "".join(rnd.choices(["able", "con", "s", "t", "ion", "Q", "12", "é", "/"], k=4000))
    assert by_chunks(text, 100) == sp.model(PATH).library.encode(text)


def test_matrices_combine_associatively():
    m = sp.model(PATH)
    text = sp.marked("onewordwithoutanyspacesthatgoesonforalongtimeandendssomewhere" * 3)

    cuts = [0, 40, 80, 130, len(text)]
    one, two, three, four = (sp.transfer(m, text, a, b) for a, b in zip(cuts, cuts[1:], strict=False))
    join = lambda *matrices: sp.product(list(matrices))
    left = join(join(join(one, two), three), four)
    assert left == join(one, join(two, join(three, four))) == join(join(one, two), join(three, four)) == join(one, two, three, four)
    assert [t for t in left[sp.START] if t[1] == 0]


def chunk_texts(text, chunk):
    m = sp.model(PATH)
    seen = sp.marked(text)
    for low in range(0, len(seen), chunk):
        begin, high = max(0, low - m.longest), min(len(seen), low + chunk)
        yield sp.transfer(m, seen[begin : high + m.longest], low - begin, high - begin)


def test_rounds_give_the_states_of_one_pass(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choices(["able", "con", "s", " t", "ion", "é"], k=k)) for k in (3, 30, 333, 900)]
    own = [list(chunk_texts(t, 40)) for t in texts]
    leaves = [(r, n, sp._bytes(x)) for r, matrices in enumerate(own) for n, x in enumerate(matrices)]
    rnd.shuffle(leaves)
    table = spark.createDataFrame(leaves, "row bigint, node int, matrix binary")
    want = {(r, n): (*a, *b) for r, ms in enumerate(own) for s in [sp.boundaries(ms)] for n, (a, b) in enumerate(zip(s, s[1:], strict=False))}
    for fan in (3, 16):
        got = sp.scan(table, max(map(len, own)), fan).collect()
        assert {(r["row"], r["node"]): tuple(r)[2:] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("chunk", [64, 1000, sp.CHUNK])
def test_rows(spark, chunk):
    rnd = random.Random(9)
    texts = [*odd_texts(), "x" * 3000, " " * 500, "".join(rnd.choices("abc déf", k=5000)), "\x00\n\t"]
    docs = frame(spark, texts)
    rows = sp.encode(docs, PATH, chunk).collect()
    m = sp.model(PATH)
    want, got = {}, {}
    for d in docs.collect():
        want.setdefault(d["doc_id"], []).append(m.library.encode(d["text"] or ""))
    for r in rows:
        assert r["round_trip"] and (r["chunks"] == 1 or len(texts[r["doc_id"]]) > chunk)
        got.setdefault(r["doc_id"], []).append((r["chunk"], r["ids"]))
    assert set(got) == set(want)
    for i, own in got.items():
        times = len(want[i])  # a row that repeats is encoded each time
        ids = [x for _, part in sorted(own)[::times] for x in part]
        assert ids == want[i][0] and len(own) % times == 0


def test_decoding(spark):
    texts = [t for t in odd_texts() if t is not None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    back = {r["doc_id"]: r["text"] for r in sp.decode(sp.encode(docs, PATH, 64), PATH).collect()}
    assert back == dict(enumerate(texts))


def test_empty_table(spark):
    encoded = sp.encode(frame(spark, []), PATH)
    assert encoded.collect() == [] and sp.decode(encoded, PATH).collect() == []
