import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import frame, odd_texts
from tokenizers import Tokenizer

from textlake.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


def check(docs, rows, capacity, payload):
    tokenizer = Tokenizer.from_file(WORDS)
    of, sequences = {}, {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    texts = {}
    for d in docs:
        texts.setdefault(d["doc_id"], []).append(d["text"] or "")
    assert set(of) == set(texts)
    for doc_id, own in of.items():
        ids = tokenizer.encode(texts[doc_id][0], add_special_tokens=False).ids + [2]
        want = []
        for start in range(0, len(ids), capacity):
            piece = ids[start : start + capacity]
            shown = piece if payload == "ids" else zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
            want += [(start, len(piece), len(ids), shown)] * len(texts[doc_id])
        name = "ids" if payload == "ids" else "ids_crc32"
        assert sorted((r["start"], r["length"], r["doc_tokens"], r[name]) for r in own) == sorted(want)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_odd_rows(spark):
    texts = [*odd_texts(), "<|endoftext|> mid<|startoftext|>dle", "it's WE'LL 12345 ½ ﬁ Σας İ é", "　wide space\x85next"]
    docs = frame(spark, texts)
    for payload, capacity, unit in (("ids", 64, 16), ("crc32", 4096, 16), ("ids", 32, 1)):
        rows = packing.pack_documents(docs, WORDS, capacity, unit=unit, payload=payload).collect()
        check(docs.collect(), rows, capacity, payload)


def test_empty_table(spark):
    assert packing.pack_documents(frame(spark, []), WORDS).collect() == []


def test_little_padding(spark):
    rnd = np.random.default_rng(4)
    lengths = np.minimum(rnd.lognormal(6, 1, 20_000).astype(int) + 1, 4096)
    lengths[::3] = 1000  # one length is a third of all
    cut = spark.createDataFrame([(int(i), 0, int(n)) for i, n in enumerate(lengths)], "doc_id bigint, start bigint, length bigint")
    rows = packing.pack(cut, 4096, 16).collect()
    filled = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(map(len, filled.values())) == len(lengths)
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(filled) <= 1.01 * lengths.sum() / 4096 + 2


def test_plan_covers_the_demand():
    rnd = np.random.default_rng(8)
    for _ in range(20):
        units = int(rnd.integers(2, 24))
        demand = rnd.integers(0, 60, units) * (rnd.random(units) < 0.6)
        patterns = packing.plan(demand)
        placed = sum((p * n for p, n in patterns), np.zeros(units, int))
        assert (placed >= demand).all()
        assert all((p * np.arange(1, units + 1)).sum() <= units for p, _ in patterns)
        used = sum(n for _, n in patterns)
        area = (demand * np.arange(1, units + 1)).sum()
        fractional = sum(x for _, x in packing.column_generation(demand))
        assert area / units - 1e-6 <= fractional <= used <= fractional + units


def test_inverse():
    matrix = np.random.default_rng(2).random((40, 40))
    matrix[0, 0] = 0
    assert np.allclose((matrix[:, :, None] * packing._inverse(matrix)[None]).sum(1), np.eye(40))


def test_knapsack_by_brute_force():
    rnd = np.random.default_rng(9)

    def best(prices, room):
        return max([0.0] + [prices[s - 1] + best(prices, room - s) for s in range(1, room + 1)])

    for _ in range(10):
        prices = rnd.random(7)
        (value, pattern), *others = packing._knapsack(prices, 7, further=7)
        assert np.allclose(sorted(o[0] for o in others), sorted(prices[s - 1] + best(prices, 7 - s) for s in range(1, 8)))
        assert all(abs((p * prices).sum() - v) < 1e-9 and (p * np.arange(1, 8)).sum() <= 7 for v, p in others)
        assert abs(value - best(prices, 7)) < 1e-9
        assert abs((pattern * prices).sum() - value) < 1e-9 and (pattern * np.arange(1, 8)).sum() <= 7


def test_column_generation_ends_at_the_optimum(monkeypatch):
    """Demand over all 256 classes, drawn at random: at the end no pattern has a price above 1, and the prices' worth
    of the demand, which no solution can undercut, is what the solution costs."""
    last = {}
    real = packing._knapsack

    def spied(prices, capacity, further=0):
        found = real(prices, capacity, further)
        last.update(value=found[0][0], prices=prices)
        return found

    monkeypatch.setattr(packing, "_knapsack", spied)
    started = time.time()
    for seed in range(8):
        demand = np.random.default_rng(seed).integers(0, 10 ** (seed + 1), 256)
        solution = packing.column_generation(demand)
        cost = sum(x for _, x in solution)
        assert last["value"] <= 1 + 1e-6 and (last["prices"] * demand).sum() == pytest.approx(cost, rel=1e-5)
        assert (sum(p * x for p, x in solution) >= demand * (1 - 1e-9) - 1e-6).all()
    assert time.time() - started < 20


def test_another_tokenizer_encodes_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "It's   12345  <|endoftext|>\n\tİ "
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing._Words(path).ids(text), "<u4").tolist() == want
    assert packing._Words(WORDS).by_words and not packing._Words(path).by_words


def test_ascii_letters_are_their_own_marks(monkeypatch):
    """Words of ASCII letters are neither decoded as UTF-8 nor translated letter by letter; ids stay those of the tokenizer."""
    words = packing._Words(WORDS)
    text = "plain Words iN every CASE, zzxqv don't x1 \u212a İ Übermaß naïve"
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert list(np.frombuffer(words.ids(text), "<u4")) == want
    monkeypatch.setattr(packing, "_BYTE_MARKS", None)
    monkeypatch.setattr(packing, "_LETTERS", None)
    again = packing._Words(WORDS)
    want = again.tokenizer.encode("plain Words iN every CASE", add_special_tokens=False).ids
    assert list(np.frombuffer(again.ids("plain Words iN every CASE"), "<u4")) == want
