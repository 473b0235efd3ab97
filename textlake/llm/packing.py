"""Packing of documents into sequences by cutting-stock column generation.

A document is tokenised, an end id is added, and it is cut into pieces of a sequence's capacity; its last piece is
shorter. The pieces' lengths are counted in classes of ``unit`` ids. A linear program chooses how often to use each
pattern (a multiset of classes that fits into a sequence) such that all pieces are covered with the fewest sequences;
its columns are priced by a knapsack dynamic program. The rounded patterns' places are then filled with the pieces
of each class by their rank.

The program sees counts only (one per class, 256 for 4096 ids), whatever the number of documents.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import ranked, stored

# Words that a process keeps the ids of: as many of late, and as many from before.
CACHED_WORDS = 200_000
# A word that ends in ASCII punctuation behind an ASCII letter, apostrophes aside: there the tokenizer always cuts.
_ENDING = re.compile(rb"(.*[A-Za-z])([!-&(-/:-@\[-`{-~]+)\Z", re.S)
# Letters up to U+00FF in UTF-8: nothing to normalise but case, and nothing to cut.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")
# Byte-level vocabularies write bytes that are no visible Latin-1 character as those from U+0100 on, in order.
_HIDDEN_BYTES = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_MARKS = {b: 256 + n for n, b in enumerate(_HIDDEN_BYTES)}
# How a tokenizer normalises and cuts for which the short ways above hold.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUTS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_encoders: dict[str, _Words] = {}


class _Kept(dict):
    """Ids by word; a word that is not there comes from ``before`` or is made."""

    def __init__(self, make, before):
        super().__init__()
        self.make, self.before = make, before

    def __missing__(self, word: bytes) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.make(word)
        self[word] = found
        return found


class _Words:
    """Token ids of single words, kept for the words that come often.

    A tokenizer with other rules than those that the short ways rest on encodes whole texts itself. The usual one drops white space and never joins across it, so that a text's ids are those of its words. It lower
    cases, and cuts between letters and punctuation, so that a new word is put together from its parts, and parts of
    plain letters go straight to the merges.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a process for every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kept = _Kept(self.made, {})
        with open(path, encoding="utf-8") as f:
            self.by_words = self._cuts_words(json.load(f))

    @staticmethod
    def _cuts_words(rules: dict) -> bool:
        cut = {"type": "Split", "pattern": {"Regex": _CUTS}, "behavior": "Removed", "invert": True}
        return (
            rules["normalizer"] == {"type": "Sequence", "normalizers": _NORMALIZERS}
            and rules["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [cut, _BYTES]}
            and rules["model"]["type"] == "BPE"
            and not rules["model"]["dropout"]
            and all(t["content"].startswith("<|") and not any(map(str.isspace, t["content"])) for t in rules["added_tokens"])
        )

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        if not self.by_words:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.kept) > CACHED_WORDS:
            self.kept = _Kept(self.made, dict(self.kept))
        return b"".join(map(self.kept.__getitem__, text.encode("utf-8", "surrogatepass").split()))

    def made(self, word: bytes) -> bytes:
        if word.isalpha() or _LETTERS.match(word):
            # Bytes count as letters, and change case, in ASCII alone; ASCII letters are their own marks.
            plain = word.isascii()
            low = word.lower() if plain else word.decode().lower().encode()
            if low != word:
                return self.kept[low]
            marks = word.decode() if plain else word.decode("latin-1").translate(_BYTE_MARKS)
            return array("I", [t.id for t in self.model.tokenize(marks)]).tobytes()
        # The mark of a special token keeps its word whole.
        if b"<|" not in word and (m := _ENDING.match(word)):
            return self.kept[m[1]] + self.kept[m[2]]
        found = self.tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False)
        return array("I", found.ids).tobytes()


def encoder(path: str) -> _Words:
    """One encoder per process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = _Words(path)
    return _encoders[path]


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, payload: str = "ids", id_col="doc_id", text_col="text"
) -> DataFrame:
    """Cuts every document into pieces of at most ``capacity`` ids: doc_id, start, length, doc_tokens and payload.

    ``payload`` is ``ids`` (the ids as an array) or ``crc32`` (a checksum of the ids as little-endian unsigned 32-bit
    numbers). A null or empty text has the end id only. Rows that repeat are cut each for itself, also with one id; an
    empty table gives no rows; ids may be null; further columns, whatever their names, are not read. A text of any
    length is encoded whole.
    """
    kind = {"ids": "ids array<int>", "crc32": "ids_crc32 bigint"}[payload]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                of, out = [], []
                for n, text in enumerate(part.column("text")):
                    ids = encode(text.as_py() or "") + end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        shown = zlib.crc32(piece) if payload == "crc32" else np.frombuffer(piece, "<u4")
                        of.append(n)
                        out.append((start, len(piece) // 4, total, shown))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), *columns], names)

    names = ["doc_id", "start", "length", "doc_tokens", payload if payload == "ids" else "ids_crc32"]
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int32()) if payload == "ids" else pa.int64()]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, start bigint, length bigint, doc_tokens bigint, {kind}")


def _knapsack(prices: np.ndarray, capacity: int, further: int = 0) -> list[tuple[float, np.ndarray]]:
    """Value and content of the most valuable multiset of classes 1..len(prices) whose sizes sum up to ``capacity`` at
    most, and of the best ones that hold a certain class, for the ``further`` classes where these are worth most."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)  # 0: leaves a unit free
    for c in range(1, capacity + 1):
        sizes = np.arange(1, min(c, len(prices)) + 1)
        values = best[c - sizes] + prices[: len(sizes)]
        k = int(values.argmax())
        if values[k] > best[c - 1] + 1e-12:
            best[c], took[c] = values[k], k + 1
        else:
            best[c] = best[c - 1]

    def pattern(c: int, first: int = 0) -> np.ndarray:
        out = np.zeros(len(prices), np.int64)
        if first:
            out[first - 1] += 1
            c -= first
        while c > 0:
            if took[c]:
                out[took[c] - 1] += 1
                c -= took[c]
            else:
                c -= 1
        return out

    sizes = np.arange(1, min(capacity, len(prices)) + 1)
    with_class = np.where(prices[: len(sizes)] > 0, prices[: len(sizes)] + best[capacity - sizes], 0)
    order = np.argsort(-with_class, kind="stable")[:further]
    return [(float(best[capacity]), pattern(capacity)), *[(float(with_class[k]), pattern(capacity, int(k) + 1)) for k in order]]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    # Element by element: the threads of a linear algebra library can lock up a driver that also talks to a JVM.
    return (matrix * vector).sum(1)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with pivots, row operations on the whole matrix."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        others = both[:, i].copy()
        others[i] = 0
        both -= others[:, None] * both[i]
    return both[:, n:]


def _first_fit(demand: np.ndarray) -> list[np.ndarray]:
    """Patterns of filling sequences with the largest pieces that fit; a pattern is used until one of its classes ends."""
    left, units, out = demand.astype(np.int64).copy(), len(demand), []
    while left.any():
        pattern, room = np.zeros(units, np.int64), units
        for size in np.flatnonzero(left)[::-1] + 1:
            pattern[size - 1] = min(room // size, left[size - 1])
            room -= size * pattern[size - 1]
        times = (left[pattern > 0] // pattern[pattern > 0]).min()
        left -= times * pattern
        out.append(pattern)
    return out


# A price by which a pattern may still undercut: the solution is then the best one up to this share.
OPTIMAL = 1e-7


def column_generation(demand: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, the best fractional solution: min sum x with patterns * x >= demand.

    ``demand[i]`` is the number of pieces of class i + 1, and a sequence holds len(demand) units. The simplex method
    starts with a pattern of its own for every class and solves the program over all patterns that are known, at first
    those of a first fit. A knapsack over the dual prices then gives further patterns, until none has a price above 1.
    A program that does not end is an error.
    """
    units = len(demand)
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    n = len(classes)
    sizes = classes + 1
    basis = np.zeros((n, n))  # columns are patterns, rows are classes
    basis[np.arange(n), np.arange(n)] = units // sizes
    inverse = np.diag(1.0 / (units // sizes))
    # A little more of each class, by different shares, so that no step is of length 0.
    wanted = demand[classes] * (1 + 1e-9 * np.random.default_rng(1).uniform(1, 2, n))
    x = _times(inverse, wanted)
    known = {p[classes].tobytes(): p[classes] for p in _first_fit(demand)}
    pool = np.array(list(known.values()), float)
    pivots = 0
    while True:
        prices = np.zeros(units)
        prices[classes] = inverse.sum(0)  # every column costs 1
        worth = _times(pool, prices[classes])
        entering = int(worth.argmax())
        if worth[entering] <= 1 + OPTIMAL:
            found = _knapsack(np.maximum(prices, 0), units, further=20)
            if found[0][0] <= 1 + OPTIMAL:
                break
            fresh = {p[classes].tobytes(): p[classes] for value, p in found if value > 1 + OPTIMAL}
            fresh = {k: p for k, p in fresh.items() if k not in known}
            if not fresh:
                # All of them are known and worth no more than 1: prices are only rounded otherwise.
                break
            known |= fresh
            pool = np.vstack([pool, np.array(list(fresh.values()), float)])
            continue
        column = pool[entering]
        step = _times(inverse, column)
        usable = step > 1e-9
        ratio = np.full(n, np.inf)
        ratio[usable] = x[usable] / step[usable]
        out = int(ratio.argmin())
        x -= ratio[out] * step
        x[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= step[:, None] * row
        inverse[out] = row
        pivots += 1
        if pivots % 200 == 0:  # against rounding errors
            inverse = _inverse(basis)
            x = _times(inverse, wanted)
        if pivots > 1000 * (n + 10):
            raise RuntimeError(f"the linear program over {n} classes has not ended after {pivots} steps")
    found = []
    x = _times(_inverse(basis), demand[classes].astype(float))  # of what is wanted, without the little more
    for i in range(n):
        if x[i] > 1e-9:
            whole = np.zeros(units, np.int64)
            whole[classes] = basis[:, i].astype(np.int64)
            found.append((whole, float(x[i])))
    return found


def plan(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole numbers that have a place for every piece.

    The fractional solution is rounded down; pieces that this leaves over, fewer than the places of one use of each
    pattern, are put into further sequences, the largest first, each where it leaves the least room.
    """
    units = len(demand)
    chosen = [(p, int(np.floor(x + 1e-6))) for p, x in column_generation(demand)]
    left = demand.astype(np.int64).copy()
    patterns = []
    for pattern, times in chosen:
        if times:
            # Places beyond the demand stay empty; a pattern keeps its shape.
            patterns.append((pattern, times))
            left -= pattern * times
    left = np.maximum(left, 0)
    room: list[int] = []
    extra: list[np.ndarray] = []
    for size in range(units, 0, -1):
        for _ in range(int(left[size - 1])):
            fit = [(r, i) for i, r in enumerate(room) if r >= size]
            if fit:
                at = min(fit)[1]
            else:
                at = len(room)
                room.append(units)
                extra.append(np.zeros(units, np.int64))
            room[at] -= size
            extra[at][size - 1] += 1
    return patterns + [(p, 1) for p in extra]


@dataclass
class Places:
    """For every class: the ranks from which a pattern's places begin, and what is needed to find the sequence."""

    starts: dict[int, np.ndarray]
    of: dict[int, np.ndarray]  # per start: first sequence of the pattern, places of the class in one sequence


def places(patterns: list[tuple[np.ndarray, int]]) -> Places:
    """Deals the ranks 0.. of a class over the patterns, in the patterns' order; sequences are numbered from 0."""
    starts: dict[int, list[int]] = {}
    of: dict[int, list[tuple[int, int]]] = {}
    filled: dict[int, int] = {}
    first = 0
    for pattern, times in patterns:
        for i in np.flatnonzero(pattern):
            size = int(i) + 1
            starts.setdefault(size, []).append(filled.get(size, 0))
            of.setdefault(size, []).append((first, int(pattern[i])))
            filled[size] = filled.get(size, 0) + int(pattern[i]) * times
        first += times
    return Places({k: np.array(v) for k, v in starts.items()}, {k: np.array(v) for k, v in of.items()})


def pack(cut: DataFrame, capacity: int = 4096, unit: int = 16) -> DataFrame:
    """Adds sequence_id and offset to pieces: every piece once, no sequence above ``capacity``, offsets without a gap.

    ``cut`` has doc_id, start and length and is read several times: pass a stored table. Lengths are rounded up to
    ``unit`` ids for the plan only, which leaves room of less than ``unit`` ids a piece. ``capacity`` has to be a
    multiple of ``unit``. Rows that repeat are pieces of their own. An empty table gives no rows.
    """
    if capacity % unit:
        raise ValueError("capacity is no multiple of unit")
    sized = cut.withColumn("_class", F.ceil(F.col("length") / unit).cast("int"))
    demand = np.zeros(capacity // unit, np.int64)
    for r in sized.groupBy("_class").count().collect():  # one row per class
        demand[r["_class"] - 1] = r["count"]
    found = places(plan(demand))

    columns = sized.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sized.schema) + ", _rank bigint, sequence_id bigint"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence = np.zeros(batch.num_rows, np.int64)
            classes, ranks = batch.column("_class").to_numpy(), batch.column("_rank").to_numpy()
            for size in np.unique(classes):
                mine = classes == size
                at = np.searchsorted(found.starts[size], ranks[mine], "right") - 1
                first, each = found.of[size][at].T
                sequence[mine] = first + (ranks[mine] - found.starts[size][at]) // each
            yield batch.append_column("sequence_id", pa.array(sequence))

    numbered = ranked(sized, ["_class"], ["doc_id", "start"], "_rank")
    dealt = numbered.select(*columns, "_rank").mapInArrow(deal, schema)
    # A sequence has at most ``capacity`` pieces.
    before = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_class", "_rank")


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, unit: int = 16, payload: str = "ids", id_col="doc_id", text_col="text"
) -> DataFrame:
    """Tokenises and packs whole documents; see ``pieces`` and ``pack``. Each text is tokenised once."""
    cut = pieces(docs, tokenizer, capacity, end_id, payload, id_col, text_col)
    return pack(stored(cut, "pieces"), capacity, unit)
