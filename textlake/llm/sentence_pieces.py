"""SentencePiece encoding and decoding, giant documents chunk by chunk.

A document of at most one chunk is encoded by the library. A longer one is cut into chunks of ``CHUNK`` characters,
wherever that falls, and is encoded in parallel as a path through a lattice of pieces:

* A byte-pair encoding is the one sequence of pieces in which every two neighbours are what their own text is encoded
  to. In the max-plus sense, a step between such neighbours weighs 0 and any other minus infinity, and the encoding is
  the path of weight 0.
* The state at a chunk's boundary is the piece that covers or ends at it: how many characters it has before and
  behind the boundary. A chunk gives a matrix of weights from every state at its left to every state at its right
  boundary. With weights of 0 and minus infinity a matrix is a set of pairs of states.
* Matrices of neighbours are multiplied in rounds, ``FAN`` at a time, until a document has one; the product is
  associative. On the way back the states at a product's ends give those between its factors: the one state that can
  be reached from the left end and from which the right end can be reached. Given the states of its boundaries, every
  chunk is traced back on its own.

No piece goes on behind a space once it has begun with another character, so that a path can be cut in front of such
a space. A matrix of a chunk with such places is a column times a row, and the part between its first and last one is
encoded by the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import stored

CHUNK = 32_768
FAN = 16  # neighbours that a round of the scan combines
SPACE = "▁"
START = (0, 0)  # the state at a document's start
_models: dict[str, Model] = {}


class Model:
    """A byte-pair model whose text normalisation only marks spaces and the beginning."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [
            i
            for i in range(self.library.get_piece_size())
            if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))
        ]
        self.score = {self.library.id_to_piece(i): self.library.get_score(i) for i in normal}
        self.longest = max(map(len, self.score))
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece goes on behind a space")
        self.number = {self.library.id_to_piece(i): i for i in normal}
        self.own: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: merges the best pair, of equal ones the first, until none is a piece."""
        parts = list(text)
        while True:
            best = max(
                ((self.score[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.score),
                default=None,
            )
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def is_piece(self, text: str) -> bool:
        """Whether a text is a piece, or one character, that is encoded to itself."""
        if len(text) == 1:
            return True
        if text not in self.score:
            return False
        if (found := self.own.get(text)) is None:
            found = self.own[text] = self.merged(text) == [text]
        return found

    def joins(self, a: str, b: str) -> bool:
        """Whether b may stand behind a."""
        if b[0] == SPACE and a[-1] != SPACE:
            return True
        if (found := self.fits.get((a, b))) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            found = self.fits[a, b] = self.merged(a + b) == [a, b]
        return found

    def ids(self, piece: str) -> list[int]:
        """The id of a piece, or those of the bytes of a character that is none."""
        if (found := self.number.get(piece)) is not None:
            return [found]
        return [self.library.piece_to_id(f"<0x{b:02X}>") for b in piece.encode("utf-8", "surrogatepass")]

    def library_ids(self, marked: str) -> list[int]:
        """Ids of a marked text that begins with a space mark, by the library, which adds that mark itself."""
        return self.library.encode(marked[1:]) if len(marked) > 1 else self.ids(marked) if marked else []


def model(path: str) -> Model:
    """One model per process and file."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def marked(text: str) -> str:
    """The text as the model sees it; a text without characters has no mark either."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _cuts(text: str, low: int, high: int) -> tuple[int, int] | None:
    """The first and the last place in low..high where a space mark follows another character, or begins the text."""
    if low == 0:
        first = 0
    else:
        first = low
        while (first := text.find(SPACE, first)) >= 0 and text[first - 1] == SPACE:
            first += 1
        if first < 0 or first > high:
            return None
    last = high + 1
    while (last := text.rfind(SPACE, first, last)) > first and text[last - 1] == SPACE:
        pass
    return first, max(first, last)


def _paths(m: Model, text: str, start: int, before: str, high: int) -> dict[int, int]:
    """End of each piece that a path from ``start`` can have: the piece's start. Pieces start before ``high``.

    ``before`` is the piece in front of ``start``, empty at a cut.
    """
    came = {start: start - len(before)}
    at = {start}
    while at:
        here = min(at)
        at.remove(here)
        if here >= high:
            continue
        last = before if here == start else text[came[here] : here]
        for end in range(here + 1, min(here + m.longest, len(text)) + 1):
            piece = text[here:end]
            if end > here + 1 and piece[-1] == SPACE and piece[0] != SPACE:
                break
            if m.is_piece(piece) and (not last or m.joins(last, piece)):
                # A text has one encoding, so that two paths to a place can't both go on; the first is kept.
                came.setdefault(end, here)
                at.add(end)
    return came


def _states(m: Model, text: str, at: int) -> list[tuple[int, int]]:
    """Pieces that cover or end at a boundary: characters before and behind it."""
    if at == 0:
        return [START]
    return [
        (k, o)
        for k in range(1, min(m.longest, at) + 1)
        for o in range(min(m.longest - k, len(text) - at) + 1)
        if m.is_piece(text[at - k : at + o])
    ]


def _outgoing(came: dict[int, int], high: int, length: int) -> list[tuple[int, int]]:
    return [(high - start, end - high) for end, start in came.items() if end >= high > start and (end == high or high < length)]


def transfer(m: Model, text: str, low: int, high: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For every state at ``low`` the states at ``high`` that a path through the chunk can have.

    ``text`` has the chunk and, on either side, as many characters as the longest piece, as far as there are any.
    """
    cuts = _cuts(text, low, high)
    found = {}
    tail = _outgoing(_paths(m, text, cuts[1], "", high), high, len(text)) if cuts and cuts[1] < high else None
    for k, o in _states(m, text, low):
        before = text[low - k : low + o]
        if low + o > high or (low + o == high and low < high and o):
            out = [(k + high - low, low + o - high)]
        elif cuts:
            reached = low + o == cuts[0] or cuts[0] in _paths(m, text, low + o, before, cuts[0])
            out = [] if not reached else tail
            if out is None:  # the last cut is the chunk's end
                came = _paths(m, text, low + o, before, cuts[0]) if cuts[0] == high else _paths(m, text, cuts[0], "", high)
                out = [(high - came[high], 0)] if high in came and came[high] < high else [(k, 0)]
        else:
            out = _outgoing(_paths(m, text, low + o, before, high), high, len(text))
        if out:
            found[k, o] = out
    return found


def trace(m: Model, text: str, low: int, high: int, left: tuple[int, int], right: tuple[int, int]) -> list[int]:
    """Ids of the pieces that start in a chunk, between the states of its boundaries."""
    start, end = low + left[1], high - right[0]
    if start >= high:
        return []
    before = text[low - left[0] : start]
    goal = high + right[1]
    cuts = _cuts(text, start, min(goal, high)) if start else (0, _cuts(text, 0, high)[1])
    if cuts and cuts[0] >= start:
        first, last = cuts
        middle = m.library_ids(text[first:last])
        return _walk(m, text, start, before, first) + middle + _walk(m, text, last, "", goal, end)
    return _walk(m, text, start, before, goal, end)


def _walk(m: Model, text: str, start: int, before: str, goal: int, last: int | None = None) -> list[int]:
    """Ids of the path from ``start`` to ``goal``, whose last piece starts at ``last``."""
    if goal == start:
        return []
    came = _paths(m, text, start, before, goal)
    if last is not None:
        came[goal] = last
    pieces, at = [], goal
    while at > start:
        pieces.append(text[came[at] : at])
        at = came[at]
    return [i for p in reversed(pieces) for i in m.ids(p)]


def product(matrices: list[dict]) -> dict:
    """The matrix of neighbouring chunks together, in order: for every state at their start the states at their end.

    Weights are 0 or minus infinity, so that the max-plus product is reachability; it is associative.
    """
    first, *others = matrices
    for other in others:
        first = {s: sorted({u for t in ts for u in other.get(t, ())}) for s, ts in first.items()}
    return {s: ts for s, ts in first.items() if ts}


def boundaries(matrices: list[dict], left: tuple[int, int] = START, right: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """The states at all boundaries of neighbouring chunks between the states at their ends.

    Without ``right`` the last chunk ends the document. What is reached from the start and what the end is reached
    from have one state in common at every boundary.
    """
    ahead = [{left}]
    for matrix in matrices:
        ahead.append({t for s in ahead[-1] for t in matrix.get(s, ())})
    behind = [{s for s in ahead[-1] if (s[1] == 0 if right is None else s == right)}]
    for matrix in reversed(matrices):
        behind.append({s for s, ts in matrix.items() if not behind[-1].isdisjoint(ts)})
    states = [a & b for a, b in zip(ahead, reversed(behind), strict=True)]
    if any(len(s) != 1 for s in states):
        raise ValueError(f"no single path: {[sorted(s) for s in states]}")
    return [s.pop() for s in states]


_SIDES = "row bigint, node int, k int, o int, k2 int, o2 int"


def scan(leaves: DataFrame, chunks: int, fan: int = FAN) -> DataFrame:
    """The states at both ends of every chunk, from row, node (number of the chunk) and matrix: a scan over a tree.

    Upwards, the matrices of ``fan`` neighbours become one in every round, until a document has a single matrix, whose
    ends are the document's. Downwards, the states at the ends of a node give those between its children. A group has
    ``fan`` matrices whatever the document's length, and the rounds grow with its logarithm. Every round is written,
    as both directions read it. ``chunks`` is the largest number of chunks of a document.
    """
    numbers = ["k", "o", "k2", "o2"]
    parent = F.floor(F.col("node") / fan).cast("int")

    def join(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        ordered = nodes.sort_values("node")
        return pd.DataFrame({"row": [key[0]], "node": [key[1]], "matrix": [_bytes(product([_matrix(x) for x in ordered["matrix"]]))]})

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [boundaries([_matrix(x)]) for x in batch["matrix"]]
            sides = pd.DataFrame([(*a, *b) for a, b in found], columns=numbers, index=batch.index)
            yield pd.concat([batch[["row", "node"]], sides], axis=1)

    def split(key: tuple, nodes: pd.DataFrame, sides: pd.DataFrame) -> pd.DataFrame:
        ordered = nodes.sort_values("node", ignore_index=True)
        k, o, k2, o2 = sides[numbers].iloc[0].tolist()
        states = boundaries([_matrix(x) for x in ordered["matrix"]], (k, o), (k2, o2))
        found = [(*a, *b) for a, b in zip(states, states[1:], strict=False)]
        return pd.concat([ordered[["row", "node"]], pd.DataFrame(found, columns=numbers)], axis=1)

    levels, width = [stored(leaves, "matrices")], chunks
    while width > 1:
        above = levels[-1].groupBy("row", parent.alias("up")).applyInPandas(join, "row bigint, node int, matrix binary")
        levels.append(stored(above, "matrices"))
        width = -(-width // fan)
    sides = levels.pop().mapInPandas(ends, _SIDES)
    for level in reversed(levels):
        children = level.withColumn("up", parent).groupBy("row", "up")
        sides = children.cogroup(sides.groupBy("row", "node")).applyInPandas(split, _SIDES)
    return sides


def _bytes(matrix: dict) -> bytes:
    rows = [(*s, *t) for s, ts in matrix.items() for t in ts]
    return np.array(rows, "<i4").tobytes()


def _matrix(raw: bytes) -> dict:
    found: dict = {}
    for a, b, c, d in np.frombuffer(raw, "<i4").reshape(-1, 4).tolist():
        found.setdefault((a, b), []).append((c, d))
    return found


_ENCODED = "doc_id bigint, chunk int, chunks int, ids array<int>, round_trip boolean"


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """The ids of every document: doc_id, chunk (from 0), chunks, ids, and round_trip.

    A document of at most ``chunk`` characters is one row; of a longer one each chunk is a row with the ids of the
    pieces that start in it, and the document's ids are those of its chunks in order. They equal the library's for
    the whole text. ``round_trip`` says whether the ids decode to the text that they stand for. Null and empty texts
    have one row without ids. Rows that repeat are encoded each by itself; an empty table gives no rows; further
    columns are not carried along.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # A chunk is much work for its size, so that the number of tasks must not follow from the bytes.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = model(path).library
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = library.encode(texts, num_threads=1)
                same = [a == b for a, b in zip(texts, library.decode(ids, num_threads=1), strict=True)]
                n = len(texts)
                columns = [pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(same)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "chunk", "chunks", "ids", "round_trip"])

    short = rows.where(~long).mapInArrow(whole, _ENCODED)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        margin = model(path).longest
        for batch in batches:
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                seen = marked(text)
                chunks = -(-len(seen) // chunk)
                out = []
                for n in range(chunks):
                    low, high = n * chunk, min(len(seen), (n + 1) * chunk)
                    begin = max(0, low - margin)
                    out.append((row, doc_id, n, chunks, seen[begin : high + margin], low - begin, high - begin))
                    if len(out) == 64 or n == chunks - 1:
                        yield pd.DataFrame(out, columns=["row", "doc_id", "chunk", "chunks", "text", "low", "high"])
                        out = []

    giants = rows.where(long).withColumn("row", F.monotonically_increasing_id())
    shape = "row bigint, doc_id bigint, chunk int, chunks int, text string, low int, high int"
    # Written once, as the rows' numbers have to be the same in both passes over the chunks.
    parts = stored(giants.mapInPandas(cut, shape), "giant-chunks")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for batch in batches:
            found = [_bytes(transfer(m, t, a, b)) for t, a, b in zip(batch["text"], batch["low"], batch["high"], strict=True)]
            yield pd.DataFrame({"row": batch["row"], "node": batch["chunk"], "matrix": found})

    # Every chunk is a task's row of its own; only matrices of a few numbers meet, those of neighbours.
    spread = parts.repartition(tasks, F.col("row"), F.col("chunk"))
    leaves = spread.mapInPandas(matrices, "row bigint, node int, matrix binary")
    most = parts.agg(F.max("chunks")).first()[0] or 0
    states = scan(leaves, most, fan).withColumnRenamed("node", "chunk")

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                ids = trace(m, r.text, r.low, r.high, (r.k, r.o), (r.k2, r.o2))
                covered = r.text[min(r.low + r.o, r.high + r.o2) : r.high + r.o2]
                out.append((r.doc_id, r.chunk, r.chunks, ids, _text(m, ids) == covered))
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "chunks", "ids", "round_trip"])

    return short.unionByName(parts.join(states, ["row", "chunk"]).mapInPandas(traced, _ENCODED))


def _text(m: Model, ids: list[int]) -> str:
    """The marked text of ids: pieces as they are, runs of byte ids as the characters they spell."""
    out, raw = [], bytearray()
    for i in ids:
        if m.library.is_byte(i):
            raw.append(int(m.library.id_to_piece(i)[3:5], 16))
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
        out.append(m.library.id_to_piece(i))
    return "".join(out) + raw.decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every document of ``encode``; a document's chunks meet, and nothing else.

    Ids outside the vocabulary stop the job. A document without ids has an empty text. Documents have to differ in
    doc_id if they have several chunks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(path)
        for batch in batches:
            texts = [_text(m, [int(i) for i in ids]).replace(SPACE, " ") for ids in batch["ids"]]
            yield batch[["doc_id", "chunk", "chunks"]].assign(text=texts)

    parts = encoded.select("doc_id", "chunk", "chunks", "ids").mapInPandas(run, "doc_id bigint, chunk int, chunks int, text string")
    one = parts.where("chunks = 1").select("doc_id", "text")
    many = parts.where("chunks > 1").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
    joined = one.unionByName(many.select("doc_id", F.array_join(F.col("parts")["text"], "").alias("text")))
    # The mark that encoding puts in front.
    return joined.select("doc_id", F.expr("substring(text, 2)").alias("text"))
