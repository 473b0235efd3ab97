"""Quality rules: rule statistics of every document, and an isolation forest over them.

Statistics are counts and shares of a whole text. The forest is grown on a bounded sample of labelled documents, on a
scale of ranks; a tree splits a small sample at random values until its points are alone, and a document that falls
out of the tree after few splits is an anomaly. Nothing but path lengths makes a score. The threshold comes from the labelled documents: the lowest score that refuses at
most a given share of the good ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
STATISTICS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
# What the forest sees: shares and means, so that the length of a text alone is no anomaly.
FEATURES = ["symbols", "dup_lines", "repeats", "word_length", "capitals", "digits", "ends", "top_word", "distinct"]


def statistics_of(text: str | None) -> tuple[list[int], list[float]]:
    """Counts of one text and its features. A null text has no words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at runs of ASCII white space
    n = len(words)
    white = sum(text.count(c) for c in "\t\n\x0b\x0c\r ")
    chars = len(text) - white
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[bytes] = set()
    lines = dups = ends = 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            dups += line in seen
            seen.add(line)
            ends += line.rstrip()[-1:] in b".!?"
    if not n:
        return [0, 0, symbols, 0, 0], [0.0] * len(FEATURES)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    repeats = _repeated(ids, len(numbers))
    capitals = sum(map(str.isupper, text)) if not text.isascii() else sum(map(raw.count, _CAPITALS))
    digits = sum(map(raw.count, _DIGITS))
    features = [
        symbols / max(chars, 1),
        dups / max(lines, 1),
        repeats / n,
        chars / n,
        capitals / max(chars, 1),
        digits / max(chars, 1),
        ends / max(lines, 1),
        np.bincount(ids).max() / n,
        len(numbers) / n**0.8,
    ]
    return [n, chars, symbols, dups, repeats], features


_CAPITALS = [bytes([c]) for c in range(65, 91)]
_DIGITS = [bytes([c]) for c in range(48, 58)]


def _repeated(ids: np.ndarray, kinds: int) -> int:
    """Words that lie in a window of three words which the text has at least twice."""
    if len(ids) < 4:
        return 0
    # Pairs are numbered anew before the third word is added, so that no code overflows.
    pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
    _, window, times = np.unique(pairs[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    often = times[window] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : i + len(often)] |= often
    return int(covered.sum())


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts and the features of every row.

    A null or empty text has no words. Rows that repeat give rows that repeat, an empty table none; ids may be null;
    further columns, whatever their names, are not carried along. A text of any length is counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, features = _measured(batch.column("text"))
            columns = [batch.column("doc_id"), *[pa.array(c) for c in counts.T], pa.array(features.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", *[c.split()[0] for c in STATISTICS.split(", ")], "features"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, {STATISTICS}, features array<double>")


def _measured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    found = [statistics_of(t.as_py()) for t in texts]
    counts = np.array([c for c, _ in found], np.int64).reshape(len(found), 5)
    return counts, np.array([f for _, f in found]).reshape(len(found), len(FEATURES))


@dataclass
class Scale:
    """Features on the scale of the fitted documents: ranks among them from 0 to 1, and beyond their range up to one
    more, as a share of the range of all labelled documents."""

    ordered: np.ndarray  # each feature's values, ascending
    width: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        low, high = self.ordered[0], self.ordered[-1]
        ranks = [np.searchsorted(o, c, "left") + np.searchsorted(o, c, "right") for o, c in zip(self.ordered.T, x.T, strict=True)]
        over = np.clip((x - high) / self.width, 0, 1) - np.clip((low - x) / self.width, 0, 1)
        return np.stack(ranks, 1) / 2 / len(self.ordered) + over


@dataclass
class Forest:
    """Trees in common arrays, a root for each: feature (-1 at a leaf), value, left child (the right one is next), and
    path length at a leaf."""

    roots: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    size: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1): 2 to the power of minus the mean path length over the expected one."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root, np.int32)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.value[at]
                at = np.where(inner, self.left[at] + right, at)
            total += self.length[at]
        return 2.0 ** (-total / len(self.roots) / _expected(self.size))


def _expected(n: int) -> float:
    """Mean path length of a failed search among n points in a random binary tree."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def grow(points: np.ndarray, trees: int = 200, size: int = 128, margin: float = 0.3, seed: int = 7) -> Forest:
    """Grows trees on random samples of ``size`` points each.

    A split is drawn from the range of a node's points and a ``margin`` on both sides, of any feature: a point beyond
    what the sample has seen then falls into an empty branch early, also where all sampled points have one value.
    """
    random = np.random.default_rng(seed)
    size = min(size, len(points))
    depth = int(np.ceil(np.log2(max(size, 2)))) + 8
    feature, value, left, length, roots = [], [], [], [], []

    def node() -> int:
        for column, empty in ((feature, -1), (value, 0.0), (left, 0), (length, 0.0)):
            column.append(empty)
        return len(feature) - 1

    for _ in range(trees):
        roots.append(node())
        todo = [(roots[-1], points[random.choice(len(points), size, replace=False)], 0)]
        while todo:
            at, own, level = todo.pop()
            if level >= depth or len(own) <= 1:
                length[at] = level + _expected(len(own))
                continue
            f = int(random.integers(points.shape[1]))
            v = np.float32(random.uniform(own[:, f].min() - margin, own[:, f].max() + margin))
            right = own[:, f] >= v
            feature[at], value[at], left[at] = f, v, node()
            todo += [(left[at], own[~right], level + 1), (node(), own[right], level + 1)]
    small = [np.array(roots, np.int32), np.array(feature, np.int8), np.array(value, np.float32), np.array(left, np.int32)]
    return Forest(*small, np.array(length, np.float32), size)


@dataclass
class Model:
    forest: Forest | None
    threshold: float
    scale: Scale | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Forest scores, 0 without a forest."""
        return self.forest.scores(self.scale(x)) if self.forest else np.zeros(len(x))


def labelled(labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """At most ``sample`` labelled ids with their quality: those with the smallest hashes, a choice that repeats.

    Hashes above what a little more than the sample needs are left out first, so that one task sorts the sample only.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    parts = 1 << 40
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    share = min(1.0, 1.2 * (sample + 100) / max(1, known.count()))
    return known.where(spread <= int(share * parts)).orderBy(spread, "doc_id").limit(sample)


def fit(measured: DataFrame, sampled: DataFrame, refused: float = 0.002) -> Model:
    """Grows the forest on labelled good documents and calibrates the threshold on labelled rows.

    ``sampled`` comes from ``labelled``, whose number of rows is bounded; ``measured`` has to hold the statistics of
    these documents. The forest learns what good documents (quality 1) look like from one half of them; the
    threshold is the score that at most a share ``refused`` of the other half exceeds, raised to the middle between
    it and the next score of a bad document. Documents that fail the base rules do not take part. With fewer than
    ``LEAST_GOOD`` good documents there is nothing to learn from: the model has no forest and refuses nothing beyond
    the base rules, and ``judge`` says so in ``judged_by``.
    """
    rows = (
        measured.where(~base_failed())
        .join(F.broadcast(sampled), "doc_id")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.min("features").alias("features"))
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["features"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fitted(x, np.array([r["quality"] == 1 for r in rows], bool), refused)


LEAST_GOOD = 20


def fitted(x: np.ndarray, good: np.ndarray, refused: float = 0.002) -> Model:
    """``fit`` on features and labels that are at hand."""
    if good.sum() < LEAST_GOOD:
        return Model(None, 1.0)
    own, held = x[good][::2], x[good][1::2]
    scale = Scale(np.sort(own, 0), np.maximum(x.max(0) - x.min(0), 1e-9))
    model = Model(grow(scale(own)), 1.0, scale)
    scores = np.sort(model.scores(held))
    bad = model.scores(x[~good])
    floor = scores[min(len(scores) - 1, int(np.ceil(len(scores) * (1 - refused))) - 1)]
    above = bad[bad > floor]
    model.threshold = float((floor + above.min()) / 2) if len(above) else float(floor)
    return model


def base_failed():
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def judge(measured: DataFrame, model: Model) -> DataFrame:
    """The counts with base_failed, anomaly (the score), kept, and judged_by (``forest``, or ``base rules`` if there was
    nothing to learn from). kept is false for base failures and for scores above the threshold; a score that equals it
    stays. Every row is judged by itself: rows that repeat get one verdict, null ids stay, an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("features").to_pylist()).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(x))], [*batch.schema.names[:-1], "anomaly"])

    failed = base_failed()
    return measured.mapInArrow(run, f"doc_id bigint, {STATISTICS}, anomaly double").withColumns(
        {
            "base_failed": failed,
            "kept": ~failed & (F.col("anomaly") <= F.lit(float(model.threshold))),
            "judged_by": F.lit("forest" if model.forest else "base rules"),
        }
    )


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns; each text is read once and none is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, x = _measured(batch.column(text_col))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            yield batch.filter(pa.array(~failed & ~(model.scores(x) > model.threshold)))

    return docs.mapInArrow(run, docs.schema)
