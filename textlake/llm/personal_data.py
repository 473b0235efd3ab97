"""Personal data by patterns and a skip-chain conditional random field.

Patterns find mentions that have a complete form. Every other word with a digit or an at sign is a variable of a
random field whose labels are ``O`` and the four kinds: neighbouring words share a chain potential, and words that
repeat, or are similar to, one another anywhere in the document share a skip potential. Words inside a pattern's
mention are observed. Loopy message passing over the whole document then gives each variable its marginals, so that
an incomplete form (a number without its prefix, an address without its domain) takes the kind of the mention that it
repeats, and one that repeats nothing stays out. That is the field's verdict, which every document with a variable
gets, also one without any mention.

The weights are fitted on a bounded sample by pseudo-likelihood: mentions found by the patterns are written again in
incomplete forms beside the document, some linked to their mention (their label is the kind) and some with other
digits (their label is O; beside a card they pass the card check too, so that the link and not the check tells them
apart); the sample's own words outside of mentions are O as well.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *KINDS]

# Written so that no start is tried twice: a long run of digits or letters costs its length.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ADDRESS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_QUADS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")
# A word that a digit or an at sign stands in.
_WORD = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_AROUND = re.compile(r"^[^\w(+\[]+|[^\w)\]]+$")


def _digits(text: str) -> str:
    return "".join(_NUMBER.findall(text))


def _luhn(digits: str) -> bool:
    turned = digits[::-1]
    return (sum(map(int, turned[::2])) + sum(sum(divmod(2 * int(d), 10)) for d in turned[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    at = text.find("@")
    while at >= 0:
        domain, start = _DOMAIN.match(text, at), at
        # Runs of address characters hold no at sign, so that each is walked once.
        while domain and start > free and text[start - 1] in _ADDRESS:
            start -= 1
        if start < at:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", at + 1)


def mentions(text: str) -> list[tuple[int, int, int]]:
    """Complete mentions: start, kind (its place in ``KINDS``) and end, in this order. A match that fails its check is
    dropped, and the search goes on behind it."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    for m in _QUADS.finditer(text):
        parts = list(_NUMBER.finditer(m[0]))
        for i in range(0, len(parts) - 3, 4):
            if all(len(p := n[0].lstrip("0")) < 4 and int(p or 0) <= 255 for n in parts[i : i + 4]):
                found.append((m.start() + parts[i].start(), 1, m.start() + parts[i + 3].end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


# Words before a mention that name its kind.
CUES = {
    "email": {"email", "e-mail", "mail", "mailto", "correo", "courriel", "contact"},
    "ip": {"ip", "host", "server", "address", "adresse"},
    "card": {"card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "fax", "mobile", "telefon", "teléfono", "téléphone"},
}
_SIZES = [1, 2, 3, 4, 5, 7, 8, 10, 12, 20]
_MARKS = ["@", "+", "-", "(", ".", "/", ":", "_", "=", "*"]
N_FEATURES = 1 + len(_SIZES) + len(_MARKS) + 5 + 4 + len(KINDS)


def features(word: str, before: str = "") -> list[int]:
    """Numbers of the features that a word has: how many digits, which marks, how many dots between digits, letters,
    whether it passes the card check, and cues in the words before it."""
    digits = _digits(word)
    n = len(digits)
    out = [0, 1 + sum(n >= s for s in _SIZES[1:])]
    at = 1 + len(_SIZES)
    out += [at + i for i, mark in enumerate(_MARKS) if mark in word]
    at += len(_MARKS)
    out.append(at + min(4, len(re.findall(r"(?<=[0-9])[.](?=[0-9])", word))))
    at += 5
    out += [at] * any(c.isalpha() for c in word)
    out += [at + 1] * bool(re.search(r"[0-9][A-Za-z]|[A-Za-z][0-9]", word))
    out += [at + 2 + _luhn(digits)] * (12 <= n <= 19)
    at += 4
    cues = {w.strip(":;,.()").casefold() for w in before.split()[-2:]}
    return out + [at + i for i, kind in enumerate(KINDS) if cues & CUES[kind]]


def keys(word: str) -> list[str]:
    """What similar words share: the word itself without case and surrounding marks, the last seven digits of a number,
    the first three parts of a dotted one, and the name in front of an at sign."""
    core = _AROUND.sub("", word).casefold()
    digits = _digits(core)
    out = ["=" + core] if len(digits) >= 4 or "@" in core else []
    parts = re.split(r"[.,_:/-]", core)
    if "@" in core or "(at)" in core or "[at]" in core:
        name = re.split(r"@|[(\[]at", core)[0]
        out += ["@" + name] if len(name) >= 4 else []
    elif len(parts) >= 3 and all(p.isdigit() and len(p) < 4 for p in parts[:3]):
        out.append("." + ".".join(parts[:3]))
    elif len(digits) >= 7 and not re.search(r"[a-z]", core):
        out.append("#" + digits[-7:])
    elif re.fullmatch(r"[a-z0-9._%+-]{4,}", core) and re.search(r"[a-z]", core):
        out.append("@" + core)
    return out


@dataclass
class Words:
    """The words of one document that the field is about."""

    spans: list[tuple[int, int]]  # without surrounding marks
    features: list[list[int]]
    observed: list[int]  # a kind's label, or 0 for a variable
    chain: list[tuple[int, int]]  # neighbouring words
    skip: list[tuple[int, int]]  # each word and the latest one that shares a key with it, and the latest such observed one


def words_of(text: str, found: list[tuple[int, int, int]]) -> Words:
    out = Words([], [], [], [], [])
    latest: dict[tuple[str, bool], int] = {}
    i, end = 0, -2
    for n, m in enumerate(_WORD.finditer(text)):
        a, b = m.span()
        core = _AROUND.sub("", m[0])
        at = a + m[0].find(core)
        out.spans.append((at, at + len(core)))
        out.features.append(features(m[0], text[max(0, a - 40) : a]))
        while i < len(found) and found[i][2] <= a:
            i += 1
        behind = i
        while behind < len(found) and found[behind][0] < b:
            behind += 1
        over = [f for f in found[i:behind] if f[2] > a]
        out.observed.append(min((1 + k for _, k, _ in over), default=0))
        if a == end + 1 and text[end] == " ":
            out.chain.append((n - 1, n))
        end = b
        # A word of a mention stands for the whole of it.
        own, seen = {k for w in (m[0], *[text[s:e] for s, _, e in over]) for k in keys(w)}, bool(over)
        linked = {latest[k, o] for k in own for o in (True, False) if (k, o) in latest and not (o and seen)}
        latest.update({(k, seen): n for k in own})
        out.skip += [(o, n) for o in sorted(linked)]
    return out


# Messages that are worked out at once: their tables of two labels take much more room than the messages.
BLOCK = 1 << 12


@dataclass
class Field:
    """Weights: of features by label, and of the labels of two words by kind of link."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, words: Words, rounds: int = 50, tolerance: float = 1e-4) -> np.ndarray:
        """Loopy message passing (sum-product, damped by half) until no message moves, or for so many rounds."""
        n = len(words.spans)
        own = np.zeros((n, len(LABELS)))
        for i, (f, label) in enumerate(zip(words.features, words.observed, strict=True)):
            if label:
                own[i] = -60.0
                own[i, label] = 0.0
            else:
                own[i] = self.unary[f].sum(0)
        edges = np.array(words.chain + words.skip, np.int64).reshape(-1, 2)
        kind = np.repeat([0, 1], [len(words.chain), len(words.skip)])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair, kind = np.stack([self.chain, self.skip]), np.concatenate([kind, kind])
        back = np.roll(np.arange(len(source)), len(edges))
        sent = np.zeros((len(source), len(LABELS)))

        def beliefs():
            total = own.copy()
            np.add.at(total, target, sent)
            return total

        for _ in range(rounds if len(edges) else 0):
            total, moved, change = beliefs(), np.empty_like(sent), 0.0
            for at in (slice(i, i + BLOCK) for i in range(0, len(source), BLOCK)):
                out = (total[source[at]] - sent[back[at]])[:, :, None] + pair[kind[at]]
                top = out.max(1)
                out = top + np.log(np.exp(out - top[:, None, :]).sum(1))
                moved[at] = 0.5 * (out - out.max(1, keepdims=True)) + 0.5 * sent[at]
                change = max(change, np.abs(moved[at] - sent[at]).max())
            sent = moved
            if change < tolerance:
                break
        total = beliefs()
        shares = np.exp(total - total.max(1, keepdims=True))
        return shares / shares.sum(1, keepdims=True)


def added_spans(text: str, found: list[tuple[int, int, int]], field: Field, least: float) -> list[tuple[int, int, int]]:
    """Further spans (start, kind, end): runs of neighbouring variables of one label whose marginal is above ``least``.

    The field decides about the variables of every document, whether or not it has mentions.
    """
    words = words_of(text, found)
    if all(words.observed):
        return []
    shares = field.marginals(words)
    label = np.where(shares.max(1) > least, shares.argmax(1), 0)
    label[np.array(words.observed) > 0] = 0
    spans: list[tuple[int, int, int]] = []
    for (a, b), kind in zip(words.spans, label.tolist(), strict=True):
        if kind:
            # Numbers are written in several words, addresses are not.
            joins = kind > 2 and spans and spans[-1][1:] == (kind - 1, a - 1) and text[a - 1] == " "
            spans.append((spans.pop()[0] if joins else a, kind - 1, b))
    return spans


def _incomplete(kind: int, text: str) -> list[str]:
    """A mention in forms that the patterns do not take."""
    if kind == 0:
        name, _, host = text.partition("@")
        return [f"{name}(at){host}", f"{name}[at]{host}", f"{name}@{host.split('.')[0]}", f"{name}@"]
    if kind == 1:
        parts = text.split(".")
        return ["-".join(parts), ",".join(parts), ".".join(parts[:3]), ".".join([*parts[:3], "x"])]
    digits = _digits(text)
    if kind == 2:
        return [mark.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for mark in "./_"]
    area, number = digits[-10:-7], digits[-7:]
    return [f"({area}) {number[:3]}-{number[3:]}", area + number, *[mark.join([area, number[:3], number[3:]]) for mark in "-./"]]


def _other(text: str, rnd: random.Random) -> str:
    return re.sub("[0-9]", lambda _: str(rnd.randrange(10)), re.sub("[a-z]", lambda _: rnd.choice("abcdefghijklmnopqrstuvwxyz"), text))


def _checked(kind: int, text: str) -> str:
    """A card with the last digit that the card check asks for; mentions of other kinds as they are."""
    if kind != 2:
        return text
    digits = _digits(text)[:-1]
    return digits + next(d for d in "0123456789" if _luhn(digits + d))


def examples(text: str, most: int = 40) -> list[tuple[list[int], int, list[int], list[int]]]:
    """Training rows of one document, at most ``most`` words of each sort: features, label, labels of the chain
    neighbours, and labels of the skip neighbours."""
    found = mentions(text)
    rnd = random.Random(len(text) * 31 + len(found))
    out = []

    def rows(written: str, kind_of, limit: int) -> None:
        words = words_of(written, mentions(written))
        labels = [o or kind_of(s) for o, s in zip(words.observed, words.spans, strict=True)]
        near: list[tuple[list[int], list[int]]] = [([], []) for _ in labels]
        for which, links in enumerate((words.chain, words.skip)):
            for a, b in links:
                near[a][which].append(labels[b])
                near[b][which].append(labels[a])
        free = [i for i, o in enumerate(words.observed) if not o]
        out.extend((words.features[i], labels[i], *near[i]) for i in free[:limit])

    rows(text, lambda s: 0, most)
    for start, kind, end in found[:most]:
        full = text[start:end]
        other = _other(full, rnd)
        for form, alike, strange in zip(*(_incomplete(kind, m) for m in (full, _checked(kind, other), other)), strict=True):
            # Forms that the patterns take after all are no variables and give no rows.
            rows(f"{full} und {form}", lambda s, n=len(full), k=kind: 1 + k if s[0] >= n else 0, 4)
            rows(f"{full} und {alike}", lambda s: 0, 4)
            rows(f"{strange} und {strange}", lambda s: 0, 4)
    return out


def fit(docs: DataFrame, sample_docs: int = 4_000, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Weights from about ``sample_docs`` documents (those with the smallest hashes) and at most ``sample_rows`` words.

    A kind of which the sample has no mention is never added; without any mention nothing is.
    """
    schema = "at bigint, features array<int>, label int, chain array<int>, skip array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (at, *row)
                for at, text in zip(batch.column("at").to_pylist(), batch.column("text"), strict=True)
                for row in examples(text.as_py() or "")
            ]
            types = [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, ["at", "features", "label", "chain", "skip"])

    parts = 1 << 40
    spread = F.pmod(F.xxhash64(F.col(id_col)), F.lit(parts))
    share = min(1.0, sample_docs / max(1, docs.select(id_col).count()))
    chosen = docs.select(spread.alias("at"), F.col(text_col).alias("text")).where(F.col("at") <= int(share * parts))
    rows = chosen.mapInArrow(run, schema).orderBy("at", "label", "features", "chain", "skip").limit(sample_rows).collect()
    return _fitted(rows)


def _fitted(rows, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Pseudo-likelihood by Adam: a word's label given its features and its neighbours' labels."""
    k = len(LABELS)
    field = Field(np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k)))
    if not any(r["label"] for r in rows):
        field.unary[0, 0] = 10.0
        return field
    x = np.zeros((len(rows), N_FEATURES + 2 * k))
    for i, r in enumerate(rows):
        x[i, r["features"]] = 1
        for at, near in ((N_FEATURES, r["chain"]), (N_FEATURES + k, r["skip"])):
            for label in near:
                x[i, at + label] += 1
    y = np.array([r["label"] for r in rows])
    seen = np.isin(np.arange(k), y)
    w, m, v = (np.zeros((x.shape[1], k)) for _ in range(3))
    for t in range(1, rounds + 1):
        logits = x @ w + np.where(seen, 0.0, -30.0)
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = x.T @ p / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    field.unary, field.chain, field.skip = w[:N_FEATURES], w[N_FEATURES : N_FEATURES + k], w[N_FEATURES + k :]
    field.unary[0] += np.where(seen, 0.0, -30.0)
    # A potential of two labels does not know which of the two words comes first.
    field.chain, field.skip = (field.chain + field.chain.T) / 2, (field.skip + field.skip.T) / 2
    return field


def find(docs: DataFrame, field: Field, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and added of every row.

    The counts and base_sha256 (of kind:start:end, comma-joined) are those of the complete mentions; spans has these
    and what the field adds, in the same form, and added the latter alone. Places are code points, the end exclusive.
    A null text counts as empty and has no spans (the hash is that of an empty text). Rows that repeat give rows that
    repeat, an empty table none; ids may be null; columns other than the two named are not read, whatever their names.
    A text of any length is searched whole, in time that grows with its length; spans that start together are ordered
    by kind.
    """
    columns = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, spans, further = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = mentions(text)
                more = added_spans(text, base, field, least)
                counts.append([sum(k == i for _, k, _ in base) for i in range(len(KINDS))])
                hashes.append(hashlib.sha256(_written(base).encode()).hexdigest())
                spans.append(_written(sorted(base + more)))
                further.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in more])
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            last = [pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(map(len, further), pa.int64())]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, *last, pa.array(further, kind)], columns)

    schema = ", ".join(f"n_{k} bigint" for k in KINDS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        run,
        f"doc_id bigint, {schema}, base_sha256 string, spans string, n_added bigint, added array<struct<kind: string, start: bigint, end: bigint>>",
    )


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
