"""Terms of texts as bytes, and small sets of them that every task may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame

# A set goes to every task only up to this number of entries; beyond it the callers join.
SENT_TERMS = 200_000


def separators(kept: bytes) -> bytes:
    """A table for ``bytes.translate``: ``kept`` and every byte of a character beyond ASCII stay, A-Z become a-z, and
    all other bytes become spaces. What ``split`` then gives are the runs of kept characters, because all bounds of
    such a run are ASCII."""
    return bytes(b | 32 if 65 <= b <= 90 and b in kept else b if b >= 128 or b in kept else 32 for b in range(256))


LETTERS = bytes([*range(65, 91), *range(97, 123)])
DIGITS = bytes(range(48, 58))


def sent(table: DataFrame, most: int = SENT_TERMS):
    """A broadcast of the rows of a table, as a dictionary from the first column to the set of the second (a table of
    one column: under the key None), or None if there are more than ``most`` of them."""
    if table.limit(most + 1).count() > most:
        return None
    sets: dict = {}
    for row in table.collect():
        sets.setdefault(row[0] if len(row) > 1 else None, set()).add(bytes(row[-1]))
    return table.sparkSession.sparkContext.broadcast(sets)
