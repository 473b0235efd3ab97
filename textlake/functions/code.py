"""File-level flags of source texts, on the byte view of the file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Bit, vector type name.
TYPE_BITS = [
    (1, "f32x4"),
    (2, "f32x8"),
    (4, "f32x16"),
    (8, "i32x4"),
    (16, "i32x8"),
    (32, "i32x16"),
    (64, "u8x16"),
]

# Bit, call name.
CALL_BITS = [
    (1, "reduce_add"),
    (2, "fma"),
    (4, "splat"),
    (8, "load"),
    (16, "store"),
    (32, "select"),
    (64, "sqrt"),
]

EXPORT = "export func "


def _or_bits(bits) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def type_flags(b) -> Column:
    """Bit set of the vector type names that occur anywhere in the text."""
    return _or_bits([F.when(F.contains(col(b), F.lit(name)), F.lit(bit)).otherwise(F.lit(0)) for bit, name in TYPE_BITS])


def call_flags(b) -> Column:
    """Bit set of the calls that occur: the name, not as the end of a longer one, and an opening parenthesis.

    The substring test is cheap and keeps the pattern away from texts without the call.
    """
    called = lambda name: F.contains(col(b), F.lit(f"{name}(")) & col(b).rlike(rf"(?<![A-Za-z0-9_]){name}\(")
    return _or_bits([F.when(called(name), F.lit(bit)).otherwise(F.lit(0)) for bit, name in CALL_BITS])


def simd_width(type_mask) -> Column:
    """16, 8, 4 or 0 lanes: the widest float vector of the mask."""
    mask = col(type_mask)
    widest = F.when(mask.bitwiseAND(4) > 0, 16).when(mask.bitwiseAND(2) > 0, 8)
    return widest.when(mask.bitwiseAND(1) > 0, 4).otherwise(0)


def arch_tag(b) -> Column:
    """``aarch64`` if the word occurs in any case, else ``x86_64``."""
    return F.when(F.contains(F.lower(col(b)), F.lit("aarch64")), "aarch64").otherwise("x86_64")


def count_exports(b) -> Column:
    text = col(b)
    return ((F.length(text) - F.length(F.replace(text, F.lit(EXPORT), F.lit("")))) / len(EXPORT)).cast("bigint")
