"""Text expressions. Offsets and cut lengths are bytes, token costs are characters."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Never occurs in a byte view, whose characters are all below U+0100.
PAD = "Ā"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte_view(c) -> Column:
    """The UTF-8 bytes of a string as a string with one character per byte.

    Regexes, ``split``, ``length`` and ``substring`` on it count bytes.
    """
    return F.decode(col(c).cast("binary"), "ISO-8859-1")


def byte_view_of_binary(c) -> Column:
    """Byte view of a BINARY column, for files read whole."""
    return F.decode(col(c), "ISO-8859-1")


def from_byte_view(c) -> Column:
    """The text whose byte view is given; broken sequences become U+FFFD."""
    return F.make_valid_utf8(F.encode(col(c), "ISO-8859-1").cast("string"))


def needle_bytes(needle: str) -> str:
    """Byte view of a Python string."""
    return needle.encode("utf-8").decode("latin-1")


def java_quote(s: str) -> str:
    """Regex matching exactly ``s`` in Java's syntax."""
    return "".join(ch if ch.isalnum() or ord(ch) > 127 else "\\" + ch for ch in s)


def ascii_lower(c) -> Column:
    """Lower-case A-Z only, as LIKE does in engines without Unicode folding."""
    return F.translate(col(c), string.ascii_uppercase, string.ascii_lowercase)


def like_anywhere(c, text: str) -> Column:
    """``LIKE %text%``, ASCII-case-insensitive; % and _ in ``text`` are wildcards."""
    escape = next(ch for ch in map(chr, range(1, 0x100)) if ch not in text and ch not in "%_")
    pattern = "".join(ch.lower() if ch in string.ascii_uppercase else ch for ch in text)
    return F.like(ascii_lower(c), F.lit(f"%{pattern}%"), F.lit(escape))


def contains_bytes(c, needle: str) -> Column:
    """Case-sensitive substring test; an empty needle matches nothing.

    Equal to a byte search because both sides are valid UTF-8, and a native
    predicate that is pushed into the Parquet scan.
    """
    if needle == "":
        return F.lit(False)
    return F.contains(col(c), F.lit(needle))


def contains_nocase(c, needle: str) -> Column:
    """Case-insensitive substring test; an empty needle matches everything."""
    return F.contains(F.lower(col(c)), F.lit(needle.lower()))


def content_hash(c) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def estimate_tokens(c) -> Column:
    """Characters divided by four, rounded down."""
    return F.shiftright(F.length(col(c)), 2).cast("bigint")


def time_ago(then_s, now_s) -> Column:
    """``Ns/Nm/Nh/Nd ago`` between two epoch-second columns."""
    delta = col(now_s) - col(then_s)
    units = [(60, 1, "s"), (3600, 60, "m"), (86400, 3600, "h"), (None, 86400, "d")]
    out = None
    for below, size, unit in units:
        text = F.concat(F.floor(delta / size).cast("string"), F.lit(unit + " ago"))
        if out is None:
            out = F.when(delta < below, text)
        elif below is None:
            out = out.otherwise(text)
        else:
            out = out.when(delta < below, text)
    return out


def truncate_bytes(c, limit: int) -> Column:
    """Text of more than ``limit`` bytes cut to ``limit - 3`` bytes plus ``...``.

    A character broken by the cut is dropped.
    """
    text = col(c)
    cut = F.substring(byte_view(text), 1, limit - 3)
    broken_tail = r"(?:[\xc2-\xdf]|[\xe0-\xef][\x80-\xbf]?|[\xf0-\xf4][\x80-\xbf]{0,2})\z"
    whole = from_byte_view(F.regexp_replace(cut, broken_tail, ""))
    return F.when(F.octet_length(text) > limit, F.concat(whole, F.lit("..."))).otherwise(text)


def preview(c, chars: int) -> Column:
    """First ``chars`` characters for a listing."""
    return F.substring(col(c), 1, chars)


def lines_universal(c) -> Column:
    """Lines with ``\\r\\n``, ``\\r`` and ``\\n`` all ending one; no empty last line."""
    parts = F.split(col(c), r"\r\n|\r|\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def rstrip(c) -> Column:
    """Strip trailing whitespace, Unicode spaces and the ASCII separators included."""
    space = r"[\s\x1c-\x1f]"
    return F.regexp_replace(col(c), rf"(?U)(?<!{space}){space}++\z", "")


def strip(c) -> Column:
    space = r"[\s\x1c-\x1f]"
    return rstrip(F.regexp_replace(col(c), rf"(?U)\A{space}++", ""))
