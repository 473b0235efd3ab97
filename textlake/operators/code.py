"""Table of exported functions out of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import code as C
from ..functions.text import contains_nocase, from_byte_view, lines_universal, rstrip, strip
from .offsets import bytes_of, holds, match_rows, running_position

_BRACE = "[{}]"


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _events(files: DataFrame, keys, b: Column, at: str, carry=(), measure=None) -> DataFrame:
    """Braces (and whatever else ``at`` matches) of every file in order.

    Adds ``position``, ``line`` (newlines before the event) and ``level``. A
    brace and its partner share a level: the depth outside of the pair.
    """
    measure = {"kind": lambda p: F.substring(p, 1, 1), "newlines": _newlines, **(measure or {})}
    rows = match_rows(files, keys, b, at, carry, measure)
    in_file = W.partitionBy(*keys).orderBy("ord")
    before = in_file.rowsBetween(W.unboundedPreceding, -1)
    upto = in_file.rowsBetween(W.unboundedPreceding, W.currentRow)
    step = F.when(F.col("kind") == "{", 1).when(F.col("kind") == "}", -1).otherwise(0)
    depth = F.sum(step).over(upto)
    return rows.select(
        "*",
        running_position(keys).alias("position"),
        F.coalesce(F.sum("newlines").over(before), F.lit(0)).alias("line"),
        F.when(F.col("kind") == "{", depth - 1).when(F.col("kind") == "}", depth).alias("level"),
    )


def _with_partner(events: DataFrame, keys) -> DataFrame:
    """Position and line of the brace that closes each ``{``, NULL if none does.

    The next event of the same level is the partner. Partitioning by the file
    keys already satisfies (keys, level): this is a sort, not a shuffle.
    """
    same_level = W.partitionBy(*keys, "level").orderBy("ord")
    is_open = F.col("kind") == "{"
    return events.select(
        "*",
        F.when(is_open, F.lead("position").over(same_level)).alias("close_position"),
        F.when(is_open, F.lead("line").over(same_level)).alias("close_line"),
    )


def brace_depth(files: DataFrame, keys, content="content") -> DataFrame:
    """(keys, open_position, level, close_position) of every ``{``."""
    events = _events(files.where(holds(files, content, "{")), keys, bytes_of(files, content), _BRACE)
    pairs = _with_partner(events, keys).where("kind = '{'")
    return pairs.select(
        *keys,
        F.col("position").alias("open_position"),
        F.col("level").cast("bigint").alias("level"),
        "close_position",
    )


def _slices(files: DataFrame, keys, content, slice_bytes: int) -> DataFrame:
    """Every text as rows of ``slice_bytes`` bytes: keys, slice, part, and the braces still open in front of it."""
    part = lambda i: F.substring(F.col("_bytes"), i * slice_bytes + 1, F.lit(slice_bytes))
    many = lambda p, brace: F.length(p) - F.length(F.replace(p, F.lit(brace), F.lit("")))
    view = lambda p: F.decode(p, "ISO-8859-1")
    last = F.floor((F.octet_length("_bytes") - 1) / slice_bytes).cast("int")
    cut = files.select(*keys, F.col(content).cast("binary").alias("_bytes")).select(
        *keys, F.transform(F.sequence(F.lit(0), last), lambda i: view(part(i))).alias("_parts")
    )
    steps = F.transform("_parts", lambda p: (many(p, "{") - many(p, "}")).cast("bigint"))
    sums = F.aggregate(steps, F.array(F.lit(0).cast("bigint")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    summed = cut.select(*keys, "_parts", F.slice(sums, 1, F.size("_parts")).alias("_open"))
    return summed.select(*keys, F.posexplode(F.arrays_zip(F.col("_parts").alias("part"), F.col("_open").alias("open"))).alias("slice", "s")).select(
        *keys, "slice", "s.part", "s.open"
    )


def brace_depth_sliced(files: DataFrame, keys, content="content", slice_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``brace_depth``, for tables with giant texts: each is dealt over tasks in slices.

    The summary of a slice is by how much it changes the depth; sums of these put the levels of different slices on one
    scale. Partners inside a slice are found there. Of each slice and level only the first and the last event can have
    a partner elsewhere, which is the next of these in the file.
    """
    slices = _slices(files.where(holds(files, content, "{")), keys, content, slice_bytes)
    own = [*keys, "slice"]
    events = _events(slices.repartition(*own), own, F.col("part"), _BRACE, ["open"], measure={"newlines": lambda p: F.lit(0)})
    in_level = W.partitionBy(*own, "level").orderBy("ord")
    found = events.where("ord > 0").select(
        *keys,
        "slice",
        "kind",
        (F.col("level") + F.col("open")).cast("bigint").alias("level"),
        (F.col("position") + F.col("slice").cast("bigint") * slice_bytes).alias("position"),
        F.lag("ord").over(in_level).isNull().alias("first"),
        F.lead("position").over(in_level).alias("near"),
    )
    found = found.withColumn("near", F.col("near") + F.col("slice").cast("bigint") * slice_bytes)
    edge = F.col("first") | F.col("near").isNull()
    needed = found.where((F.col("kind") == "{") | edge).withColumn("group", F.when(edge, -1).otherwise(F.col("slice")))
    later = F.lead("position").over(W.partitionBy(*keys, "level", "group").orderBy("position"))
    paired = needed.withColumn("later", later).where("kind = '{'")
    return paired.select(
        *keys, F.col("position").alias("open_position"), "level", F.coalesce("near", "later").alias("close_position")
    )


def _with_first_open(events: DataFrame, keys) -> DataFrame:
    """The first ``{`` at or after every event, as a running last value read backwards.

    A frame of current row to unbounded following would be recomputed per row.
    """
    backwards = W.partitionBy(*keys).orderBy(F.desc("ord")).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = F.when(F.col("kind") == "{", F.struct("position", "close_position", "close_line"))
    return events.withColumn("open", F.last(here, ignorenulls=True).over(backwards))


_EXPORT_OR_BRACE = C.EXPORT + "|" + _BRACE
# The rest of a line behind an export, up to a parenthesis.
_NAME = "(?s)^" + C.EXPORT + r"([^(\n]*).*"


def _export_events(files: DataFrame, keys, content) -> DataFrame:
    exporting = files.where(holds(files, content, C.EXPORT)).select(
        *keys, bytes_of(files, content).alias("_text")
    )
    flagged = exporting.select(
        *keys,
        "_text",
        C.type_flags("_text").alias("type_mask"),
        C.call_flags("_text").alias("intrinsics_mask"),
        C.arch_tag("_text").alias("arch"),
        _newlines(F.col("_text")).alias("file_newlines"),
        # Bytes in front of the last parenthesis, -1 if there is none.
        (F.length("_text") - F.length(F.substring_index("_text", "(", -1)) - 1).alias("last_paren"),
    )
    carry = ["type_mask", "intrinsics_mask", "arch", "file_newlines", "last_paren"]
    # A piece ends at the next export or brace, so that the names of a text together are no longer than the text.
    measure = {"name": lambda p: F.when(F.startswith(p, F.lit(C.EXPORT)), F.regexp_extract(p, _NAME, 1))}
    events = _events(flagged, keys, F.col("_text"), _EXPORT_OR_BRACE, carry, measure=measure)
    return _with_first_open(_with_partner(events, keys), keys).where("kind = 'e'")


def first_open_brace(files: DataFrame, keys, content="content") -> DataFrame:
    """(keys, position, open_position): first ``{`` at or after each export, if any."""
    return _export_events(files, keys, content).select(
        *keys, "position", F.col("open.position").alias("open_position")
    )


def extract_functions(files: DataFrame, keys, content="content") -> DataFrame:
    """One row per exported function: an export with a parenthesis somewhere behind it.

    The name is what follows on the line up to a parenthesis, brace or further export, without white space at its
    ends. ``keys`` identify a file and ``content`` is its text or its bytes. Width, architecture and masks are those
    of the whole file. One shuffle of the events by file; the text stays behind in the map stage, and what leaves it
    grows linearly with the text.
    """
    named = _export_events(files, keys, content).where(F.col("last_paren") > F.col("position"))
    line_count = (
        F.when(F.col("open").isNull(), 1)
        .otherwise(F.coalesce(F.col("open.close_line"), F.col("file_newlines")) - F.col("line") + 1)
        .cast("bigint")
    )
    return named.select(
        *keys,
        strip(from_byte_view(F.col("name"))).alias("func_name"),
        "position",
        (F.col("line") + 1).cast("bigint").alias("line_start"),
        line_count.alias("line_count"),
        "arch",
        C.simd_width("type_mask").cast("bigint").alias("simd_width"),
        F.col("type_mask").cast("bigint").alias("type_mask"),
        F.col("intrinsics_mask").cast("bigint").alias("intrinsics_mask"),
    )


def file_flags(files: DataFrame, keys, content="content") -> DataFrame:
    """Masks, width, architecture and export count per file, also of files without exports."""
    texts = files.select(*keys, bytes_of(files, content).alias("_text"))
    flagged = texts.select(
        *keys,
        C.count_exports("_text").alias("exports"),
        C.type_flags("_text").cast("bigint").alias("type_mask"),
        C.call_flags("_text").cast("bigint").alias("intrinsics_mask"),
        C.arch_tag("_text").alias("arch"),
    )
    return flagged.withColumn("simd_width", C.simd_width("type_mask").cast("bigint"))


def attach_embeddings(functions: DataFrame, embeddings: DataFrame, key="path") -> DataFrame:
    """Gives every function the vector of its file; the vector is stored once per file.

    Spark takes a computed vector for a few bytes and would send all of them to every executor, by way of the driver;
    the hint has both sides shuffled by file.
    """
    return functions.join(embeddings.hint("merge"), key, "left")


def filter_arch(df: DataFrame, arch) -> DataFrame:
    """Exact match on the stored value, to be applied to finished results."""
    return df.where(F.col("arch") == arch) if arch else df


def search_functions(functions: DataFrame, query: str) -> DataFrame:
    """Functions whose name or path contains ``query`` in any case."""
    return functions.where(contains_nocase("func_name", query) | contains_nocase("path", query))


def first_matches(matches: DataFrame, limit: int | None = 10) -> DataFrame:
    """The first ``limit`` matches in table order (``None``: all) and the number of all of them."""
    total = matches.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    ordered = matches.orderBy("path", "line_start")
    return (ordered if limit is None else ordered.limit(limit)).withColumn("total", total)


def source_snippet(functions: DataFrame, files: DataFrame, text="content", key="path", max_lines=None, few: bool = False) -> DataFrame:
    """Adds ``snippet``: the lines of each function, clipped to the end of the file.

    With ``max_lines`` longer functions give NULL. The ranges that are asked for are collected by file first, so
    that a text is joined and split once and only slices of it are copied. Texts, ranges and snippets are shuffled by
    file, as there can be as many of each as there are files. ``few`` says that the functions come out of a limit:
    their ranges are sent to the texts, and files that none asks for stay where they are.
    """
    asked = functions.select(key, "line_start", "line_count").distinct()
    ranges = asked.groupBy(key).agg(F.collect_list(F.struct("line_start", "line_count")).alias("_ranges"))
    texts = files.select(key, F.col(text).alias("_text"))
    joined = texts.join(F.broadcast(ranges), key) if few else texts.join(ranges.hint("merge"), key)
    split = joined.select(key, lines_universal(F.col("_text")).alias("_lines"), "_ranges")
    start = lambda r: F.greatest(F.lit(0), r["line_start"] - 1)
    end = lambda r: F.least(F.size("_lines"), start(r) + r["line_count"])
    taken = lambda r: F.greatest(end(r) - start(r), F.lit(0)).cast("int")
    cut = F.transform(
        "_ranges",
        lambda r: F.struct(
            r["line_start"].alias("line_start"),
            r["line_count"].alias("line_count"),
            taken(r).alias("taken"),
            F.array_join(F.slice("_lines", (start(r) + 1).cast("int"), taken(r)), "\n").alias("body"),
        ),
    )
    pieces = split.select(key, F.inline(cut))
    shown = rstrip(F.col("body"))
    if max_lines is not None:
        shown = F.when(F.col("taken") <= max_lines, shown)
    snippets = pieces.select(key, "line_start", "line_count", shown.alias("snippet"))
    return functions.join(snippets if few else snippets.hint("merge"), [key, "line_start", "line_count"], "left")


def index_stats(functions: DataFrame, files: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: functions, files (also those without exports) and catalog entries."""
    count = lambda df: df.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    return files.groupBy().agg(F.count(F.lit(1)).alias("file_count")).select(
        count(functions).alias("function_count"), count(catalog).alias("ref_count"), "file_count"
    )


