"""Line deduplication by a deletion-neighbourhood join.

Two lines match if they are equal or one word apart (a word more, less or another). A line's deletion variants are
the line without one of its words; lines that are one word apart share a variant:

* another word at a position: both lines give the same variant by deleting that position;
* a word more: the longer line gives the shorter one as a variant.

So the join needs no pairs. Among the lines that give a variant at the same position, and the line that is the
variant itself, the earliest one is the candidate of all; it is verified on the texts. A line that matches an earlier
one is dropped, the earliest is kept.

Variants are emitted for lines that can have a partner at all: of two lines one word apart, either the first or the
second half is equal. Lines whose halves nobody shares have no variants to offer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm import bloom
from textlake.llm.common import free, stored
from textlake.llm.exact_dedup import normalised

# Lines are within the edit bound from this length on; shorter ones have to be equal. One word of ten is a tenth.
NEAR_WORDS = 10


def _raw_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines that have a word: place (document, line from 0, hash of the document's text) and the line as it is."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("of"), F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    return rows.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]")).select(
        F.struct("doc_id", F.col("line").cast("bigint").alias("line"), "of").alias("place"), "raw"
    )


def _words(raw: Column) -> Column:
    """The words of a line, one space between them."""
    return F.trim(normalised(raw))


def _count(words: Column) -> Column:
    """Number of words between single spaces."""
    return F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit(""))) + 1


def _half_keys(words: Column, count: Column) -> Column:
    """Keys that two lines one word apart share: n is the length of the shorter one, or of both."""
    keys = []
    for less in (0, 1):
        n = count - less
        half = F.floor(n / 2).cast("int")
        part = lambda k: F.call_function("substring_index", words, F.lit(" "), k)
        keys.append(F.xxhash64(n, F.lit("first"), part(half)))
        keys.append(F.xxhash64(n, F.lit("last"), part(half - n)))
    return F.array(*keys)


def line_keys(docs: DataFrame, near_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """place, digest (128 bits of the line's words) and, for lines of at least ``near_words`` words, half keys."""
    rows = _raw_lines(docs, id_col, text_col).select("place", _words(F.col("raw")).alias("words"))
    # Steps of their own, so that each is worked out once a line.
    counted = rows.select("place", "words", _count(F.col("words")).alias("count"))
    keys = F.when(F.col("count") >= near_words, _half_keys(F.col("words"), F.col("count")))
    return counted.select("place", F.substring(F.unhex(F.sha2("words", 256)), 1, 16).alias("digest"), keys.alias("keys"))


def distinct_lines(keyed: DataFrame) -> DataFrame:
    """Each different line once: digest, earliest place, number of copies, and the half keys of long ones."""
    return (
        keyed.groupBy("digest")
        .agg(F.min(F.struct("place", "keys")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("digest", "first.place", "first.keys", "copies")
    )


def _with_partner(distinct: DataFrame) -> DataFrame:
    """place and n of the lines that share a half with another line; n orders them by place."""
    keys = distinct.where("keys IS NOT NULL").select("place", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    found = keys.join(shared, "key", "left_semi").select("place").distinct()
    # Ranges of places go to partitions in order, and a partition's numbers are above those of the ones before it.
    return found.repartitionByRange("place").sortWithinPartitions("place").withColumn("n", F.monotonically_increasing_id())


def deletion_variants(lines: DataFrame, seed: int) -> DataFrame:
    """n, position and variant key: every line without one word, and itself at position -1.

    A key is the exclusive or of hashes of (word, position), so that running values give all variants of a line in
    one pass over its words. ``lines`` has n and words as an array, partitioned by n.
    """
    one = lines.select("n", F.size("words").alias("size"), F.posexplode("words").alias("at", "word"))
    hashed = one.select(
        "n",
        "size",
        "at",
        F.xxhash64(F.lit(seed), "word", F.col("at")).alias("here"),
        F.xxhash64(F.lit(seed), "word", F.col("at") - 1).alias("moved"),  # behind a deleted word
    )
    line = Window.partitionBy("n")
    upto = line.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = hashed.select(
        "*",
        F.bit_xor("here").over(upto).alias("here_upto"),
        F.bit_xor("moved").over(upto).alias("moved_upto"),
        F.bit_xor("moved").over(line).alias("moved_all"),
    )
    without = F.col("here_upto").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("moved_all")).bitwiseXOR(F.col("moved_upto"))
    cut = F.struct(F.col("at").alias("at"), F.xxhash64(F.col("size") - 1, without).alias("key"))
    whole = F.struct(F.lit(-1).alias("at"), F.xxhash64(F.col("size"), "here_upto").alias("key"))
    last = F.col("at") == F.col("size") - 1
    return run.select("n", F.explode(F.when(last, F.array(cut, whole)).otherwise(F.array(cut))).alias("v")).select("n", "v.at", "v.key")


def _within_one_word(a: Column, b: Column) -> Column:
    """Whether two arrays of words are equal or one word apart: behind the equal beginning, one word may differ."""
    unequal = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(unequal, True).cast("int")  # from 1, 0 if one has no unequal word
    rest = lambda w, skip: F.slice(w, at + skip, F.size(w))
    more = F.size(a) - F.size(b)
    return (
        F.when(at == 0, more == 0)
        .when(more == 0, rest(a, 1) == rest(b, 1))
        .when(more == 1, rest(a, 1) == rest(b, 0))
        .when(more == -1, rest(a, 0) == rest(b, 1))
        .otherwise(False)
    )


def match_lines(docs: DataFrame, keyed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each different line: digest, place of its earliest copy, number of copies, and first.

    ``first`` is the place of the earliest line that equals it or is one word apart, and ``place`` itself if there
    is no earlier one. ``keyed`` is the stored result of ``line_keys``.
    """
    distinct = stored(distinct_lines(keyed), "lines")
    partners = stored(_with_partner(distinct), "lines-with-partner")
    # Only documents that may have such lines are split, and only lines that may be among them are shuffled; the join
    # decides.
    of_partners, _ = bloom.split(docs, partners.select("place.doc_id"), [F.col(id_col)])
    maybe, _ = bloom.split(_raw_lines(of_partners, id_col, text_col), partners.select("place"), [F.col("place")])
    texts = maybe.join(partners, "place").dropDuplicates(["n"]).select("n", F.split(_words(F.col("raw")), " ").alias("words"))
    texts = stored(texts, "line-texts")
    found = _earliest(texts)
    place_of = partners.select(F.col("n").alias("first"), F.col("place").alias("first_place"))
    places = found.join(partners, "n").join(place_of, "first").select("place", "first_place")
    return distinct.join(places, "place", "left").select("digest", "place", "copies", F.coalesce("first_place", "place").alias("first"))


def _earliest(texts: DataFrame) -> DataFrame:
    """n and first, the earliest line one word apart, for lines that have such a line.

    Every true match is a candidate, so that a line whose earliest candidate is verified has its first. Where keys of
    different variants agree by chance the earliest candidate may be wrong: these lines, and no others, are looked up
    again under another seed, until none is left.
    """
    words = texts.select(F.col("n").alias("first"), F.col("words").alias("first_words"))
    found, seed, right = _candidates(texts, 0), 0, []
    while True:
        verified = found.join(texts, "n").join(words, "first").select("n", "first", _within_one_word(F.col("words"), F.col("first_words")).alias("right"))
        verified = stored(verified, "line-matches")
        right.append(verified.where("right").select("n", "first"))
        wrong = verified.where("NOT right").select("n")
        if wrong.isEmpty():
            return reduce(DataFrame.unionByName, right)
        seed += 1
        found = _candidates(texts, seed, wrong)


def _candidates(texts: DataFrame, seed: int, only: DataFrame | None = None) -> DataFrame:
    """n and first, for lines (those of ``only``, if it is given) that share a variant with an earlier one."""
    variants = deletion_variants(texts, seed)
    if only is not None:
        keys = stored(variants.join(only, "n", "left_semi").select("key").distinct(), "line-keys-again")
        variants = variants.join(keys, "key", "left_semi")
    variants = stored(variants, "line-variants")
    by_position = variants.groupBy("key", "at").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("lines"))
    by_key = (
        by_position.groupBy("key")
        .agg(
            F.min(F.when(F.col("at") < 0, F.col("first"))).alias("whole"),
            F.min(F.when(F.col("at") >= 0, F.col("first"))).alias("cut"),
            F.sum("lines").alias("lines"),
        )
        .where("lines > 1")
        .drop("lines")
    )
    at_position = by_position.where("lines > 1 AND at >= 0").select("key", "at", "first")
    # A line that is a variant of longer ones looks at those; a shortened line looks at the line that it
    # becomes, and at those that lose a word at the same position.
    other = variants.join(by_key, "key").select("n", F.when(F.col("at") < 0, F.col("cut")).otherwise(F.col("whole")).alias("first"))
    same = variants.where("at >= 0").join(at_position, ["key", "at"]).select("n", "first")
    found = other.unionByName(same).where("first < n")
    found = found if only is None else found.join(only, "n", "left_semi")
    return found.groupBy("n").agg(F.min("first").alias("first"))


def mark_lines(docs: DataFrame, near_words: int = NEAR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line with a word: place, first (the earliest match) and kept (whether that is the line itself).

    Lines without a word are never duplicates and have no row; so have null and empty texts. Rows that repeat with
    the same id and text are one document, whose lines are kept or dropped together. A null id sorts first. An empty
    table gives no rows, and further columns are not read.
    """
    keyed = stored(line_keys(docs, near_words, id_col, text_col), "line-keys")
    matched = match_lines(docs, keyed, id_col, text_col)
    # Lines that are alone are kept without a look.
    others = matched.where("copies > 1 OR first <> place").select("digest", F.col("first").alias("earliest"))
    first = F.coalesce("earliest", "place")
    return keyed.select("place", "digest").join(others, "digest", "left").select("place", first.alias("first"), (first == F.col("place")).alias("kept"))


def drop_lines(docs: DataFrame, near_words: int = NEAR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their dropped lines; a document that loses all lines that have words goes.

    All columns stay; texts that lose nothing stay as they are, null and empty ones included.
    """
    by_id, by_text, gone, whole = (free(name, docs) for name in ("_id", "_of", "_dropped", "_whole"))
    dropped = (
        mark_lines(docs, near_words, id_col, text_col)
        .where("NOT kept")
        .groupBy(F.col("place.doc_id").alias(by_id), F.col("place.of").alias(by_text))
        .agg(F.collect_set("place.line").alias(gone))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    dropped = stored(dropped, "dropped-lines")
    # Texts that lose no line are not shuffled.
    maybe, others = bloom.split(docs, dropped.select(by_id, by_text), [F.col(id_col), F.xxhash64(text)])
    joined = maybe.join(dropped, F.col(id_col).eqNullSafe(F.col(by_id)) & (F.xxhash64(text) == F.col(by_text)), "left")
    lines = F.zip_with(F.split(text, "\n"), F.sequence(F.lit(0), F.size(F.split(text, "\n")) - 1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    left = F.filter(lines, lambda line: ~F.array_contains(gone, line["i"].cast("bigint")))
    shown = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(left["x"], "\n"))
    changed = joined.select(*[shown.alias(c) if c == text_col else F.col(c) for c in docs.columns], F.col(gone).isNull().alias(whole))
    kept = changed.where(F.col(whole) | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).drop(whole)
    return kept.unionByName(others.select(*docs.columns))
