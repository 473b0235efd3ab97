"""Catalog of names with signatures: extraction, collapse, merge, look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import contains_nocase, strip, truncate_bytes

# Java regexes; (?U) gives \w, \d and \s their Unicode meaning. The look-behind
# starts a name at the start of a word only, which keeps the search linear.
_SPACE = r"[\s\x1c-\x1f]"
_SIGNATURE = rf"(?U)(?<!\w)(\w+)\(([^)]*)\){_SPACE}*->{_SPACE}*([A-Za-z_]\w*)"
_PAREN = r"\(([^()]*)\)"
_ARGUMENTS = rf"(?U)\d+x\d+|:{_SPACE}*\w"
_DISPATCH = rf'(?U)"([a-z]\w*)"{_SPACE}*(?:\||=>|if)'
_DOC_LINE = r"\A[ \t]*///"
_DOC_LEAD = rf"(?U)\A{_SPACE}*+/*+{_SPACE}*+"


def extract_signatures(df: DataFrame, ids, text) -> DataFrame:
    """(ids, line_no, idx, name, signature, tags) of the ``///`` lines with an arrow."""
    lines = (
        df.where(F.contains(F.col(text), F.lit("->")))
        .select(*ids, F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "_line"))
        .where(F.contains(F.col("_line"), F.lit("->")) & F.col("_line").rlike(_DOC_LINE))
    )
    body = lines.select(
        *ids,
        (F.col("_pos") + 1).cast("bigint").alias("line_no"),
        F.regexp_replace("_line", _DOC_LEAD, "").alias("_body"),
    )

    def group(i):
        return F.regexp_extract_all(F.col("_body"), F.lit(_SIGNATURE), F.lit(i))

    tags = F.filter(
        F.regexp_extract_all(F.col("_body"), F.lit(_PAREN), F.lit(1)),
        lambda t: ~F.contains(t, F.lit("->")) & ~t.rlike(_ARGUMENTS),
    )
    tags = F.filter(F.transform(tags, strip), lambda t: t != "")
    matches = F.arrays_zip(group(1).alias("name"), group(2).alias("args"), group(3).alias("ret"))
    return body.select(*ids, "line_no", tags.alias("tags"), F.posexplode(matches).alias("idx", "m")).select(
        *ids,
        "line_no",
        F.col("idx").cast("bigint").alias("idx"),
        "m.name",
        F.concat("m.name", F.lit("("), strip("m.args"), F.lit(") -> "), "m.ret").alias("signature"),
        "tags",
    )


def extract_dispatch_names(df: DataFrame, text) -> DataFrame:
    """Distinct quoted names that are followed by ``|``, ``=>`` or ``if``."""
    names = F.regexp_extract_all(F.col(text), F.lit(_DISPATCH), F.lit(1))
    return df.where(F.contains(F.col(text), F.lit('"'))).select(F.explode(names).alias("name")).distinct()


def distinct_first_seen(df: DataFrame, value, order, within=()) -> DataFrame:
    """(within, value, first_seen): each value once, with its first place.

    A partial aggregate, so a value that fills a third of the rows is reduced
    before the shuffle.
    """
    first = F.min(F.struct(*order)) if len(order) > 1 else F.min(order[0])
    return df.groupBy(*within, value).agg(first.alias("first_seen"))


def signature_rows(signatures: DataFrame, order) -> DataFrame:
    """(name, signature, first_seen): each signature of a name once."""
    return distinct_first_seen(signatures, "signature", order, ["name"])


def tag_rows(signatures: DataFrame, order) -> DataFrame:
    """(name, tag, first_seen): each tag of a name once; empty tags go."""
    tags = signatures.select("name", *order, F.posexplode("tags").alias("_tag_no", "tag")).where("tag <> ''")
    return distinct_first_seen(tags, "tag", [*order, "_tag_no"], ["name"])


def _joined(first: DataFrame, value, max_bytes, out) -> DataFrame:
    if max_bytes is not None:
        # Values are not empty, so max_bytes + 1 of them overflow the cut: the text
        # kept depends on no later one, and a name never gathers more than that.
        place = W.partitionBy("name").orderBy("first_seen", value)
        first = first.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= max_bytes + 1).drop("_n")
    ordered = F.array_sort(F.collect_list(F.struct("first_seen", value)))
    text = F.array_join(F.transform(ordered, lambda s: s[value]), "; ")
    return first.groupBy("name").agg((text if max_bytes is None else truncate_bytes(text, max_bytes)).alias(out))


def collapse_signatures(
    signatures: DataFrame,
    order,
    category="intrinsic",
    untagged="auto-extracted, not yet curated",
    signature_bytes: int | None = None,
    description_bytes: int | None = None,
) -> DataFrame:
    """One row per name: its distinct signatures and tags in order of first sight, joined by "; ".

    ``order`` names the columns that give a row its place. The texts are whole unless a number of bytes to show is
    given. All different signatures of a name meet in its row; ``signature_rows`` and ``tag_rows`` keep them apart.
    """
    sigs = _joined(signature_rows(signatures, order), "signature", signature_bytes, "signature")
    tags = _joined(tag_rows(signatures, order), "tag", description_bytes, "description")
    return sigs.join(tags, "name", "left").select(
        "name",
        F.lit(category).alias("category"),
        "signature",
        F.coalesce("description", F.lit(untagged)).alias("description"),
    )


def undocumented_names(names: DataFrame, documented: DataFrame, note="no doc comment") -> DataFrame:
    """Placeholder entries for names that have no signature."""
    return names.join(documented.select("name").distinct(), "name", "left_anti").select(
        "name",
        F.lit("intrinsic").alias("category"),
        F.concat("name", F.lit("(...) -> ?")).alias("signature"),
        F.lit(note).alias("description"),
    )


def merge_catalog(curated: DataFrame, scraped: DataFrame) -> DataFrame:
    """Curated entries, then the scraped ones with other names.

    Table order is (origin, ordinal, name): curated entries in file order, then
    scraped ones by name. No dense number is made, which would take one task.
    """
    fresh = scraped.join(curated.select("name").distinct(), "name", "left_anti")
    columns = ["name", "category", "signature", "description"]
    return curated.select(F.lit(0).cast("bigint").alias("origin"), F.col("ordinal").cast("bigint").alias("ordinal"), *columns).unionByName(
        fresh.select(F.lit(1).cast("bigint").alias("origin"), F.lit(None).cast("bigint").alias("ordinal"), *columns)
    )


def lookup_reference(catalog: DataFrame, query: str, limit: int | None = 5, order=("origin", "ordinal", "name")) -> DataFrame:
    """Entries named ``query``; if there are none, those that mention it.

    Names and descriptions are compared in any case; the first ``limit`` in
    table order are kept (``None``: all). Whether an exact name exists is a
    scalar subquery.
    """
    q = query.lower()
    exact = F.lower("name") == q
    any_exact = catalog.where(exact).groupBy().agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    mention = contains_nocase("name", q) | contains_nocase(F.coalesce("description", F.lit("")), q)
    found = catalog.where(F.when(any_exact, exact).otherwise(mention)).orderBy(*order)
    return found if limit is None else found.limit(limit)
