"""Index build and search over functions and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import catalog as cat
from ..operators import code, log, vectors


def build_index(files: DataFrame, curated: DataFrame, documented=None, dispatch=None):
    """(functions, embeddings, catalog) tables of a loaded source tree.

    ``files`` come from ``load_source_tree``; ``documented`` and ``dispatch``
    are (path, text) frames to scrape signatures and names from.
    """
    functions = code.extract_functions(files, ["root_no", "path"])
    # A path below several roots has one vector; it is picked among the finished vectors, so no text is shuffled.
    vectors_of = vectors.embed(files.select("root_no", "path", "content"), "content")
    # They are dealt by path before that: to pick earlier, a task would sort the vectors of all the files that it reads.
    embeddings = vectors_of.repartition("path").groupBy("path").agg(F.min_by("embedding", "root_no").alias("embedding"))
    catalog = curated.select(
        F.lit(0).cast("bigint").alias("origin"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
        "name",
        "category",
        "signature",
        "description",
    )
    if documented is not None:
        found = cat.extract_signatures(documented, ["path"], "text")
        scraped = cat.collapse_signatures(found, ["path", "line_no", "idx"])
        if dispatch is not None:
            names = cat.extract_dispatch_names(dispatch, "text")
            scraped = scraped.unionByName(cat.undocumented_names(names, scraped))
        catalog = cat.merge_catalog(curated, scraped)
    return functions, embeddings, catalog


def search_all(
    functions: DataFrame | None,
    observations: DataFrame,
    query: str,
    scope="all",
    fuzzy=False,
    arch=None,
    function_limit: int | None = 10,
    observation_limit: int | None = 5,
    embeddings: DataFrame | None = None,
    files: DataFrame | None = None,
) -> DataFrame:
    """(scope, rank, id, title, text, simd_width, line_count, total, snippet): function hits, then observation hits.

    ``scope`` is all, functions or memory. ``text`` is the architecture of a function and the whole content of an
    observation, ``total`` the number of all hits of a substring search, ``snippet`` the lines of a function if
    ``files`` (path, content) are given. A fuzzy search needs the files' ``embeddings`` and observations with an
    ``embedding`` column. Each branch ends in a top-k, so the union is small; without a limit (``None``) all hits
    come, by path and line or newest first, and have no rank.
    """
    none = F.lit(None)
    branches = []
    if scope in ("all", "functions"):
        if fuzzy:
            hits = vectors.fuzzy_search_functions(functions, embeddings, query, function_limit, arch).withColumn("total", none)
        else:
            found = code.filter_arch(code.search_functions(functions, query), arch)
            first = code.first_matches(found, function_limit)
            hits = _ranked(first, function_limit, "path", "line_start")
        if files is not None:
            hits = code.source_snippet(hits, files, few=function_limit is not None)
        else:
            hits = hits.withColumn("snippet", none)
        branches.append(
            hits.select(
                F.lit("function").alias("scope"),
                "rank",
                F.concat_ws(":", "path", F.col("line_start").cast("string")).alias("id"),
                F.col("func_name").alias("title"),
                F.col("arch").alias("text"),
                F.col("simd_width").cast("bigint").alias("simd_width"),
                F.col("line_count").cast("bigint").alias("line_count"),
                F.col("total").cast("bigint").alias("total"),
                F.col("snippet").cast("string").alias("snippet"),
            )
        )
    if scope in ("all", "memory"):
        if fuzzy:
            hits = vectors.fuzzy_search(observations, query, observation_limit, ties=("id",)).withColumn("total", none)
        else:
            every = log.search_observations(observations, query, limit=None)
            total = every.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
            found = log.search_observations(observations, query, limit=observation_limit).withColumn("total", total)
            hits = _ranked(found, observation_limit, F.desc("created_at"), "id")
        branches.append(
            hits.select(
                F.lit("memory").alias("scope"),
                "rank",
                F.col("id").cast("string").alias("id"),
                F.col("type").alias("title"),
                F.col("content").alias("text"),
                none.cast("bigint").alias("simd_width"),
                none.cast("bigint").alias("line_count"),
                F.col("total").cast("bigint").alias("total"),
                none.cast("string").alias("snippet"),
            )
        )
    both = branches[0] if len(branches) == 1 else branches[0].unionByName(branches[1])
    return both.orderBy("scope", "rank", "id")


def _ranked(hits: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    """Numbers the few rows of a limit."""
    rank = F.lit(None) if limit is None else F.row_number().over(W.orderBy(*order))
    return hits.withColumn("rank", rank.cast("bigint"))
