"""Main text of pages by a site style tree.

The pages of a host are merged into one tree: elements with the same path of tags, classes and ids are one node. A
node's presentations are the sequences of its children's styles, its contents the texts below it, one of each for a
page. What stands on one page only has an entropy of 0 over the pages, what stands on all alike has 1; the importance
of a node is 1 less the mean entropy of its different contents or presentations, whichever gives more, so that many
copies of one article weigh no more than one, and as far as the number of pages bears that out. All hosts together
make a further tree, in which notices and menus are seen to repeat that a host has on few pages. Branches of low
importance are removed from every page; inside article and main elements less is enough to stay, unless a word of the
class hints at noise.

Elements that say in so many words what they are (nav, aside, class="cookie-notice") go as well, whatever their
importance, for the pages of small hosts. Text beside an article or main element stays if its node is important.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Container, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm import dom
from textlake.llm.common import stored
from textlake.llm.url_filter import host_of

# Marked nodes are sent to all tasks only up to this number (16 bytes each); beyond it they are joined.
BROADCAST_NODES = 200_000


def style_nodes(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """A row per page and different path: host, path, a hash of the whole page, of the presentation, and of the content,
    and whether it is guarded: inside an article or main element, and without a word that hints at noise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for host, html in zip(batch["host"], batch["html"], strict=True):
                page = dom.read(html)
                whole = dom._fold(*page.nodes[0].content)
                by: dict[int, tuple[list[int], list[int], bool]] = {}
                for n in page.nodes[1:]:
                    styles, content, _ = by.setdefault(n.path, ([], [], n.main and not n.hint))
                    styles.append(dom._fold(*n.styles))
                    content.append(dom._fold(*n.content))
                out += [(host, whole, path, dom._fold(*s), dom._fold(*c), guarded) for path, (s, c, guarded) in by.items() if any(c)]
            yield pd.DataFrame(out, columns=["host", "page", "path", "presentation", "content", "guarded"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "host string, page bigint, path bigint, presentation bigint, content bigint, guarded boolean")


def _rated(times: DataFrame, node: list[str]) -> DataFrame:
    """Pages and importance of nodes from the number of pages of each of their values."""
    pages = F.sum("n")
    # Of a value on n of the pages alike: ln n / ln pages. The mean is over different values.
    entropy = F.when(pages > 1, F.avg(F.ln("n")) / F.ln(pages)).otherwise(0.0)
    each = times.groupBy(*node, "kind").agg(pages.alias("pages"), entropy.alias("entropy"), F.bool_and("guarded").alias("guarded"))
    rated = each.groupBy(*node).agg(F.max("pages").alias("pages"), F.min("entropy").alias("entropy"), F.bool_and("guarded").alias("guarded"))
    # Two pages bear out half of what is seen, many pages all.
    return rated.select(*node, "pages", "guarded", (F.lit(1.0) - F.col("entropy") * (F.lit(1.0) - F.lit(1.0) / F.col("pages"))).alias("importance"))


def importance(nodes: DataFrame) -> DataFrame:
    """host, path, number of different pages, guarded, and importance of every node of the hosts' trees, and of the tree
    of all hosts together, whose rows have ``*`` for the host."""
    # Pages that repeat word for word count once: copies of a page say nothing about its parts.
    once = nodes.groupBy("host", "path", "page").agg(
        F.min("presentation").alias("presentation"), F.min("content").alias("content"), F.bool_and("guarded").alias("guarded")
    )
    kinds = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("presentation", "content")]))
    times = once.select("host", "path", "guarded", kinds).groupBy("host", "path", "kind", "value").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("guarded").alias("guarded")
    )
    times = stored(times, "node-values")
    pooled = times.groupBy("path", "kind", "value").agg(F.sum("n").alias("n"), F.bool_and("guarded").alias("guarded"))
    everywhere = _rated(pooled, ["path"]).withColumn("host", F.lit(EVERY_HOST))
    return _rated(times, ["host", "path"]).unionByName(everywhere)


# No host is named so.
EVERY_HOST = "*"


def marked_nodes(nodes: DataFrame, least: float = 0.8, least_guarded: float = 0.3, high_pages: int = 8) -> DataFrame:
    """Nodes that decide: host, path, and whether they are ``low``.

    Those below ``least`` importance are low, or below ``least_guarded`` where they are guarded. Others are told from
    nodes that nothing is known of, for the sake of text beside main text, if they have ``high_pages`` pages of a host.
    """
    rated = importance(nodes)
    low = F.col("importance") < F.when(F.col("guarded"), least_guarded).otherwise(least)
    high = (F.col("pages") >= high_pages) & (F.col("host") != EVERY_HOST) & ~F.col("guarded")
    return rated.where(low | high).select("host", "path", low.alias("low"))


def main_text(html: str | None, low: Container[int] = frozenset(), high: Container[int] = frozenset()) -> str:
    """Blocks of main text, one a line, without branches of the paths ``low``.

    Each piece of a block is judged by the element that it stands in. If there is an article or main element, pieces
    beside it need a path of ``high``. Where all text repeats, nothing tells it from the page's own, and it stays.
    """
    blocks = [[(text, at) for text, at in block if not at.noise] for block in dom.read(html, low).blocks]
    spoken = [at for block in blocks for text, at in block if not text.isspace()]
    inside = any(at.main for at in spoken)
    own = any(not at.low for at in spoken if at.main or not inside)
    lines = (
        dom.joined([text for text, at in block if (not at.low or not own and at.main >= inside) and (at.main or not inside or at.path in high)])
        for block in blocks
    )
    return "\n".join(filter(None, lines))


def extract(
    pages: DataFrame, least: float = 0.8, least_guarded: float = 0.3, id_col="page_id", url_col="url", html_col="html"
) -> DataFrame:
    """page_id, url and text of every row.

    A null or empty page gives an empty text; a null url or one without host belongs to a host without name, whose
    pages make a tree like any other. Rows that repeat give rows that repeat, an empty table none, and further
    columns are not carried along. A host's pages never meet in one task: only hashes are counted, with partial
    counts per task. Marked nodes are broadcast if there are at most ``BROADCAST_NODES`` of them and joined with
    the pages otherwise.
    """
    marked = stored(marked_nodes(style_nodes(pages, id_col, url_col, html_col), least, least_guarded), "marked-nodes")
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
        host_of(F.col(url_col)).alias("host"),
    )
    found = marked.limit(BROADCAST_NODES + 1).count()
    if found <= BROADCAST_NODES:
        by_host: dict[str, tuple[dict, dict]] = {EVERY_HOST: ({}, {})}
        for r in marked.collect():
            by_host.setdefault(r["host"], ({}, {}))[0 if r["low"] else 1][r["path"]] = True
        sent = pages.sparkSession.sparkContext.broadcast(by_host)

        def sets(host: str | None) -> tuple[ChainMap, dict]:
            (everywhere, _), (low, high) = sent.value[EVERY_HOST], sent.value.get(host, ({}, {}))
            return ChainMap(low, everywhere), high

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hosts, htmls = batch.column("host").to_pylist(), batch.column("html").to_pylist()
                yield _with_texts(batch, [main_text(x, *sets(h)) for h, x in zip(hosts, htmls, strict=True)])

        return rows.mapInArrow(run, _TEXTS)

    # A host's nodes are dealt over its paths; a page asks for its own paths only.
    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (key, host, path)
                for key, host, html in zip(batch["key"], batch["host"], batch["html"], strict=True)
                for path in {n.path for n in dom.read(html).nodes[1:]}
            ]
            yield pd.DataFrame(out, columns=["key", "host", "path"])

    own = rows.withColumn("key", F.xxhash64("host", "html"))
    wanted = (
        own.select("key", "host", "html")
        .mapInPandas(paths, "key bigint, host string, path bigint")
        .select("key", "path", F.explode(F.array("host", F.lit(EVERY_HOST))).alias("host"))
        .join(marked, ["host", "path"])
        .groupBy("key")
        .agg(F.collect_set(F.when(F.col("low"), F.col("path"))).alias("low"), F.collect_set(F.when(~F.col("low"), F.col("path"))).alias("high"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs, htmls = (batch.column(c).to_pylist() for c in ("low", "high", "html"))
            yield _with_texts(batch, [main_text(x, set(lo or ()), set(hi or ())) for lo, hi, x in zip(lows, highs, htmls, strict=True)])

    return own.join(wanted, "key", "left").select("page_id", "url", "html", "low", "high").mapInArrow(cut, _TEXTS)


_TEXTS = "page_id bigint, url string, text string"


def _with_texts(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    # A lone surrogate, as a reference may spell it, has no UTF-8 form.
    plain = [t.encode("utf-8", "replace").decode() for t in texts]
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(plain, pa.string())], ["page_id", "url", "text"])
