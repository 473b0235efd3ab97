"""Sharding by a hierarchical weighted hash tree.

A tree has regions, their racks, and the racks' shards with weights; a rack weighs as much as its shards, a region
as much as its racks. A row descends from the root: at every level each child draws a hash of the row's key and the
child's name, scaled by the child's weight, and the largest draw wins (weighted rendezvous). A draw depends on no
other child, so that a change of weights moves rows only into children that became heavier or out of children that
became lighter, and nothing moves inside a subtree whose weights stay. A shard that opens a region of its own takes
rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import ranked

# region, rack, shard, weight
Leaf = tuple[str, str, int, float]


def even_tree(regions: int, racks: int, shards: int) -> list[Leaf]:
    """A tree whose shards all weigh 1, numbered from 0."""
    per_region = racks * shards
    return [
        (f"r{n // per_region}", f"k{n % per_region // shards}", n, 1.0) for n in range(regions * per_region)
    ]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    number = max((leaf[2] for leaf in tree), default=-1) + 1
    return [*tree, (f"new{number}", "k0", number, weight)]


def _children(tree: list[Leaf]) -> dict[str, dict[str, float]]:
    """Weights of the children of every inner node, by path; "" is the root."""
    found: dict[str, dict[str, float]] = {}
    for region, rack, shard, weight in tree:
        if weight < 0:
            raise ValueError("a weight is negative")
        path = ["", f"{region}", f"{region}/{rack}", f"{region}/{rack}/{shard}"]
        for parent, child in zip(path, path[1:], strict=False):
            below = found.setdefault(parent, {})
            below[child] = below.get(child, 0.0) + weight
    if not found or not any(weight for *_, weight in tree):
        raise ValueError("the tree has no shard with a weight")
    return found


def _draw(key: Column, children: Column) -> Column:
    """The child with the largest draw."""

    def one(child):
        # The middle of one of 2^52 parts of (0, 1).
        part = F.pmod(F.xxhash64(key, child["name"]), F.lit(1 << 52))
        return F.struct((child["weight"] / -F.ln((part + F.lit(0.5)) / F.lit(float(1 << 52)))).alias("draw"), child["name"].alias("name"))

    return F.array_max(F.transform(children, one))["name"]


def assign(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key: three draws, each among the children of one node.

    A null key is a key like any other.
    """
    nodes = _children(tree)
    leaves = {f"{region}/{rack}/{shard}": shard for region, rack, shard, _ in tree}

    def listed(node):
        pairs = [F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in nodes[node].items() if w > 0]
        return F.array(*pairs)

    inner = F.create_map(*[x for node in nodes if node and any(nodes[node].values()) for x in (F.lit(node), listed(node))])
    region = _draw(key, listed(""))
    rack = _draw(key, inner[region])
    leaf = _draw(key, inner[rack])
    return F.create_map(*[x for name, n in leaves.items() for x in (F.lit(name), F.lit(n))])[leaf].cast("int")


def shard_rows(
    docs: DataFrame, tree: list[Leaf], next_tree: list[Leaf] | None = None, id_col="doc_id", text_col="text"
) -> DataFrame:
    """Places every row by its id: shard, slot in the shard (from 0, without a gap), and shard in ``next_tree``.

    ``size`` is the number of UTF-8 bytes of the text plus 8 for the id, ``text_crc32`` its checksum. A null text
    counts as empty. Rows with one id, a null id included, share a shard and get slots of their own. Further
    columns are not carried along.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col)
    placed = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        assign(key, tree).alias("shard"),
        (assign(key, next_tree) if next_tree else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return ranked(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
