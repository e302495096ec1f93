"""Sharding [native]: a hierarchical weighted hash tree over region, rack and shard.

A row goes down the tree by one draw a level. Every child of a node draws -ln(u) / weight, where u is uniform
and depends on the row's key and the child's own name only; the smallest draw wins. So a child is chosen in
proportion to its weight, and a change of one weight moves rows only into or out of that child's subtree. A shard that
joins as a region of its own takes rows only into itself.

Everything is built from DataFrame functions: one scan, one window over (shard, slice), and a small table of
counts, at most shards x slices rows.

Defined cases: a null key is the text "~"; a null text has size 1 and CRC 0; repeated rows share a shard and get a slot
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLICES = 512


@dataclass(frozen=True)
class Node:
    """A region, a rack or, without children, a shard; a parent weighs as much as its children together."""

    name: str
    own_weight: float = 1.0
    children: tuple["Node", ...] = ()
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def topology(n_shards: int, per_rack: int = 2, racks: int = 2, weights: dict[int, float] | None = None) -> Node:
    """A tree of regions of ``racks`` racks of ``per_rack`` shards, filled in order."""
    weights = weights or {}
    regions: dict[int, dict[int, list[Node]]] = {}
    for s in range(n_shards):
        region, rack = s // (per_rack * racks), s // per_rack % racks
        regions.setdefault(region, {}).setdefault(rack, []).append(Node(f"g{region}/k{rack}/s{s}", weights.get(s, 1.0), (), s))
    return Node("", 1.0, tuple(Node(f"g{g}", 1.0, tuple(Node(f"g{g}/k{k}", 1.0, tuple(leaves)) for k, leaves in sorted(r.items()))) for g, r in sorted(regions.items())))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a new region: no other subtree's weight changes."""
    shard, region = 1 + max(s.shard for s in leaves(tree)), len(tree.children)
    new = Node(f"g{region}", 1.0, (Node(f"g{region}/k0", 1.0, (Node(f"g{region}/k0/s{shard}", weight, (), shard),)),))
    return Node(tree.name, 1.0, (*tree.children, new))


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def uniform(key: Column, name: str) -> Column:
    """In (0, 1): the first 52 bits of the MD5 of key and name."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def descend(key: Column, node: Node) -> Column:
    """The shard of a key below ``node``."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [F.struct((-F.ln(uniform(key, c.name)) / c.weight).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]
    won = F.array_min(F.array(*draws))["i"]
    out = F.when(won == 0, descend(key, node.children[0]))
    for i, c in enumerate(node.children[1:], 1):
        out = out.when(won == i, descend(key, c))
    return out


def assign(docs: DataFrame, tree: Node, key: str = "doc_id", text: str = "text", larger: Node | None = None) -> DataFrame:
    """key, size, text_crc32, shard and, with ``larger``, grown_shard for each row."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("~"))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    out = docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), descend(k, tree).cast("int").alias("shard"), (descend(k, larger) if larger else F.lit(None)).cast("int").alias("grown_shard"))
    return out


def slotted(rows: DataFrame, key: str = "doc_id", slices: int = SLICES) -> DataFrame:
    """Adds ``slot``: gapless from 0 in each shard, with no task that holds a shard.

    Rows of a shard are split into hash slices; a window numbers each slice, and the counts of the slices before it
    (a table of shards x slices rows) shift the numbers.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit("~"))
    # rows of one key, a null say, are spread by their texts
    rows = rows.withColumn("__slice", (F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("long") + F.col("text_crc32")) % slices)
    counts = rows.groupBy("shard", "__slice").agg(F.count("*").alias("__n"))
    before = counts.select("shard", "__slice", (F.sum("__n").over(W.partitionBy("shard").orderBy("__slice")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(W.partitionBy("shard", "__slice").orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32")) - 1
    numbered = rows.withColumn("__in", within)
    # at most shards x slices rows, whatever the input
    return numbered.join(F.broadcast(before), ["shard", "__slice"]).withColumn("slot", (F.col("__in") + F.col("__before")).cast("long")).drop("__in", "__before", "__slice")


def shards(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and the shard among one more, for each row; the law is ``key``."""
    tree = topology(n_shards)
    rows = assign(docs, tree, key, text, grown(tree))
    return slotted(rows, key).select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
