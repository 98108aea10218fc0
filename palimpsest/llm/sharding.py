"""Sharding by a hierarchical weighted hash tree.

Each level draws one child: a hash of the key and the child's path, made a uniform draw u, scores ln(u) / weight, and
the largest score wins. A child's draws do not depend on its siblings, so a changed weight moves rows only into or out
of that child's subtree. A shard that is added hangs from the root in a region of its own, so all that moves, moves
into it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import key_of, stage

#: Rows of a shard that one task numbers.
SLOT_ROWS = 200_000


@dataclass(frozen=True)
class Node:
    """A shard where it has no children; else its weight is the sum of theirs."""

    path: str
    shard: int | None = None
    own: float = 1.0
    children: tuple[Node, ...] = field(default_factory=tuple)

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(regions: int = 2, racks: int = 2, shards: int = 4) -> Node:
    """A regular tree: 16 shards by default."""
    leaf = lambda r, k, s: Node(f"{r}/{k}/{s}", (r * racks + k) * shards + s)
    return Node("", children=tuple(
        Node(f"{r}", children=tuple(Node(f"{r}/{k}", children=tuple(leaf(r, k, s) for s in range(shards))) for k in range(racks)))
        for r in range(regions)))


def leaves(node: Node) -> int:
    return sum(map(leaves, node.children)) if node.children else 1


def grown(root: Node, weight: float = 1.0) -> Node:
    """root and one more shard, numbered next, in a region of its own."""
    n, path = leaves(root), f"{len(root.children)}"
    leaf = Node(f"{path}/0/0", n, weight)
    return Node("", children=(*root.children, Node(path, children=(Node(f"{path}/0", children=(leaf,)),))))


def _draw(key: Column, node: Node) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.concat_ws("|", key, F.lit(node.path))), 11)
    return F.log((bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(node.weight)


def place(key: Column, node: Node) -> Column:
    """The shard of a key (a string column), by draws from the root down."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0])
    draws = [_draw(key, c) for c in node.children]
    best, out = F.greatest(*draws), None
    for c, d in zip(node.children, draws):
        out = F.when(d == best, place(key, c)) if out is None else out.when(d == best, place(key, c))
    return out


def shard(docs: DataFrame, root: Node | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    The law is `key`: doc_id and the tree alone decide; a null doc_id is a key like any other. A null text has size 1
    and the checksum of no bytes. Slots number a shard's rows from 0 without gaps, in bins by hash whose rows are
    counted first, so no task sorts a whole shard; the order within a bin is by doc_id, then checksum and size.
    """
    root = root or tree()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = stage(docs.select(
        F.col("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        place(key, root).cast("int").alias("shard"), place(key, grown(root)).cast("int").alias("grown_shard")), "sharded")
    bins = max(1, -(-rows.count() // (SLOT_ROWS * leaves(root))))
    rows = rows.withColumn("bin", F.pmod(F.xxhash64(key_of("doc_id"), F.col("text_crc32")), F.lit(bins)).cast("int"))
    w = "OVER (PARTITION BY shard ORDER BY bin)"
    starts = rows.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("in_bin")).select(
        "shard", "bin", F.expr(f"sum(in_bin) {w} - in_bin").alias("start"))
    n = F.expr("row_number() OVER (PARTITION BY shard, bin ORDER BY doc_id, text_crc32, size)")
    return rows.withColumn("n", n).join(starts, ["shard", "bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard")


def brute_place(key: str, node: Node) -> int:
    """place() in plain Python, for tests."""
    import math

    import xxhash

    while node.children:
        score = lambda c: math.log(((xxhash.xxh64_intdigest(f"{key}|{c.path}".encode(), 42) >> 11) + 0.5) / (1 << 53)) / c.weight
        node = max(node.children, key=score)
    return node.shard
