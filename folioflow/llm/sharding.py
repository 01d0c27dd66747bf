"""Sharding by k-d tree partitioning over document metadata.

The corpus is split recursively at weighted medians (weight: bytes) along the
dimension whose values spread widest inside the node, until leaves hold the
target bytes. A node that stands for k shards gives floor(k/2)/k of its bytes to
the left, so any number of shards comes out near equal.

Medians are found on the executors: every pass sums bytes into at most BINS
intervals per open node, and the driver sees these sums only (at most nodes x
BINS numbers). Passes narrow the interval that holds the median until an interval
border is near enough; ties along the dimension are cut by the text's CRC and then
by a hash of the id, so a heavy value does not make a heavy shard.

Defined cases: a null text weighs the fixed cost of 8 bytes; null metadata sorts
first; rows equal in dimensions, text and id stay together; an empty table gives
no rows; an input column called like an added one is kept as ``in_<name>``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import set_aside, staged
from folioflow.llm.spread import ranked

BINS = 4096
# A cut may miss its byte target by this share of one shard.
TOLERANCE = 0.001
ROW_COST = 8
KEY_BITS = 62


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_COST


def text_crc(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null as the empty text."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def dimension(df: DataFrame, name: str) -> Column:
    """A metadata column as a non-negative long that keeps its order; null is 0.

    Strings keep the order of their first seven bytes.
    """
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(col.cast("binary"), 1, 7)), 14, "0")
        value = F.conv(head, 16, 10).cast("bigint") + 1
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        value = F.unix_micros(col.cast("timestamp")) + F.lit(1 << 60)
    else:
        value = F.greatest(F.lit(0.0), F.least(F.lit(float(1 << 61)), col.cast("double") + F.lit(float(1 << 60)))).cast("bigint")
        if isinstance(kind, T.IntegralType):
            value = F.shiftright(col.cast("bigint"), 2) + F.lit(1 << 61)
            small = (col >= 0) & (col < (1 << 60))
            value = F.when(small, F.lit(1 << 61) + col.cast("bigint")).otherwise(value)
    return F.coalesce(value, F.lit(0).cast("bigint"))


@dataclass
class Node:
    """A k-d cell that stands for the shards first .. first + shards - 1."""

    id: int
    first: int
    shards: int
    weight: int = 0
    dim: int = -1
    left: "Node | None" = None
    right: "Node | None" = None
    # The cut: keys (dimension value, crc, id hash) at or above it go right.
    cut: list[int] = field(default_factory=list)


class _Search:
    """The interval of the current key that still holds the cut of one node."""

    def __init__(self, node: Node, low: int, high: int, tolerance: float, few: bool):
        # few: so few distinct values that each is an interval of its own
        self.few = few
        self.node, self.goal = node, node.weight * (node.shards // 2) / node.shards
        self.tolerance = tolerance
        self.fixed: list[int] = []
        self.low, self.high, self.before = low, high, 0
        self.done = False

    @property
    def width(self) -> int:
        return 1 if self.few and not self.fixed else max(1, -(-(self.high - self.low + 1) // BINS))

    def narrow(self, sums: dict[int, tuple[int, int]]) -> None:
        """Take the border nearest the goal if it is near enough or one row is left, else go into the interval that holds it."""
        total = self.before
        for i in sorted(sums):
            weight, rows = sums[i]
            start, after = self.low + i * self.width, total + weight
            if after < self.goal:
                total = after
                continue
            edges = [(abs(total - self.goal), start), (abs(after - self.goal), start + self.width)]
            miss, border = min(edges)
            last = rows == 1 or len(self.fixed) == 2 and self.width == 1
            if miss <= self.tolerance or last:
                self.node.cut = [*self.fixed, border]
                self.done = True
            elif self.width == 1:
                self.fixed.append(start)
                self.low, self.high, self.before = 0, (1 << 32) - 1 if len(self.fixed) == 1 else (1 << KEY_BITS) - 1, total
            else:
                self.before = total
                self.low, self.high = start, min(self.high, start + self.width - 1)
            return
        self.node.cut, self.done = [*self.fixed, self.high + 1], True


def _keys(node: Node) -> list[str]:
    return [f"_d{node.dim}", "_crc", "_id"]


def _goes_right(node: Node) -> Column:
    """(key1, key2, ...) >= cut, in dictionary order; shorter cuts are followed by nothing."""
    out, keys = None, _keys(node)
    for name, value in reversed(list(zip(keys, node.cut))):
        if out is None:
            out = F.col(name) >= F.lit(value)
        else:
            out = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def _place(node: Node, leaf) -> Column:
    if node.left is None:
        return F.lit(leaf(node))
    return F.when(_goes_right(node), _place(node.right, leaf)).otherwise(_place(node.left, leaf))


def _keyed(docs: DataFrame, dims: Sequence[str]) -> dict[str, Column]:
    out = {f"_d{i}": dimension(docs, name) for i, name in enumerate(dims)}
    out["_crc"] = text_crc(F.col("text"))
    out["_id"] = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - KEY_BITS)
    return out


def build_tree(slim: DataFrame, n_dims: int, shards: int | None, target_bytes: int | None) -> Node:
    """Grow the tree over ``slim`` (columns _d*, _crc, _id, size); all splits of one depth share their passes."""
    total = int(slim.agg(F.sum("size")).first()[0] or 0)
    if shards is None:
        shards = max(1, -(-total // max(1, target_bytes)))
    if not total:
        return Node(0, 0, 1)
    few = []
    for i in range(n_dims):
        few.append(slim.select(f"_d{i}").distinct().limit(BINS + 1).count() <= BINS)
    root = Node(0, 0, shards)
    tolerance = TOLERANCE * total / shards
    ids, span = 1, None
    while True:
        leaves = [n for n in _leaves(root) if n.shards > 1 and n.weight >= 0 and n.left is None]
        if not leaves:
            return root
        at = _place(root, lambda n: n.id)
        ranges = slim.withColumn("_node", at).groupBy("_node").agg(
            F.sum("size").alias("w"),
            *[F.min(f"_d{i}").alias(f"lo{i}") for i in range(n_dims)],
            *[F.max(f"_d{i}").alias(f"hi{i}") for i in range(n_dims)],
        ).collect()  # one row per node
        stats = {r["_node"]: r for r in ranges}
        if span is None:
            whole = stats[0]
            span = [max(1, whole[f"hi{i}"] - whole[f"lo{i}"]) for i in range(n_dims)]
        searches = {}
        for node in leaves:
            r = stats.get(node.id)
            if r is None:
                node.weight = -1  # no rows: its shards stay empty
                continue
            node.weight = r["w"]
            widths = [(r[f"hi{i}"] - r[f"lo{i}"]) / span[i] for i in range(n_dims)]
            node.dim = max(range(n_dims), key=lambda i: (widths[i], -i))
            searches[node.id] = _Search(node, r[f"lo{node.dim}"], r[f"hi{node.dim}"], tolerance, few[node.dim])
        while active := [s for s in searches.values() if not s.done]:
            bins = F.lit(None).cast("bigint")
            for s in active:
                keys = _keys(s.node)
                here = F.col("_node") == s.node.id
                for name, value in zip(keys, s.fixed):
                    here = here & (F.col(name) == value)
                key = F.col(keys[len(s.fixed)])
                here = here & (key >= s.low) & (key <= s.high)
                bins = F.when(here, F.expr(f"({keys[len(s.fixed)]} - {s.low}L) div {s.width}L")).otherwise(bins)
            sums = (
                slim.withColumn("_node", at).withColumn("_bin", bins).filter("_bin is not null")
                .groupBy("_node", "_bin").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect()
            )  # at most open nodes x BINS rows
            for s in active:
                s.narrow({r["_bin"]: (int(r["w"]), r["n"]) for r in sums if r["_node"] == s.node.id})
        for node in (s.node for s in searches.values()):
            half = node.shards // 2
            node.left, node.right = Node(ids, node.first, half), Node(ids + 1, node.first + half, node.shards - half)
            ids += 2


def _leaves(node: Node):
    if node.left is None:
        yield node
    else:
        yield from _leaves(node.left)
        yield from _leaves(node.right)


DIMS = ("n_chars", "lang", "source")


def shard_table(docs: DataFrame, dims: Sequence[str] = DIMS, shards: int | None = None, target_bytes: int | None = 1 << 30) -> DataFrame:
    """One slim row per document: doc_id, size, text_crc32, shard, slot (gapless from 0 in its shard)."""
    keyed = docs.select("doc_id", text_bytes(F.col("text")).alias("size"), *[c.alias(n) for n, c in _keyed(docs, dims).items()])
    slim = staged(keyed, "shard-rows")
    tree = build_tree(slim, len(dims), shards, target_bytes)
    rows = slim.count()
    placed = slim.select("doc_id", "size", F.col("_crc").alias("text_crc32"), "_id", _place(tree, lambda n: n.first).alias("shard"))
    out = ranked(placed, "shard", "_id", ["doc_id", "text_crc32"], "size", rows)
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("pos").alias("slot"))


def shard(docs: DataFrame, dims: Sequence[str] = DIMS, shards: int | None = None, target_bytes: int | None = 1 << 30, name: str = "shard") -> DataFrame:
    """The documents with their shard: the tree is small, so rows are placed without a join or shuffle."""
    docs, _ = set_aside(docs, [name, "size", "_crc", "_id", *[f"_d{i}" for i in range(len(dims))]])
    keys = _keyed(docs, dims)
    slim = docs.select(text_bytes(F.col("text")).alias("size"), *[c.alias(n) for n, c in keys.items()])
    tree = build_tree(staged(slim, "shard-keys"), len(dims), shards, target_bytes)
    return docs.withColumns(keys).withColumn(name, _place(tree, lambda n: n.first)).drop(*keys)
