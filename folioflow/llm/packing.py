"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

A document is its token ids and an end id. Only documents longer than a sequence are
cut: into full pieces, the first one taking what is left over. A full piece is a sequence
by itself; all other pieces are items. Items are dealt evenly to groups of bounded size; each
group packs best-fit (largest first, into the fullest bin that still takes it), emits the bins
that are nearly full, and hands its underfull bins on. Those are the items of the next
round, in fewer groups, up the tree until one group has packed them or no two bins
met any more. A bin lists its members (a capacity's number at most), so every
round moves only narrow rows; token ids never move.

Pieces are written once and read back, so numbers and ids stay fixed when executors are lost.

Defined cases: null and empty texts are one piece of the end id alone; repeated rows
are packed one by one, whatever their ids; documents without an id are packed too; an empty
table gives no piece; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import map_arrow, staged
from folioflow.llm.vocabularies import BYTE_BPE, byte_encoder, default_path
from folioflow.ship import ship

CAPACITY = 1024
END_ID = 2
# Items that one task packs, and the room up to which a bin counts as full.
GROUP_ITEMS = 32_768
SLACK = 16
# Characters of text that are encoded before their pieces are handed over.
_FLUSH_CHARS = 1 << 20

_MEMBERS = "array<struct<uid: bigint, length: int>>"
_MEMBER = pa.struct([("uid", pa.int64()), ("length", pa.int32())])


def cuts(total: int, capacity: int) -> list[int]:
    """Start of every piece of a document of ``total`` ids; the first piece takes the remainder."""
    first = total % capacity or capacity
    return [0, *range(first, total, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document; ``ids`` are little-endian unsigned 32-bit numbers. Narrow."""
    path = path or default_path(BYTE_BPE)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(path)
        for batch in batches:
            names = batch.column(0)
            rows, number, start, length, ids, filled = [], [], [], [], [], 0

            def flush():
                columns = [names.take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(ids, pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])

            for row, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                encoded = np.array([*encode(text), end_id], dtype="<u4")
                at = cuts(len(encoded), capacity)
                for i, (a, b) in enumerate(zip(at, [*at[1:], len(encoded)])):
                    rows.append(row), number.append(i), start.append(a), length.append(b - a), ids.append(encoded[a:b].tobytes())
                filled += len(text)
                if filled > _FLUSH_CHARS:
                    yield flush()
                    rows, number, start, length, ids, filled = [], [], [], [], [], 0
            if rows:
                yield flush()

    schema = f"doc_id {kind}, piece int, start bigint, length int, ids binary"
    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of every item, taken in the given order; the fullest bin with room is used.

    Open bins are stacked by their room; an integer with one bit per room finds the least room that suffices.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, out = 0, 0, np.empty(len(sizes), dtype=np.int64)
    for i, size in enumerate(sizes.tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_number = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, bin_number = capacity, bins
            bins += 1
        out[i] = bin_number
        room -= size
        if room:
            if not stacks[room]:
                rooms |= 1 << room
            stacks[room].append(bin_number)
    return out


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fill = table.column("fill").to_numpy().astype(np.int64)
        members = table.column("members").combine_chunks()
        bounds = members.offsets.to_numpy().astype(np.int64)
        flat = members.values
        first = pc.struct_field(flat, "uid").to_numpy()[bounds[:-1]]
        # The uid of a bin's first member names the bin, so the order is total and reruns agree.
        order = np.lexsort((first, -fill))
        bins = best_fit(fill[order], capacity)
        order = order[np.argsort(bins, kind="stable")]
        bins.sort()
        counts = np.diff(bounds)[order]
        ends = np.concatenate([[0], np.cumsum(counts)])
        moved = np.repeat(bounds[:-1][order] - ends[:-1], counts) + np.arange(ends[-1])
        starts = np.flatnonzero(np.diff(bins, prepend=-1))
        offsets = np.append(ends[starts], ends[-1]).astype(np.int32)
        packed = pa.ListArray.from_arrays(pa.array(offsets), flat.take(pa.array(moved)))
        filled = np.add.reduceat(fill[order], starts) if len(starts) else fill
        group = pa.array(np.full(len(starts), table.column("grp")[0].as_py() if len(fill) else 0), pa.int64())
        return pa.table([group, pa.array(filled, pa.int32()), packed], names=["grp", "fill", "members"])

    return run


def place(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, slack: int = SLACK) -> DataFrame:
    """(uid, sequence_id, offset) of items (uid unique long, length int of at most ``capacity``)."""
    ship(items.sparkSession)
    schema = f"grp bigint, fill int, members {_MEMBERS}"
    count = items.count()
    groups = max(1, -(-count // group_items))
    bins = items.select(
        F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("grp"),
        F.col("length").cast("int").alias("fill"),
        F.array(F.struct(F.col("uid").cast("bigint").alias("uid"), F.col("length").cast("int").alias("length"))).alias("members"),
    )
    closed = []
    while True:
        packed = staged(bins.groupBy("grp").applyInArrow(_pack_group(capacity), schema), "packing")
        full = F.col("fill") >= capacity - slack
        closed.append(packed.filter(full))
        rest = packed.filter(~full)
        made = packed.agg(F.count(F.lit(1)).alias("bins"), F.coalesce(F.sum(F.when(~full, 1)), F.lit(0)).alias("rest")).first()
        fewer = max(1, -(-made["rest"] // group_items))
        # The last group has met all, or no bin met another, or the tree would not get narrower.
        if groups == 1 or made["bins"] == count or fewer >= groups:
            closed.append(rest)
            break
        bins = rest.withColumn("grp", F.floor(F.col("grp") * fewer / groups).cast("bigint"))
        count, groups = made["rest"], fewer
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    # A sequence is named by its first member; a bin's members are few, their offsets are running sums.
    lists = out.select(F.col("members")[0]["uid"].alias("sequence_id"), F.posexplode("members").alias("at", "m"), F.col("members.length").alias("lengths"))
    before = F.aggregate(F.slice("lengths", 1, F.col("at")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return lists.select(F.col("m.uid").alias("uid"), "sequence_id", before.alias("offset"))


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    columns: Sequence[Column | str] = ("ids",),
    **limits: int,
) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ``columns`` (of ``pieces``), sequence_id, offset."""
    cut = pieces(docs, path, capacity, end_id)
    kept = staged(cut.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "piece", "start", "length", *columns), "pieces")
    whole = kept.filter(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("bigint")})
    rest = kept.filter(F.col("length") < capacity)
    placed = place(rest.select("uid", "length"), capacity, **limits)
    return whole.unionByName(rest.join(placed, "uid").select(*whole.columns)).drop("uid")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, length, ids): the token ids of every sequence in order, from ``pack`` with its ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.size("parts").alias("n_pieces"), "length", ids.alias("ids"))
