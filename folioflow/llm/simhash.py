"""SimHash near-dedup with anchor-point covering.

A fingerprint is the bitwise majority of the XXH64 values (seed 42) of a text's
3-word shingles. Fingerprints that differ in at most ``bits`` bits are linked, and
linked fingerprints form components.

Links are found with covering codes. The 64 bits are split into two halves: two
fingerprints within 2 (or 3) bits differ in at most one bit of some half. On 31 bits of a half
the perfect Hamming code covers every point within radius 1. Each fingerprint is at
home at its anchor (the code word within the radius) and is replicated to every anchor
within radius + 1; a linked pair meets where one is at home. That is one home and
at most sixteen copies per half, for any data.

Equal fingerprints are one node, so copies are never expanded. Components come
from large-star/small-star rounds over the links, each written to the shared folder.

Defined cases: null and blank texts have fingerprint 0, linked like any other; a
text of fewer than three words is one shingle; repeated rows share a node and are
one document to ``keep_one``; an empty table gives no rows; other columns pass
through ``keep_one`` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import map_arrow, restored, set_aside, staged

SEED = 42
SHINGLE = 3
BITS = 2
_BLOCK = 1 << 15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(parts) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[len(parts) - n :].tolist()
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, _BLOCK):
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[a : a + _BLOCK], ends[a : a + _BLOCK])], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def with_fingerprints(docs: DataFrame, name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Documents plus their fingerprint as a long. Narrow."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            values = pa.array([fingerprint(t.as_py(), shingle) for t in text], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    return map_arrow(docs, run, schema)


def _syndrome(half: Column) -> Column:
    """Number of the bit (1..31) to flip for the nearest Hamming code word; 0 for a code word."""
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1)
        out = out + F.pmod(F.bit_count(half.bitwiseAND(F.lit(mask))), F.lit(2)) * (1 << j)
    return out


def _bit(i: Column) -> Column:
    """Bit number i (1..31) as a long; 0 for i = 0."""
    return F.when(i > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i - 1)).otherwise(F.lit(0).cast("bigint"))


def _half(fp: Column, part: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * part).bitwiseAND(F.lit((1 << 31) - 1))


def _home(half: Column, syndrome: Column) -> Column:
    return half.bitwiseXOR(_bit(syndrome))


def _within_two(half: Column, s: Column) -> Column:
    """All code words within 2 bits: the home, and for non-code words the 15 pairs of flips with the same syndrome."""
    numbers = F.sequence(F.lit(1), F.lit(31))
    pairs = F.filter(numbers, lambda i: (s > 0) & (i < i.bitwiseXOR(s)))
    others = F.transform(pairs, lambda i: half.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(s))))
    return F.concat(F.array(_home(half, s)), others)


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints within ``bits`` bits; ``prints`` has one row per ``fp``.

    The join tests candidates as it meets them and gives links only. A fingerprint
    has at most 2,080 neighbours within two bits, so links stay in proportion.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two halves with a radius-1 code find pairs of up to 3 bits")
    halves = prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))
    halves = halves.withColumn("half", F.when(F.col("part") == 0, _half(F.col("fp"), 0)).otherwise(_half(F.col("fp"), 1)))
    halves = halves.withColumn("s", _syndrome(F.col("half")))
    home = halves.select(F.col("fp").alias("a"), "part", _home(F.col("half"), F.col("s")).alias("anchor"))
    near = halves.select(F.col("fp").alias("b"), "part", F.explode(_within_two(F.col("half"), F.col("s"))).alias("anchor"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    met = home.join(near, ["part", "anchor"]).filter((F.col("a") != F.col("b")) & close)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(pairs: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): the smallest node reachable, for every node in ``pairs`` (a, b).

    Large-star and small-star steps alternate until the links form stars. Rounds
    grow with the logarithm of the component size; only links are held.
    """
    edges = staged(pairs.select("a", "b"), name)
    size = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while size[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("n", "m")).filter("a <> b").distinct()
        edges = staged(small, name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == tuple(size):
            break
        size = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(edges.select(F.col("b"), F.col("b")).distinct())


def _rooted(prints: DataFrame, stars: DataFrame) -> DataFrame:
    """Rows with ``fp``, plus the root of its component."""
    return prints.join(stars, F.col("fp") == F.col("node"), "left").select(*prints.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (smallest id reachable, itself included)."""
    rows = staged(with_fingerprints(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"), "simhash-rows")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    stars = components(links(staged(prints, "simhash-prints"), bits))
    rooted = _rooted(prints, stars)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp")


def report(docs: DataFrame, **options) -> DataFrame:
    found = near_duplicates(docs, **options)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """The document with the smallest id of each component, with its own columns.

    A document is an id and a text: of those that share the smallest id, the one with the
    lowest fingerprint and then the lowest text hash is kept, once. Rows without an
    id are ranked among themselves: a component keeps one of them beside the one with an id.
    """
    docs, original = set_aside(docs, ["_keepdoc_id", "_keep_h1", "_keep_h2", "_h1", "_h2"])
    hashes = [F.xxhash64("text").alias("_h1"), F.hash("text").alias("_h2")]
    prints = with_fingerprints(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp", *hashes)
    least = F.min(F.struct("doc_id", "fp", "_h1", "_h2")).alias("_keep")
    prints = staged(prints.groupBy("fp", F.col("doc_id").isNull().alias("_none")).agg(least), "simhash-least")
    stars = components(links(prints.select("fp").distinct(), bits))
    kept = _rooted(prints, stars).groupBy("root", "_none").agg(F.min("_keep").alias("_keep"))
    kept = kept.select(*[F.col(f"_keep.{c}").alias(f"_keep{c}") for c in ("doc_id", "_h1", "_h2")])
    same = F.col("doc_id").eqNullSafe(F.col("_keepdoc_id")) & (F.col("_h1") == F.col("_keep_h1")) & (F.col("_h2") == F.col("_keep_h2"))
    rows = docs.select("*", *hashes).join(kept, same, "left_semi").dropDuplicates(["doc_id", "_h1", "_h2"])
    return restored(rows, original)
