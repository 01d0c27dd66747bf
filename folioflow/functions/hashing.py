"""Fingerprints as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cache_key(url: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the address."""
    return F.substring(F.sha1(F.encode(url, "UTF-8")), 1, 16)


def cache_path(namespace: Column | str, url: Column) -> Column:
    space = F.lit(namespace) if isinstance(namespace, str) else namespace
    return F.concat_ws("/", F.lit("_preview_source"), space, cache_key(url))


def source_fingerprint(source_type: Column, file_path: Column, url: Column) -> Column:
    value = F.when(source_type == "file", F.trim(F.coalesce(file_path, F.lit("")))).otherwise(
        F.trim(F.coalesce(url, F.lit("")))
    )
    return F.concat_ws(":", source_type, value)


def gradient_hash(px: Column, width: int) -> Column:
    """Gradient bits of a grid already at hash size: is a cell brighter than its left neighbour?

    The first comparison is the highest bit; a 9x8 grid gives 64 bits (signed).
    """
    cells = F.sequence(F.lit(0), F.size(px) - 1)
    pairs = F.filter(cells, lambda i: i % width > 0)
    return F.aggregate(
        pairs,
        F.lit(0).cast("bigint"),
        lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(F.when(px[i] > px[i - 1], 1).otherwise(0).cast("bigint")),
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
