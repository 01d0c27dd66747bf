"""Benchmark decontamination: n-gram windows of test items looked up in training texts.

Words are runs of ASCII letters and digits and all characters beyond ASCII, with
A-Z lowered. The windows of the items (ten words; shorter items are one window) form a
hash set that is broadcast; every document window is scanned against it, and each
hit is verified by comparing the words. Hit words, spans or documents can be
removed.

The hash set is broadcast in blocks of at most BLOCK_CHARS characters of items,
one narrow pass over the documents per block, so its size on an executor is bounded
whatever the size of the benchmark. No pass shuffles documents.

Defined cases: null texts have no words and are clean; items without a word or an
id are skipped; equal items are all reported; repeated rows are judged alike; an empty
benchmark leaves every document clean; input columns called like added ones are
kept as ``in_<name>``.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import map_arrow, restored, set_aside
from folioflow.llm.tokens import LOWER, text_blocks, window_hashes, word_hashes, word_spans

WINDOW = 10
BLOCK_CHARS = 8 << 20
HITS = ("n_words", "n_hit", "hit_items", "hit_spans")
_FILTER_BITS = 22


class WindowSet:
    """The verified windows of one block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, list[str]] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            starts, stops, _ = word_spans(data, np.array([0, len(data)]))
            if not len(starts):
                continue
            size = min(window, len(starts))
            hashed = window_hashes(word_hashes(data, starts, stops), size)
            hashes.setdefault(size, []).append(hashed)
            low = LOWER[data].tobytes()
            for i in range(len(hashed)):
                key = b" ".join(low[a:b] for a, b in zip(starts[i : i + size], stops[i : i + size]))
                owners = self.words.setdefault(key, [])
                if item not in owners:
                    owners.append(item)
        self.sizes = {}
        for size, parts in hashes.items():
            values = np.unique(np.concatenate(parts))
            seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
            seen[values >> np.uint64(64 - _FILTER_BITS)] = True
            self.sizes[size] = (values, seen)

    def scan(self, data: np.ndarray, ends: np.ndarray):
        """(word starts, stops, first word per row, hit words as bool, {row: items}) of a block of texts."""
        starts, stops, first = word_spans(data, ends)
        hashed = word_hashes(data, starts, stops)
        hit, items, low = np.zeros(len(starts), dtype=bool), {}, None
        for size, (values, seen) in self.sizes.items():
            windows = window_hashes(hashed, size)
            at = np.flatnonzero(seen[windows >> np.uint64(64 - _FILTER_BITS)])
            found = np.searchsorted(values, windows[at])
            at = at[values[np.minimum(found, len(values) - 1)] == windows[at]]
            rows = np.searchsorted(first, at, side="right") - 1
            inside = at + size <= first[rows + 1]
            if low is None and inside.any():
                low = LOWER[data].tobytes()
            for i, row in zip(at[inside].tolist(), rows[inside].tolist()):
                key = b" ".join(low[a:b] for a, b in zip(starts[i : i + size], stops[i : i + size]))
                owners = self.words.get(key)
                if owners:
                    hit[i : i + size] = True
                    items.setdefault(row, set()).update(owners)
        return starts, stops, first, hit, items


def _blocks(benchmark: DataFrame, block_chars: int) -> list[list[tuple[str, str]]]:
    """Items in blocks of bounded size; the iterator holds one partition of items on the driver at a time."""
    blocks, filled = [[]], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).dropna()
    for row in rows.toLocalIterator():
        if filled and filled + len(row["t"]) > block_chars:
            yield blocks.pop()
            blocks, filled = [[]], 0
        blocks[-1].append((row["i"], row["t"]))
        filled += len(row["t"])
    yield blocks.pop()


def _spans(starts: np.ndarray, stops: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges from the first to the last word of each run of hit words."""
    step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return list(zip(starts[np.flatnonzero(step == 1)].tolist(), stops[np.flatnonzero(step == -1) - 1].tolist()))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents plus n_words, n_hit, hit_items (ids as sorted strings) and hit_spans (byte ranges start, end)."""
    out, _ = set_aside(docs, HITS)
    own = len(out.columns)
    schema = T.StructType(
        out.schema.fields
        + [
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("hit_items", T.ArrayType(T.StringType())),
            T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        ]
    )
    context = out.sparkSession.sparkContext
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for number, items in enumerate(_blocks(benchmark, block_chars)):
        shared = context.broadcast(items)

        def scan(batches, shared=shared, again=number > 0):
            windows = WindowSet(shared.value, window)
            for batch in batches:
                text = batch.column(batch.schema.get_field_index("text"))
                counts, hits, ids, spans = [], [], [], []
                for row, rows, data, ends in text_blocks(text):
                    starts, stops, first, hit, found = windows.scan(data, ends)
                    counts += np.diff(first).tolist()
                    for k in range(rows):
                        a, b = first[k], first[k + 1]
                        names = found.get(k, set())
                        own_hit = hit[a:b]
                        if again:
                            names = names | set(batch.column(own + 2)[row + k].as_py())
                            for s in batch.column(own + 3)[row + k].as_py():
                                where = (starts[a:b] - ends[k] >= s["start"]) & (stops[a:b] - ends[k] <= s["end"])
                                own_hit = own_hit | where
                        hits.append(int(own_hit.sum()))
                        ids.append(sorted(names))
                        spans.append([{"start": int(s - ends[k]), "end": int(e - ends[k])} for s, e in _spans(starts[a:b], stops[a:b], own_hit)] if hits[-1] else [])
                added = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, span_type)]
                names = [*batch.schema.names[:own], *HITS]
                yield pa.RecordBatch.from_arrays([*batch.columns[:own], *added], names=names)

        out = map_arrow(out, scan, schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: counts, the hit items and their digest, whether it is contaminated."""
    hits = find_hits(docs.select("doc_id", "text"), benchmark, **options)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Only the documents without a hit, with their own columns."""
    docs, original = set_aside(docs, HITS)
    return restored(find_hits(docs, benchmark, **options).filter("n_hit = 0"), original)


def without_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All documents, their hit spans cut out of the text."""
    docs, original = set_aside(docs, HITS)
    hits = find_hits(docs, benchmark, **options)
    raw = F.col("text").cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.col("hit_spans")["end"])
    ends = F.concat(F.col("hit_spans")["start"], F.array(F.octet_length("text").cast("bigint")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(raw, a.cast("int") + 1, (b - a).cast("int")))
    cut = F.aggregate(pieces, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p)).cast("string")
    return restored(hits.withColumn("text", F.when(F.size("hit_spans") > 0, cut).otherwise(F.col("text"))), original)
