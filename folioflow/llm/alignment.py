"""Cross-tokenizer alignment: where two tokenizers' tokens end at the same byte.

Tokenizer A (byte-level) reads a space and the text, tokenizer B (pieces) the text, to which it
adds the space itself. Byte offsets at which a token of both ends cut the two rows into
groups; the two tokens that end there are linked. How often an id pair is linked in
the whole corpus tells how good a link is.

Method: exact-text deduplication. Documents are shuffled by their whole text; every
distinct text is encoded and aligned once, its pairs count as often as the text occurs, and
the measures return to the documents by a join on the text's SHA-256. Distinct texts are staged
with their pair numbers, so no text is encoded twice; texts themselves move once.

Pair counts are broadcast only when their counted rows are within ``common.BROADCAST_ROWS``;
beyond that the same join is shuffled, where hot pairs split under adaptive execution.

Defined cases: null and empty texts, and texts that the pieces do not give back byte for
byte, have no tokens: zeros and ''. Repeated rows get one row each; documents without an
id are measured and counted too; an empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import map_arrow, sized, staged
from folioflow.llm.vocabularies import BYTE_BPE, PIECE_BPE, byte_encoder, byte_tokens, default_path, lengths, piece_encoder, piece_tokens

MEASURES = ("n_a", "n_b", "n_groups", "n_links")
# Characters of text that are aligned in one numpy block.
BLOCK_CHARS = 1 << 19


class Aligner:
    """Two tokenizers and the tables of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.encode_a, self.encode_b = byte_encoder(a_path), piece_encoder(b_path)
        self.tokens_a, self.tokens_b = byte_tokens(a_path), piece_tokens(b_path)
        self.size_a, self.size_b = lengths(self.tokens_a), lengths(self.tokens_b)
        names_a, names_b = (np.arange(len(t)).astype(str).astype(object) for t in (self.tokens_a, self.tokens_b))
        self.inner_a, self.last_a = names_a + ",", names_a + "|"
        self.inner_b, self.last_b = names_b + ",", names_b + ";"

    def encode(self, text: str | None) -> tuple[list[int], list[int]] | None:
        """Ids by A and by B, or None where the text has no tokens."""
        if not text:
            return None
        a, b, data = self.encode_a(" " + text), self.encode_b(text), b" " + text.encode("utf-8")
        same = b"".join(map(self.tokens_a.__getitem__, a)) == data and b"".join(map(self.tokens_b.__getitem__, b)) == data
        return (a, b) if same else None

    def block(self, texts: list[str]) -> tuple[list, ...]:
        """Per text: the four measures, the groups as text, and its distinct pair numbers with their links."""
        encoded = [self.encode(t) or ([], []) for t in texts]
        n_a, n_b = (np.array([len(e[i]) for e in encoded], dtype=np.int64) for i in (0, 1))
        ids_a, ids_b = (np.fromiter((x for e in encoded for x in e[i]), dtype=np.int64, count=int(n.sum())) for i, n in ((0, n_a), (1, n_b)))
        # Both rows of a text hold the same bytes, so one running offset serves the whole block.
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        mark_a, mark_b = (np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, dtype=bool) for _ in range(2))
        mark_a[ends_a], mark_b[ends_b] = True, True
        cut_a, cut_b = mark_b[ends_a], mark_a[ends_b]
        groups_a, groups_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        # Tokens of one side ahead of a group: A of group g follow all B of the groups before it, B of g all A up to it.
        b_ahead = np.concatenate([[0], np.flatnonzero(cut_b) + 1])
        a_upto = np.flatnonzero(cut_a) + 1
        written = np.empty(len(ids_a) + len(ids_b), dtype=object)
        written[np.arange(len(ids_a)) + b_ahead[groups_a]] = np.where(cut_a, self.last_a[ids_a], self.inner_a[ids_a])
        written[np.arange(len(ids_b)) + a_upto[groups_b]] = np.where(cut_b, self.last_b[ids_b], self.inner_b[ids_b])
        bounds_a = np.concatenate([[0], np.cumsum(n_a)])
        bounds = bounds_a + np.concatenate([[0], np.cumsum(n_b)])
        written = written.tolist()
        groups = ["".join(written[lo:hi])[:-1] for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        owner = np.repeat(np.arange(len(texts)), n_a)[cut_a]
        n_groups = np.bincount(owner, minlength=len(texts))
        pairs = ids_a[cut_a] * len(self.tokens_b) + ids_b[cut_b]
        keyed, hits = np.unique((owner << 32) | pairs, return_counts=True)
        at = np.searchsorted(keyed >> 32, np.arange(len(texts) + 1)).astype(np.int32)
        codes, hits = (keyed & 0xFFFFFFFF).astype(np.int32), hits.astype(np.int32)
        return n_a, n_b, n_groups, groups, at, codes, hits


@lru_cache(maxsize=2)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _aligned(texts: DataFrame, a_path: str, b_path: str, groups: bool) -> DataFrame:
    """``texts`` (text, copies) -> measures, pairs and, where asked for, the written groups. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _aligner(a_path, b_path)

        def out(texts, copies):
            n_a, n_b, n_groups, written, at, codes, hits = own.block(texts)
            digests = [hashlib.sha256(t.encode("utf-8")).digest() for t in texts]
            columns = {
                "text_sha": pa.array(digests, pa.binary()), "copies": pa.array(copies, pa.int64()), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_groups,
                "groups_sha256": pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in written], pa.string()),
                "pairs": pa.ListArray.from_arrays(at, pa.array(codes)), "hits": pa.ListArray.from_arrays(at, pa.array(hits)),
            }
            if groups:
                columns["groups"] = pa.array(written, pa.string())
            return pa.RecordBatch.from_pydict({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()})

        for batch in batches:
            held, copies, filled = [], [], 0
            for text, n in zip(batch.column(0), batch.column(1).to_pylist()):
                held.append(text.as_py()), copies.append(n)
                filled += len(held[-1])
                if filled > BLOCK_CHARS:
                    yield out(held, copies)
                    held, copies, filled = [], [], 0
            if held:
                yield out(held, copies)

    schema = "text_sha binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>, hits array<int>"
    return map_arrow(texts, run, schema + (", groups string" if groups else ""))


def align_texts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, groups: bool = False) -> DataFrame:
    """One row per distinct text with tokens or not: text_sha, copies, measures, groups_sha256, pairs and hits (and ``groups``), staged."""
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    aligned = _aligned(texts, a_path or default_path(BYTE_BPE), b_path or default_path(PIECE_BPE), groups)
    return staged(aligned.select(F.monotonically_increasing_id().alias("tid"), *aligned.columns), "aligned")


def _exploded(aligned: DataFrame) -> DataFrame:
    zipped = F.explode(F.arrays_zip("pairs", "hits")).alias("p")
    return aligned.select("tid", "copies", zipped).select("tid", "copies", F.col("p.pairs").alias("pair"), F.col("p.hits").alias("hits"))


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): links of every id pair in the corpus, and whether no pair of its B id has more."""
    counts = _exploded(aligned).groupBy("pair").agg(F.sum(F.col("copies") * F.col("hits")).alias("n"))
    counts = staged(counts.withColumn("b", F.col("pair") % n_b), "pairs")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    a_path, b_path = a_path or default_path(BYTE_BPE), b_path or default_path(PIECE_BPE)
    aligned = align_texts(docs, a_path, b_path)
    counts = staged(pair_counts(aligned, len(piece_tokens(b_path))), "pair-counts")
    scored = _exploded(aligned).join(sized(counts), "pair").groupBy("tid").agg(
        F.sum(F.when(F.col("best"), F.col("hits")).otherwise(0)).cast("bigint").alias("n_best"), F.sum(F.col("hits") * F.col("n")).alias("count_sum")
    )
    measured = staged(aligned.select("tid", "text_sha", *MEASURES, "groups_sha256").join(scored, "tid", "left").drop("tid"), "measured")
    keyed = docs.select("doc_id", F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("text_sha"))
    zero = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in (*MEASURES, "n_best", "count_sum")]
    return keyed.join(measured, "text_sha", "left").select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def vocabulary_map(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(a, b, n, best): the corpus-wide table of linked ids, a mapping between the two vocabularies."""
    b_path = b_path or default_path(PIECE_BPE)
    n_b = len(piece_tokens(b_path))
    counts = pair_counts(align_texts(docs, a_path, b_path), n_b)
    return counts.select(F.floor(F.col("pair") / n_b).cast("int").alias("a"), (F.col("pair") % n_b).alias("b"), "n", "best")
