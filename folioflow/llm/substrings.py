"""Substring dedup by hashing every run of MIN_WORDS words of every text.

Words are taken in lower case and without white space; a word also ends where a sentence
ends. In scripts written without spaces each character stands for half a word. Every word
starts a gram, the shortest run that holds MIN_WORDS words; a gram whose digest occurred
earlier by (doc_id, position) is repeated, and all the words it covers are. So every word
of a passage of MIN_WORDS words or more that occurred earlier is found, wherever the passage
was pasted. Repeated sentences too short for a gram are covered as well; runs of covered words
that hold MIN_WORDS words are removed. A repeated line too short for a gram is
removed on its own if it holds MIN_LINE_CHARS characters. Original character offsets are returned.

Digests have 72 bits, and 32 more pick the bucket. They are met in numpy: a task packs the digests of some 600,000 words
by bucket, keeps only their first occurrence in that block, and each bucket compares the first
ones of all blocks, so a line that a third of all documents share is no hot task; only
positions come back to a document.

Defined cases: null and blank texts have no words and are returned as they are; rows without
an id rank last; rows equal in id and text are one document and get the same
result; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import map_arrow

MIN_WORDS = 8
MIN_LINE_CHARS = 4
BLOCK_WORDS = 600_000
BUCKET_CHARS = 16_000_000
_SENTENCE = re.compile(r"[^\n.!?。！？]*[.!?。！？]*[^\S\n]*\n?")
# Scripts written without spaces: Thai, Lao, Tibetan, Burmese, Khmer, kana, bopomofo, Han and their punctuation.
_SOLID = "\u0e00-\u109f\u1780-\u17ff\u3000-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff0f\uff1a-\uff20\uff61-\uff9f\U00020000-\U0003ffff"
_IS_SOLID = re.compile(f"[{_SOLID}]")
_WORD = re.compile(r"\S+")
_PART = re.compile(rf"(?!\s)[{_SOLID}]|[^\s{_SOLID}]+")
_LAST = (1 << 63) - 1
_SHORT, _LINE = 1 << 30, 1 << 31
_U = np.uint64
_STEPS = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)


def _parts_of(text: str) -> re.Pattern:
    return _WORD if text.isascii() or not _IS_SOLID.search(text) else _PART


class _Words(dict):
    """Word to its number, with digest halves, weight (2 a word, 1 a solid character) and length by number."""

    def __init__(self):
        self.rows = []

    def __missing__(self, word):
        number = self[word] = len(self.rows)
        a, b = divmod(xxhash.xxh3_128_intdigest(word.encode("utf-8", "surrogatepass")), 1 << 64)
        self.rows.append((a, b, 1 if len(word) == 1 and _IS_SOLID.match(word) else 2, len(word)))
        return number

    def columns(self):
        return [np.array(c, dtype=t) for c, t in zip(zip(*self.rows), (_U, _U, np.int64, np.int64))]


def _numbers(text: str, known: _Words) -> tuple[list[int], list[int], list[int]]:
    """Word numbers of a text; where its sentences and its lines end, in words."""
    pattern, out, ends, lines = _parts_of(text), [], [], []
    get = known.__getitem__
    for sentence in _SENTENCE.findall(text):
        if pattern is _WORD:
            out.extend(map(get, sentence.lower().split()))
        else:
            out.extend(get(p.lower()) for p in pattern.findall(sentence))
        ends.append(len(out))
        if sentence[-1:] == "\n":
            lines.append(len(out))
    lines.append(len(out))
    return out, ends, lines


def _gram_ends(weights: np.ndarray, need: int) -> np.ndarray:
    """Per word the end of its gram; beyond the number of words where too few follow."""
    total = np.concatenate([[0], np.cumsum(weights)])
    return np.searchsorted(total, total[:-1] + need)


_powers: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _digests(halves, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests (64, 8 and 32 bits) of the word runs [start, end), by running sums of powers; kinds never meet."""
    size, out = len(halves[0]), []
    if not _powers or len(_powers[0]) < size:
        _powers.clear()
        for step in _STEPS:
            for base in (step, pow(step, -1, 1 << 64)):
                row = np.full(size + size // 4 + 1, base, dtype=_U)
                row[0] = 1
                _powers.append(np.cumprod(row, dtype=_U))
    for i, half in enumerate(halves):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(half * _powers[2 * i][:size], dtype=_U)])
        out.append(_mixed((sums[ends] - sums[starts]) * _powers[2 * i + 1][starts] + kinds.astype(_U)))
    return out[0], out[1].astype(np.uint8), out[1] >> _U(32)


def _stamp(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _home(docs: np.ndarray, stamps: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(docs.astype(_U) * _U(_STEPS[0]) + stamps.astype(_U)) % _U(buckets)).astype(np.int64)


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, which the shuffle compresses."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).reshape(-1)


def _packed_places(docs, stamps, at) -> list[bytes]:
    """Places in order as documents, stamps, counts and steps."""
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (stamps[1:] != stamps[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(docs))).astype(np.uint32)
    steps = np.diff(at, prepend=np.uint32(0))
    return [_planes(np.diff(docs[first], prepend=np.int64(0))), stamps[first].tobytes(), _planes(counts), _planes(steps)]


def _places(docs: bytes, stamps: bytes, counts: bytes, steps: bytes):
    counts = _from_planes(counts, np.uint32)
    docs, stamps = np.cumsum(_from_planes(docs, np.int64)), np.frombuffer(stamps, np.uint32)
    return np.repeat(docs, counts), np.repeat(stamps, counts), np.cumsum(_from_planes(steps, np.uint32), dtype=np.uint32)


def _later(h1, h2, docs, stamps, at) -> np.ndarray:
    """Which places are not the first of their digest."""
    order = np.argsort(h1, kind="stable")
    ranked = h1[order]
    same = np.zeros(len(h1) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    some = order[same[1:] | same[:-1]]
    out = np.zeros(len(h1), dtype=bool)
    if len(some):
        some = some[np.lexsort((at[some], stamps[some], docs[some], h2[some], h1[some]))]
        a, b = h1[some], h2[some]
        new = np.ones(len(some), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first = some[np.flatnonzero(new)][np.cumsum(new) - 1]
        out[some] = (docs[some] != docs[first]) | (stamps[some] != stamps[first]) | (at[some] != at[first])
    return out


_ROW = "bucket int, kind int, doc_id long, docs binary, stamps binary, counts binary, steps binary, h1 binary, h2 binary"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]


def _batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _dealt(bucket, kind: int, docs, stamps, at, *hashes) -> list[tuple]:
    """One packed row per bucket that has places."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    rows = []
    for mine in np.split(order, cuts) if len(order) else ():
        own = [h[mine].tobytes() for h in hashes] or [None, None]
        rows.append((int(bucket[mine[0]]), kind, None, *_packed_places(docs[mine], stamps[mine], at[mine]), *own))
    return rows


def _block_rows(known: _Words, numbers, ends, lines, sizes, owners, stamps, need: int, buckets: int) -> list[tuple]:
    """Packed rows of a block of documents: kind 0 places already known as repeated, kind 1 the first ones with digests."""
    a, b, weight, length = known.columns()
    words = np.concatenate(numbers)
    sizes = np.array(sizes, dtype=np.int64)
    offsets = np.cumsum(sizes) - sizes
    weight = weight[words]
    grams = _gram_ends(weight, need)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(grams <= np.repeat(offsets + sizes, sizes))
    total, chars = np.concatenate([[0], np.cumsum(weight)]), np.concatenate([[0], np.cumsum(length[words])])
    runs = [(starts, grams[starts], 0)]
    for borders, kind in ((ends, _SHORT), (lines, _LINE)):
        stop = np.unique(np.concatenate([[0], *[np.array(e, dtype=np.int64) + o for e, o in zip(borders, offsets)], offsets]))
        begin, stop = stop[:-1], stop[1:]
        short = total[stop] - total[begin] < need
        if kind == _LINE:
            short &= chars[stop] - chars[begin] >= MIN_LINE_CHARS
        runs.append((begin[short], stop[short], kind))
    begin, stop = np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])
    kinds = np.repeat(np.array([r[2] for r in runs], dtype=np.int64), [len(r[0]) for r in runs])
    h1, h2, pick = _digests((a[words], b[words]), begin, stop, kinds)
    doc = doc[begin]
    at = (begin - offsets[doc] + kinds).astype(np.uint32)
    order = np.lexsort((at, doc))
    h1, h2, pick, doc, at = h1[order], h2[order], pick[order], doc[order], at[order]
    docs, stamps = np.array(owners, dtype=np.int64)[doc], np.array(stamps, dtype=np.uint32)[doc]
    later = _later(h1, h2, docs, stamps, at)
    first = ~later
    rows = _dealt(_home(docs[later], stamps[later], buckets), 0, docs[later], stamps[later], at[later])
    home = (pick[first] * _U(buckets) >> _U(32)).astype(np.int64)
    return rows + _dealt(home, 1, docs[first], stamps[first], at[first], h1[first], h2[first])


def _digest_rows(docs: DataFrame, need: int, buckets: int) -> DataFrame:
    block_words = BLOCK_WORDS

    def run(batches):
        known, held = _Words(), [[] for _ in range(6)]
        count = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                found, ends, lines = _numbers(text, known)
                if not found:
                    continue
                own = (np.array(found, dtype=np.int32), ends, lines, len(found), _LAST if doc.as_py() is None else doc.as_py(), _stamp(text))
                for column, value in zip(held, own):
                    column.append(value)
                count += len(found)
                if count >= block_words:
                    yield _batch(_block_rows(known, *held, need, buckets))
                    held, count = [[] for _ in range(6)], 0
                    if len(known) > 500_000:
                        known = _Words()
        if count:
            yield _batch(_block_rows(known, *held, need, buckets))

    return map_arrow(docs.select("doc_id", "text"), run, _ROW)


def _met(rows: DataFrame, buckets: int) -> DataFrame:
    """Packed places (kind 0) of all units that occurred earlier, by the home of their document."""

    def run(batches):
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    yield _batch([tuple(row[c] for c in _NAMES)])
                else:
                    places = _places(row["docs"], row["stamps"], row["counts"], row["steps"])
                    held.append((np.frombuffer(row["h1"], _U), np.frombuffer(row["h2"], np.uint8), *places))
        if held:
            h1, h2, docs, stamps, at = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            later = _later(h1, h2, docs, stamps, at)
            docs, stamps, at = docs[later], stamps[later], at[later]
            order = np.lexsort((at, stamps, docs))
            docs, stamps, at = docs[order], stamps[order], at[order]
            yield _batch(_dealt(_home(docs, stamps, buckets), 0, docs, stamps, at))

    return map_arrow(rows.repartitionById(buckets, F.col("bucket")), run, _ROW)


def _text_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """Compressed texts (kind 1, in the column docs), by the home of their document."""

    def run(batches):
        for batch in batches:
            ids, packed, stamps = batch.column(0).to_pylist(), [], []
            for text in batch.column(1):
                text = text.as_py()
                raw = None if text is None else text.encode("utf-8", "surrogatepass")
                stamps.append(zlib.crc32(raw or b""))
                packed.append(None if raw is None else zlib.compress(raw, 1))
            keys = np.array([_LAST if i is None else i for i in ids], dtype=np.int64)
            home = _home(keys, np.array(stamps, dtype=np.uint32), buckets).tolist()
            yield _batch([(h, 1, i, p, *[None] * 5) for h, i, p in zip(home, ids, packed)])

    return map_arrow(docs.select("doc_id", "text"), run, _ROW)


def removed_spans(text: str, places, min_words: int) -> list[tuple[int, int]]:
    """Character ranges to remove, from the places of repeated grams, short sentences and short lines."""
    pattern, begins, stops, weights, ends, lines = _parts_of(text), [], [], [], {}, {}
    first = line = 0
    for sentence in _SENTENCE.finditer(text):
        begin, stop = sentence.span()
        own = [m.start() for m in pattern.finditer(text, begin, stop)]
        if own:
            weights += [1 if pattern is _PART and _IS_SOLID.match(text, i) else 2 for i in own]
            own[0] = begin
            begins += own
            stops += [*own[1:], stop]
            ends[first] = first = len(begins)
        if text[stop - 1 : stop] == "\n" and line < first:
            lines[line] = line = first
    lines[line] = first
    grams, step = _gram_ends(np.array(weights, dtype=np.int64), 2 * min_words), np.zeros(len(begins) + 1, dtype=np.int64)
    whole = np.zeros(len(begins), dtype=bool)
    for place in places:
        if place >= _LINE:
            whole[place - _LINE : lines[place - _LINE]] = True
        else:
            start = place - _SHORT if place >= _SHORT else place
            step[start] += 1
            step[ends[start] if place >= _SHORT else grams[place]] -= 1
    covered = (np.cumsum(step[:-1]) > 0) | whole
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]])))
    gone = whole.copy()
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if sum(weights[a:b]) >= 2 * min_words:
            gone[a:b] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).tolist()
    return [(begins[a], stops[b - 1]) for a, b in zip(edges[::2], edges[1::2])]


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, n_chars, n_removed (characters), removed (array of start, end), text (what is left)."""
    chars = docs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    met = _met(_digest_rows(docs, 2 * min_words, buckets), buckets)
    marked = met.unionByName(_text_rows(docs, buckets)).drop("h1", "h2")
    marked = marked.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        held, found = [], None
        for batch in batches:
            sizes, gone, ranges, left, ids = [], [], [], [], []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    held.append(_places(row["docs"], row["stamps"], row["counts"], row["steps"]))
                    continue
                if found is None:
                    found = {}
                    if held:
                        owners, stamps, at = [np.concatenate(c) for c in zip(*held)]
                        held.clear()
                        order = np.lexsort((stamps, owners))
                        owners, stamps, at = owners[order], stamps[order], at[order]
                        cuts = np.flatnonzero((owners[1:] != owners[:-1]) | (stamps[1:] != stamps[:-1])) + 1
                        begins = [0, *cuts.tolist()]
                        found = {(int(owners[i]), int(stamps[i])): (i, j) for i, j in zip(begins, [*begins[1:], len(at)])}
                raw = None if row["docs"] is None else zlib.decompress(row["docs"])
                text = None if raw is None else raw.decode("utf-8", "surrogatepass")
                place = found.get((_LAST if row["doc_id"] is None else row["doc_id"], zlib.crc32(raw or b"")))
                spans = removed_spans(text, at[place[0] : place[1]].tolist(), min_words) if place else []
                kept, end_of_last = [], 0
                for start, end in spans:
                    kept.append(text[end_of_last:start])
                    end_of_last = end
                ids.append(row["doc_id"])
                sizes.append(len(text or ""))
                gone.append(sum(end - start for start, end in spans))
                ranges.append([{"start": s, "end": e} for s, e in spans])
                left.append("".join([*kept, text[end_of_last:]]) if spans else text)
            columns = zip((ids, sizes, gone, ranges, left), (pa.int64(), pa.int64(), pa.int64(), span, pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["doc_id", "n_chars", "n_removed", "removed", "text"])

    return map_arrow(marked, run, "doc_id long, n_chars long, n_removed long, removed array<struct<start: long, end: long>>, text string")
