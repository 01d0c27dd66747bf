"""Word hashes of whole text batches, computed on the UTF-8 bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes per numpy block: working arrays take some thirty times as much.
BLOCK_BYTES = 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xC2B2AE3D27D4EB4F | 1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)

# Letters, digits and everything beyond ASCII are word bytes; A-Z are lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def text_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of consecutive rows of about BLOCK_BYTES; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(ends, ends[row] + BLOCK_BYTES, side="right")) - 1
        stop = min(len(column), max(row + 1, stop))
        yield row, stop - row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of its first word per row (rows + 1 values)."""
    mask = np.zeros(len(data) + 2, dtype=np.int8)
    mask[1:-1] = ALNUM[data]
    step = np.diff(mask)
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # Words that touch across a row border are two words.
    inner = ends[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    if len(inner):
        cut = inner[(mask[inner] == 1) & (mask[inner + 1] == 1)]
        starts, stops = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([stops, cut]))
    return starts, stops, np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every lower-cased word: a polynomial over its bytes, the same wherever the word stands."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * _powers(_P, n), out=sums[1:])
    out = (sums[stops] - sums[starts]) * _powers(_INVERSE, n)[starts]
    out ^= out >> np.uint64(29)
    return out * _MIX


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, factor = np.zeros(n, dtype=np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(size):
            out += words[k : k + n] * factor
            factor = factor * _Q
    return out ^ (out >> np.uint64(31))
