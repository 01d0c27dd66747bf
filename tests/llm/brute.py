"""Plain Python forms of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def space_words(text):
    return SPACE_WORD.findall(text or "")


def fingerprint(text):
    ws = space_words((text or "").translate(LOWER))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(ids, linked):
    """{index: smallest id} under the pair test ``linked(i, j)``."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return [least[find(i)] for i in range(len(ids))]


def benchmark_windows(items):
    out = {}
    for item, text in items:
        ws = BENCH_WORD.findall((text or "").translate(LOWER))
        size = min(10, len(ws))
        for i in range(len(ws) - size + 1 if ws else 0):
            out.setdefault(tuple(ws[i : i + size]), set()).add(str(item))
    return out


def hits(text, windows):
    """(n_words, n_hit, n_items, digest) of one document."""
    ws, hit, items = BENCH_WORD.findall((text or "").translate(LOWER)), set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(ws) - size + 1):
            owners = windows.get(tuple(ws[i : i + size]))
            if owners:
                hit.update(range(i, i + size))
                items |= owners
    return len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def repeated_lines(rows):
    """{doc_id: line numbers} of lines equal or similar (5-word shingles, Jaccard 0.8) to an earlier line."""
    earlier, out = [], {}
    for doc, text in sorted(rows):
        for number, line in enumerate((text or "").split("\n")):
            ws = space_words(line.lower())
            if not ws:
                continue
            grams = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}
            if any(5 * len(grams & e) >= 4 * len(grams | e) for e in earlier):
                out.setdefault(doc, []).append(number)
            earlier.append(grams)
    return out


def targets(sizes, weights=(1, 2, 3), cap=3):
    """{source: target} with the excess over the caps shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed |= {s: cap * sizes[s] for s in over}
