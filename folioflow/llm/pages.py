"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: the texts between block-level tags. Each block has
features of its ancestors (tags, the nearest landmark, words of class and id) and of its
text (length, share of link text, ending). A two-label chain (main text or not) is trained
by maximum likelihood on labelled pages and decoded by Viterbi.

Labelled pages are (html, main text); at most MAX_LABELLED are used. Without any, the
generated pages of ``page_samples`` train the model. Training is bounded and runs on
the driver; pages are decoded where they lie, in one narrow pass over the whole html.

Defined cases: null, empty and text-less pages give an empty text; unclosed and stray
tags are tolerated; an unended comment or script takes the rest of the page;
character references are decoded; a line break inside a block is white space;
repeated rows give the same text; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm.common import map_arrow

MAX_LABELLED = 2000
STEPS = 150
PENALTY = 0.02

# A comment, a tag with well-formed quotes, a tag with a stray quote, a declaration.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>",
    re.S,
)
_CUT_TAG = re.compile(r"<[a-zA-Z/!?].*", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RIGHTS = re.compile(r"©|copyright|all rights reserved", re.I)
# Elements whose content is never shown as text of the page.
HIDDEN = frozenset(["script", "style", "head", "noscript", "template", "svg", "iframe", "object", "select", "textarea", "canvas"])
# Their content is no markup: it ends at the literal end tag only. The titles of hidden elements and the templates of a head are passed over alike.
RAW = frozenset(["script", "style", "noscript", "iframe", "textarea"])
RAW_IN_HIDDEN = RAW | {"title", "template"}
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW_IN_HIDDEN}
# Any other element, or text, ends a head whose end tag was left out.
IN_HEAD = frozenset(["base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "script", "style", "template", "head", "html"])
# Other forms of a formula, which are not shown.
NOTES = frozenset(["annotation", "annotation-xml"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
INLINE = frozenset(
    ["a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q",
     "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
     "math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom",
     "menclose", "mfenced", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd"]
)
LANDMARKS = frozenset(["article", "aside", "body", "dialog", "fieldset", "footer", "form", "header", "main", "menu", "nav"])
# A new one of these ends an open one of the same kind.
SELF_ENDING = frozenset(["p", "li", "dt", "dd", "tr", "td", "th", "option"])


class Block:
    """A leaf block: its text, the tags and names above it, and how much of it is link text."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


@lru_cache(maxsize=4096)
def _names(attributes: str) -> tuple[str, ...]:
    found = [next(g for g in m if g is not None) for m in (x.groups() for x in _NAMES.finditer(attributes))]
    return tuple(dict.fromkeys(t.lower() for name in found for t in _TOKEN.findall(name)))


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks with text, in page order."""
    if not page:
        return []
    blocks, stack, parts, link_parts, at = [], [], [], 0, 0
    links, hidden = 0, None

    def flush():
        nonlocal link_parts
        if parts:
            raw = "".join(parts)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append(Block(text, tuple(stack), min(link_parts, len(text))))
            parts.clear()
            link_parts = 0

    while m := _TAG.search(page, at):
        if hidden == "head" and page[at : m.start()].strip("\ufeff \t\r\n\f"):
            hidden = None
        if hidden is None and m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                link_parts += len(piece)
        at = m.end()
        end, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if hidden == "head" and not end and name not in IN_HEAD:
            hidden = None
        if hidden is not None:
            if end and name == hidden:
                hidden = None
            elif not end and name in RAW_IN_HIDDEN and name != hidden and not attributes.endswith("/"):
                stop = _END[name].search(page, at)
                if stop:
                    at = stop.end()
                elif name in RAW:
                    at = len(page)
            continue
        if name in NOTES:
            if not end and not attributes.endswith("/"):
                hidden = name
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if end else links + 1
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        links = 0
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if name in SELF_ENDING and stack[i][0] in LANDMARKS:
                    break
        elif name in HIDDEN:
            if attributes.endswith("/"):
                continue
            if name in RAW:
                stop = _END[name].search(page, at)
                at = stop.end() if stop else len(page)
            else:
                hidden = name
        elif name not in VOID:
            if name in SELF_ENDING or stack and stack[-1][0] == "p":
                closes = (name, "p") if name in SELF_ENDING else ("p",)
                if stack and stack[-1][0] in closes:
                    stack.pop()
            stack.append((name, _names(attributes) if attributes else ()))
    if hidden in (None, "head") and at < len(page):
        parts.append(_CUT_TAG.sub("", page[at:]))
    flush()
    return blocks


def _bucket(value: int, edges: tuple[int, ...]) -> int:
    return sum(value >= e for e in edges)


@lru_cache(maxsize=8192)
def _path_features(path: tuple) -> tuple[str, ...]:
    out, near = {"bias": 1}, "none"
    for tag, names in path:
        out["tag:" + tag] = 1
        for name in names:
            out["name:" + name] = 1
    for tag, names in reversed(path):
        if tag in LANDMARKS:
            near = tag
            break
    for tag, names in reversed(path):
        if names:
            for name in names:
                out["inner:" + name] = 1
            break
    leaf = path[-1][0] if path else "none"
    out["near:" + near] = out["leaf:" + leaf] = out["near:" + near + ":" + leaf] = 1
    return tuple(out)


def features(blocks: list[Block]) -> list[list[str]]:
    """Feature names of every block."""
    out, last = [], len(blocks) - 1
    for i, b in enumerate(blocks):
        n = b.text.count(" ") + 1
        share = b.linked / len(b.text)
        mine = [*_path_features(b.path), f"words:{_bucket(n, (3, 6, 11, 21, 51))}", f"links:{_bucket(int(share * 100), (1, 34, 67))}"]
        if b.text[-1] in ".!?…\"”:;":
            mine.append("ended")
        if len(b.text) < 400 and _RIGHTS.search(b.text):
            mine.append("rights")
        if i == 0:
            mine.append("first")
        if i == last:
            mine.append("last")
        out.append(mine)
    return out


class Chain:
    """Weights: feature to score of label 1, transitions[from][to], start[label]."""

    def __init__(self, weights: dict[str, float], transitions, start):
        self.weights, self.transitions, self.start = weights, transitions, start

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The best labels by Viterbi."""
        if not rows:
            return []
        get, (a, b), (c, d) = self.weights.get, *self.transitions
        zero, one, back = self.start[0], self.start[1], []
        for i, row in enumerate(rows):
            score = 0.0
            for f in row:
                score += get(f, 0.0)
            if i:
                from_zero = (zero + a >= one + c, zero + b >= one + d)
                back.append(from_zero)
                zero, one = max(zero + a, one + c), max(zero + b, one + d)
            one += score
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = 0 if step[label] else 1
            out.append(label)
        return out[::-1]


def labels_of(blocks: list[Block], main_text: str) -> list[int]:
    """1 for the blocks that are, in order, the lines of the main text."""
    lines, at, out = (main_text or "").split("\n"), 0, []
    for b in blocks:
        hit = at < len(lines) and b.text == lines[at]
        at += hit
        out.append(int(hit))
    return out


def train(labelled: Iterable[tuple[str, str]], steps: int = STEPS, penalty: float = PENALTY) -> Chain:
    """Maximum likelihood with an L2 penalty, by AdaGrad over all pages at once."""
    index: dict[str, int] = {}
    pages = []
    for number, (page, main_text) in enumerate(labelled):
        if number >= MAX_LABELLED:
            break
        blocks = leaf_blocks(page)
        if blocks:
            rows = [[index.setdefault(f, len(index)) for f in row] for row in features(blocks)]
            pages.append((rows, labels_of(blocks, main_text)))
    if not pages:
        return Chain({}, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0])
    count, longest = len(pages), max(len(r) for r, _ in pages)
    gold = np.zeros((count, longest), dtype=int)
    mask = np.zeros((count, longest), dtype=bool)
    at_page, at_step, at_feature = [], [], []
    for p, (rows, labels) in enumerate(pages):
        gold[p, : len(labels)], mask[p, : len(labels)] = labels, True
        for t, row in enumerate(rows):
            at_page += [p] * len(row)
            at_step += [t] * len(row)
            at_feature += row
    cell, at_feature = np.array(at_page) * longest + np.array(at_step), np.array(at_feature)
    pair_mask = mask[:, 1:]
    gold_pairs = np.array([[((gold[:, :-1] == i) & (gold[:, 1:] == j) & pair_mask).sum() for j in (0, 1)] for i in (0, 1)], float)
    gold_start = np.bincount(gold[:, 0], minlength=2).astype(float)
    w, trans, start = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    seen = [np.full_like(x, 1e-6) for x in (w, trans, start)]
    for _ in range(steps):
        unary = np.bincount(cell, weights=w[at_feature], minlength=count * longest).reshape(count, longest)
        score = np.stack([np.zeros_like(unary), unary], axis=2)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + trans, axis=1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(trans + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p_one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * mask
        pair = ahead[:, :-1, :, None] + trans + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = np.exp(np.where(pair_mask[:, :, None, None], pair, -np.inf)).sum(axis=(0, 1))
        p_start = np.array([(1 - p_one[:, 0]).sum(), p_one[:, 0].sum()])
        residual = ((gold * mask) - p_one).reshape(-1)
        steps_up = (
            np.bincount(at_feature, weights=residual[cell], minlength=len(index)) - penalty * w,
            gold_pairs - pair - penalty * trans,
            gold_start - p_start - penalty * start,
        )
        for value, total_sq, up in zip((w, trans, start), seen, steps_up):
            total_sq += up * up
            value += 0.5 * up / np.sqrt(total_sq)
    return Chain({f: float(w[i]) for f, i in index.items()}, trans.tolist(), start.tolist())


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    from folioflow.llm.page_samples import labelled_pages

    return train(labelled_pages())


def main_text(page: str | None, chain: Chain) -> str:
    """The lines of a page that the chain takes for main text."""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, label in zip(blocks, chain.decode(features(blocks))) if label)


def extract(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; ``labelled`` (html, text) replaces the generated training pages."""
    if labelled is None:
        chain = default_chain()
    else:
        chain = train((r["html"], r["text"]) for r in labelled.select("html", "text").limit(MAX_LABELLED).collect())
    shared = pages.sparkSession.sparkContext.broadcast((chain.weights, chain.transitions, chain.start))
    columns = pages.select("page_id", "url", "html")

    def run(batches):
        model = Chain(*shared.value)
        for batch in batches:
            texts = [main_text(p.as_py(), model) for p in batch.column(2)]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(columns.dtypes)
    return map_arrow(columns, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
