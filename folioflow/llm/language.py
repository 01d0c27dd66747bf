"""Language identification by multilingual mixture inference.

Every language is a distribution over hashed byte 3-grams, counted over all training texts.
A document is a mixture: expectation-maximisation finds the proportions of the
languages that explain its 3-grams best. The language set grows from the largest
proportion while the likelihood gains more than a penalty per language (BIC); the
largest proportion in the chosen set is the prediction and its score.

The model has BUCKETS values per language whatever the corpus; counting combines per
task before its shuffle, and prediction is one narrow pass.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as
is everything when nothing can be learned; ties go to the language that sorts
first; repeated rows are predicted alike; training ignores rows without text or language;
only the named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import map_arrow
from folioflow.llm.tokens import ALNUM, LOWER, text_blocks

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ROUNDS = 12
SMOOTHING = 0.5
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.where(ALNUM, LOWER, 0x20).astype(np.uint32)
_FOLD[0x30:0x3A] = 0x20


def grams(data: np.ndarray) -> np.ndarray:
    """Buckets of all byte 3-grams of a text between two spaces; A-Z lowered, all other ASCII as spaces."""
    folded = np.full(len(data) + 2, 0x20, dtype=np.uint32)
    folded[1:-1] = _FOLD[data]
    code = folded[:-2] << np.uint32(16) | folded[1:-1] << np.uint32(8) | folded[2:]
    code = code[code != 0x202020]
    return ((code * np.uint32(2654435769)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows with text and lang."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for row, rows, data, ends in text_blocks(batch.column(1)):
                for k in range(rows):
                    lang = langs[row + k]
                    counts = total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    counts += np.bincount(grams(data[ends[k] : ends[k + 1]]), minlength=BUCKETS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = labelled.select("lang", "text").dropna()
    return map_arrow(rows, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages in order, probabilities of shape BUCKETS x languages); at most BUCKETS rows per language reach the driver."""
    rows = gram_counts(labelled).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    place = {lang: i for i, lang in enumerate(langs)}
    np.add.at(table, (rows["bucket"].to_numpy(np.int64), rows["lang"].map(place).to_numpy(np.int64)), rows["n"].to_numpy(float))
    return langs, table / table.sum(axis=0) if langs else table


def _mix(p: np.ndarray, c: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of counts ``c`` under the columns of ``p``."""
    theta = np.full(p.shape[1], 1.0 / p.shape[1])
    if p.shape[1] > 1:
        n = c.sum()
        for _ in range(rounds):
            theta = theta * ((c / (p @ theta)) @ p) / n
    return theta, float(c @ np.log(p @ theta))


def proportions(model: np.ndarray, data: np.ndarray, rounds: int = ROUNDS) -> dict[int, float]:
    """Language numbers of the chosen set with their proportions."""
    counts = np.bincount(grams(data), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    if not len(at):
        return {}
    p, c = model[at], counts[at].astype(float)
    theta, _ = _mix(p, c, rounds)
    order = np.argsort(-theta, kind="stable")
    penalty = 0.5 * np.log(c.sum()) + np.log(max(2, model.shape[1]))
    best, fit = _mix(p[:, order[:1]], c, rounds)
    size = 1
    while size < len(order):
        more, gain = _mix(p[:, order[: size + 1]], c, rounds)
        if gain - fit <= penalty:
            break
        best, fit, size = more, gain, size + 1
    return {int(l): float(t) for l, t in zip(order[:size], best)}


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, lang_pred, score, and lang_mix (language to proportion)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.map_(pa.string(), pa.float64())

    def run(batches):
        table = shared.value
        for batch in batches:
            texts, names, scores, mixes = batch.column(1), [], [], []
            for row, rows, data, ends in text_blocks(texts):
                for k in range(rows):
                    text = texts[row + k].as_py()
                    found = {}
                    if langs and text and _LETTER.search(text):
                        found = proportions(table, data[ends[k] : ends[k + 1]], rounds)
                    top = max(found, key=lambda l: (found[l], -l), default=None)
                    names.append(UNKNOWN if top is None else langs[top])
                    scores.append(0.0 if top is None else min(1.0, max(0.0, found[top])))
                    mixes.append([(langs[l], t) for l, t in found.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, kind)],
                names=["doc_id", "lang_pred", "score", "lang_mix"],
            )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, lang_mix map<string, double>")


def held_out(doc_id):
    """Every fifth document by the CRC of its id as text; a missing id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out and predict all."""
    langs, model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, langs, model).withColumn("held_out", held_out(F.col("doc_id")))
