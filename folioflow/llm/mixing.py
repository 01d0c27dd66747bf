"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the words of its source up
to and including this copy, in a shuffled order, divided by the source's target
weight. All copies are range-sorted by finish time and cut at the total budget.

Defined cases: a null text has size 0; rows equal in id, source and text form one
unit and are taken together; a null source is a source of its own, last in order;
ties of finish time are ordered by the shuffle hash; sources without words have
target 0; an empty table gives no rows. Other columns, whatever their names, are
passed through untouched.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.common import fresh, n_words, staged
from folioflow.llm.spread import ranked, running_sorted

MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)


def source_targets(sizes: DataFrame, budget_share: float = 1.0, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: its size and its target number of words.

    ``sizes``: source, source_size, one row per source. Weights repeat along the
    sources in code point order, null last. A target ends at ``max_repeats`` times
    the source's size and the rest is shared again by weight: the level that all
    uncapped sources reach is found by ordering sources by (cap / weight).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    all_rows = Window.partitionBy()
    rows = sizes.withColumn("_w", F.element_at(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1))
    rows = rows.withColumns(
        {
            "_cap": (F.col("source_size") * max_repeats).cast("double"),
            "_budget": F.sum("source_size").over(all_rows) * F.lit(budget_share),
            "_wsum": F.sum("_w").over(all_rows),
        }
    ).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    ahead = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_i", F.row_number().over(by_ratio)).withColumn(
        "_level",
        (F.col("_budget") - F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0)))
        / (F.col("_wsum") - F.coalesce(F.sum("_w").over(ahead), F.lit(0.0))),
    )
    # The first source whose cap is not reached gives the common level.
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_i", "_level"))).over(all_rows)["_level"]
    target = F.least(F.col("_cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("_w"))
    return rows.select("source", "source_size", target.alias("target"))


def unit_key(seed: int) -> tuple[Column, Column]:
    """Two 64-bit hashes over id, source and text; null differs from empty."""
    text = F.coalesce("text", F.lit(""))
    nulls = [F.col(c).isNull().cast("int") for c in ("doc_id", "source", "text")]
    return F.xxhash64("doc_id", "source", text, *nulls), F.xxhash64(text, *nulls, "source", "doc_id", F.lit(seed))


def mix_plan(docs: DataFrame, budget_share: float = 1.0, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(slim rows, units): units carry how many copies of each of their rows the mix takes.

    Both have k1, k2 (128 bits over id, source and text), which join one unit to its rows.
    """
    k1, k2 = unit_key(seed)
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), k1.alias("k1"), k2.alias("k2"))
    slim = staged(slim, "mix-rows")
    units = slim.groupBy("k1", "k2", "source").agg(F.sum("size").alias("unit_size"))
    units = staged(units, "mix-units")
    targets = source_targets(units.groupBy("source").agg(F.sum("unit_size").alias("source_size")), budget_share, weights, max_repeats)
    targets = staged(targets, "mix-targets").withColumnRenamed("source", "_source")
    n = units.count()
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    queue = ranked(units, "source", "k2", ["k1"], "unit_size", n)
    queue = queue.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        "k1", "k2", "unit_size", "source_size", "target", (F.col("before") + F.col("unit_size")).alias("up_to")
    )
    queue = staged(queue, "mix-queue")

    def finish(turn):
        return (turn * F.col("source_size") + F.col("up_to")) / F.col("target")

    copies = queue.filter("target > 0 and unit_size > 0").select(
        "k1", "k2", "unit_size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), finish)).alias("finish")
    )
    order = [F.col("finish"), F.col("k2"), F.col("k1")]
    lined = running_sorted(copies, order, "unit_size", n * max_repeats, partial(staged, name="mix-sorted"))
    last = lined.filter(F.col("cum") <= F.lit(budget * budget_share)).agg(F.max(F.struct("finish", "k2", "k1")).alias("last")).first()["last"]
    if last is None:
        taken = F.lit(0)
    else:
        cut = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["k2"]).alias("k2"), F.lit(last["k1"]).alias("k1"))
        here = lambda turn: F.struct(finish(turn).alias("finish"), F.col("k2"), F.col("k1"))
        counted = sum((F.when(here(F.lit(t)) <= cut, 1).otherwise(0) for t in range(max_repeats)), F.lit(0))
        taken = F.when((F.col("target") > 0) & (F.col("unit_size") > 0), counted).otherwise(0)
    return slim, queue.select("k1", "k2", "source_size", "target", taken.cast("int").alias("copies"))


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    slim, units = mix_plan(docs, **options)
    return slim.join(units, ["k1", "k2"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the documents' own columns, each row as often as the mix takes it."""
    _, units = mix_plan(docs, **options)
    k1, k2, copies, turn = fresh(docs.columns, "_k1", "_k2", "_copies", "_turn")
    first, second = unit_key(options.get("seed", 17))
    keyed = docs.withColumn(k1, first).withColumn(k2, second)
    units = units.filter("copies > 0").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("copies").alias(copies))
    out = keyed.join(units, [k1, k2])
    return out.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
