"""Sinks: export manifests and job tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import normalize_formats
from folioflow.session import stage


def export_manifest(
    pages: DataFrame, runs: DataFrame, key: Sequence[str], *, raw: DataFrame | None = None, review: bool = False
) -> DataFrame:
    """(key, role, format, item_index, name) of everything an export writes.

    ``pages`` (key, page_index from 0); ``runs`` (key, formats, used_frames, include_raw) one row per
    run; ``raw`` (key, frame_index) the source frames copied when asked for. A ``review`` writes no
    complete sheet; its previews are the png pages, or files of their own when png is not wanted.
    """
    key = list(key)
    plan = runs.withColumn("formats", normalize_formats(F.col("formats")))
    each = pages.join(plan.select(*key, F.explode("formats").alias("format")), key)
    number = F.col("page_index") + 1
    images = each.filter("format != 'pdf'").select(
        *key,
        F.lit("images").alias("role"),
        "format",
        number.cast("int").alias("item_index"),
        F.concat(F.format_string("page_%04d.", number), F.col("format")).alias("name"),
    )
    some = pages.select(*key).distinct()
    whole = (
        plan.join(some, key, "left_semi")
        .filter(F.array_contains("formats", "png") & (F.col("used_frames") >= 2))
        .select(*key, F.lit("full_sheet").alias("role"), F.lit("png").alias("format"), F.lit(0).alias("item_index"), F.lit("sheet_complete.png").alias("name"))
    )
    book = (
        plan.join(some, key, "left_semi")
        .filter(F.array_contains("formats", "pdf"))
        .select(*key, F.lit("pdf").alias("role"), F.lit("pdf").alias("format"), F.lit(0).alias("item_index"), F.lit("sheet_export.pdf").alias("name"))
    )
    out = images.unionByName(book)
    if review:
        own = ~F.array_contains("formats", "png")
        shown = pages.join(plan.select(*key, own.alias("_own")), key)
        out = out.unionByName(
            shown.select(
                *key,
                F.lit("preview_images").alias("role"),
                F.lit("png").alias("format"),
                number.cast("int").alias("item_index"),
                F.when(F.col("_own"), F.format_string("preview_%04d.png", number)).otherwise(F.format_string("page_%04d.png", number)).alias("name"),
            )
        )
    else:
        out = out.unionByName(whole)
    if raw is not None:
        copies = raw.join(plan.filter("include_raw").select(*key), key, "left_semi")
        out = out.unionByName(
            copies.select(
                *key,
                F.lit("raw_frames").alias("role"),
                F.lit("png").alias("format"),
                F.col("frame_index").cast("int").alias("item_index"),
                F.format_string("raw_%05d.png", F.col("frame_index")).alias("name"),
            )
        )
    return out


def nothing_to_export(runs: DataFrame, manifest: DataFrame, key: Sequence[str]) -> DataFrame:
    """Runs that would write nothing: each is an error."""
    return runs.select(*key).join(manifest.select(*key).distinct(), list(key), "left_anti").withColumn(
        "error", F.lit("no pages available for export")
    )


def write_pages(manifest: DataFrame, path: str) -> None:
    """Write the manifest, one folder per format."""
    manifest.write.mode("overwrite").partitionBy("format").parquet(path)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, None before its first write."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:
        return None
    return found if found.columns else None


def write_jobs(
    jobs: DataFrame, path: str, *, key: str = "job_id", buckets: int = 16, files: int = 1, batch_id: int | None = None, order: Sequence[str] = ()
) -> None:
    """Put jobs into the job table: their own rows are replaced, all others of the table stay.

    The table is kept by bucket of the key. The buckets that ``jobs`` touch are read (others are pruned), merged and
    written again, each as ``files`` files; rows appear with the commit of the write, so a reader never sees half a
    record. Of several rows of a key the one with the greatest ``order`` counts. With ``batch_id`` rows
    carry the batch they came with, and a job that a later batch has written already stays as it
    is: a batch that is replayed, now or later, changes nothing. One writer at a time.
    """
    spark = jobs.sparkSession
    newest = F.max_by(F.struct(*jobs.columns), F.struct(*order) if order else F.struct(key)).alias("_row")
    fresh = jobs.groupBy(F.col(key).alias("_key")).agg(newest).select("_row.*")
    if batch_id is not None:
        fresh = fresh.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    fresh = stage(fresh.withColumn("bucket", bucket_of(F.col(key), buckets)))
    held = _table(spark, path)
    merged = fresh
    if held is not None:
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        held = held.filter(F.col("bucket").isin(touched))
        stamp = F.coalesce(F.col("batch_id"), F.lit(-1)) if "batch_id" in held.columns else F.lit(-1)
        kept = held.filter(stamp > F.lit(batch_id)) if batch_id is not None else held.limit(0)
        fresh = fresh.join(kept.select(key), key, "left_anti")
        # Staged before the write: the files that are read are the ones that are replaced.
        merged = stage(held.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True))
    dealt = merged.repartition("bucket", F.pmod(F.xxhash64(key), F.lit(buckets * files)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_batches(path: str, *, key: str = "job_id", buckets: int = 16, files: int = 1, order: Sequence[str] = ()):
    """A foreachBatch sink that puts every micro-batch into the job table; replayed batches change nothing."""

    def write(batch: DataFrame, number: int) -> None:
        write_jobs(batch, path, key=key, buckets=buckets, files=files, batch_id=number, order=order)

    return write


def bucket_of(key: Column, buckets: int = 16) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
