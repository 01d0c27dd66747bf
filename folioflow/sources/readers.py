"""Sources: frame images, job documents, file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow import schemas as S


def read_frames(spark: SparkSession, path: str, *, pattern: str = r"frame_(\d+)", source: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """(source_id, name_index, width, height, channels, px BINARY) of every readable image below ``path``.

    The order of a frame is the number in its name; files that cannot be read are
    skipped. Pixels are BGR bytes. The source is the parent folder.
    """
    rows = (
        spark.read.format("image")
        .option("dropInvalid", "false")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("image.*")
        .filter("height > 0")
    )
    return rows.select(
        F.regexp_extract("origin", source, 1).alias("source_id"),
        F.regexp_extract("origin", pattern, 1).cast("int").alias("name_index"),
        "width",
        "height",
        F.col("nChannels").alias("channels"),
        F.col("data").alias("px"),
    )


def _text(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))


def read_jobs(spark: SparkSession, path: str, *, multi_line: bool = True, now: Column | None = None) -> DataFrame:
    """Job documents with defaults for what is missing.

    A document that cannot be read, or whose status or numbers are invalid, becomes
    an error job named after its folder. ``multi_line`` reads one document per
    file; otherwise one per line.
    """
    now = F.current_timestamp().cast("double") if now is None else now
    schema = S.JOB + ", _corrupt STRING"
    raw = (
        spark.read.schema(schema)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
        .select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("_folder"))
    )
    status = _text("status", "queued")
    numbers = {c: F.col(c).try_cast("double") for c in ("progress", "created_at", "updated_at")}
    broken = F.col("_corrupt").isNotNull() | ~status.isin(*S.JOB_STATUS)
    for name, value in numbers.items():
        broken = broken | (_text(name, "0").isNotNull() & F.nullif(F.col(name), F.lit("")).isNotNull() & value.isNull())
    rows = raw.withColumn("_broken", broken)

    def pick(value: Column, spoiled) -> Column:
        spoiled = spoiled if isinstance(spoiled, Column) else F.lit(spoiled)
        return F.when(F.col("_broken"), spoiled).otherwise(value)

    empty_log = F.array().cast("array<string>")
    stamp = lambda c: F.coalesce(F.when(numbers[c] != 0, numbers[c]), now)
    corrupt = "job metadata was corrupt after restart"
    return rows.select(
        pick(F.coalesce("id", F.lit("")), F.col("_folder")).alias("id"),
        pick(_text("source_type", "file"), "file").alias("source_type"),
        pick(F.col("file_path"), None).alias("file_path"),
        pick(F.col("youtube_url"), None).alias("youtube_url"),
        pick(_text("options", "{}"), "{}").alias("options"),
        pick(F.coalesce("artifact_dir", F.lit("")), F.col("_folder")).alias("artifact_dir"),
        pick(status, "error").alias("status"),
        pick(F.coalesce(numbers["progress"], F.lit(0.0)), 0.0).alias("progress"),
        pick(_text("current_step", "queued"), "failed").alias("current_step"),
        pick(F.coalesce("message", F.lit("")), corrupt + "; rerun the capture").alias("message"),
        pick(_text("result", "{}"), "{}").alias("result"),
        pick(F.nullif(F.col("error_code"), F.lit("")), "RECOVERED_CORRUPT_METADATA").alias("error_code"),
        pick(F.coalesce("log", empty_log), F.array(F.lit(corrupt))).alias("log"),
        pick(stamp("created_at"), now).alias("created_at"),
        pick(stamp("updated_at"), now).alias("updated_at"),
    )


def list_assets(spark: SparkSession, path: str) -> DataFrame:
    """(path, child, extension, length, modificationTime) of every file below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return describe_assets(files.select("path", "modificationTime", "length"), path)


def describe_assets(files: DataFrame, root: str, *, path: str = "path") -> DataFrame:
    """Add the top-level child below ``root`` and the lower-case extension."""
    plain = F.regexp_replace(F.col(path), r"^[a-z0-9]+:/+", "/")
    inner = F.substr(plain, F.lit(len("/" + root.strip("/")) + 2))
    return files.withColumns(
        {"child": F.substring_index(inner, "/", 1), "extension": F.lower(F.regexp_extract(path, r"[^/.]\.([^./]+)$", 1))}
    )
