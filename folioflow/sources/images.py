"""Image files written by Spark tasks, and visible only once the write commits.

``write_files`` is a sink of Spark's Python data source API. Every task attempt writes below a
folder of its own whose name starts with an underscore, which Spark's readers pass over; the commit renames the folders of
the attempts that count, one rename per task. Repeated or lost attempts leave nothing that a reader sees. Paths
are opened by their scheme (local, hdfs, s3, gs, abfs) through Arrow's file systems.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from folioflow import kernels as K
from folioflow.arrow import map_rows
from folioflow.ship import by_value

FORMAT = "folioflow_files"


def open_path(path: str):
    """(file system, path inside it) of a path or URI."""
    from pyarrow import fs

    scheme, found, rest = path.partition(":")
    if not found or scheme == "file" or len(scheme) == 1:
        plain = rest if scheme == "file" else path
        return fs.LocalFileSystem(), "/" + plain.lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> Attempt:
        system, root = open_path(self.path)
        folder, made, files = uuid.uuid4().hex, set(), 0
        for row in rows:
            target = f"{root}/_attempt-{folder}/{row['path'].lstrip('/')}"
            parent = target.rpartition("/")[0]
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            with system.open_output_stream(target) as out:
                out.write(bytes(row["content"]))
            files += 1
        return Attempt(folder, files)

    def commit(self, messages) -> None:
        system, root = open_path(self.path)
        for message in messages:
            if message is not None and message.files:
                system.move(f"{root}/_attempt-{message.folder}", f"{root}/part-{message.folder}")

    def abort(self, messages) -> None:
        system, root = open_path(self.path)
        for message in messages:
            if message is not None and message.files:
                system.delete_dir(f"{root}/_attempt-{message.folder}")


class Files(DataSource):
    """Rows (path, content) as files below ``path``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"])


def write_files(rows: DataFrame, path: str) -> None:
    """Write (path, content) as files below ``path``/part-*/; rows without content are passed over."""
    with by_value():
        rows.sparkSession.dataSource.register(Files)
        rows.select("path", "content").filter("content is not null").write.format(FORMAT).option("path", path).mode("append").save()


def png(gray: np.ndarray) -> bytes:
    """An 8-bit gray PNG file."""

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    height, width = gray.shape
    lines = np.concatenate([np.zeros((height, 1), dtype=np.uint8), gray], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def png_frames(frames: DataFrame) -> DataFrame:
    """Add ``content``: the frame as a PNG file, null where it cannot be read. Narrow."""

    def encode(px, width, height):
        image = K.image(px, width, height)
        return (None if image is None else png(image),)

    return map_rows(frames, ["px", "width", "height"], encode, [("content", "binary")])


def write_frames(frames: DataFrame, path: str, key: Sequence[str], name: Column) -> None:
    """One PNG per frame, below a folder per key."""
    folder = F.concat_ws("/", *[F.col(k).cast("string") for k in key], name)
    write_files(png_frames(frames).withColumn("path", folder), path)
