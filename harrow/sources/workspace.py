"""Files of a directory tree, hidden names included, listed and read by tasks.

Spark's own file source passes over names that begin with '.' or '_', which code has
plenty of; this one lists them, and keeps modification times in nanoseconds.

The tree is walked level by level: the folders of a level are a table, tasks list them,
and the folders they find are the next level.  The driver sees how many there are, never
a name.  Files are then dealt out by number, so a folder with most of all files is read
by as many tasks as the rest.  Executors reach the tree by the same path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.plans.scratch import stage
from harrow.plans.ship import ship

OWN_FOLDER = ".harrow"
#: Files of this many bytes at most are read; larger ones are listed without content.
READ_BYTES = 1 << 20
#: Folders that a task lists, and files that a task reads, on average.
TASK_FOLDERS, TASK_FILES = 64, 512

_LISTED = "name binary, folder boolean, size long, mtime_ns long"
#: Rows of a listing that are passed on together.
_ROWS = 4_096


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["name", "folder", "size", "mtime_ns"])


def _list(root: bytes):
    """What stands right inside each folder; names are bytes below the root, as the file system has them."""

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("name").to_pylist():
                rows: list[tuple] = []
                try:
                    with os.scandir(os.path.join(root, folder)) as entries:
                        for entry in entries:
                            name = os.path.join(folder, entry.name)
                            if entry.is_dir(follow_symlinks=False):
                                if name != OWN_FOLDER.encode():
                                    rows.append((name, True, None, None))
                            elif entry.is_file():
                                stat = entry.stat()
                                rows.append((name, False, stat.st_size, stat.st_mtime_ns))
                            if len(rows) == _ROWS:
                                yield _batch(rows)
                                rows = []
                except (FileNotFoundError, PermissionError, NotADirectoryError):
                    pass  # gone since it was listed, or closed to us
                if rows:
                    yield _batch(rows)

    return listing


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(name, size, mtime_ns) of all regular files below ``root``, but for the engine's own folder.

    Links to folders are not followed; links to files are files.
    """
    ship(spark)
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no folder {root}")
    level = spark.createDataFrame([(b"",)], "name binary")
    found, width = [], 1
    while width:
        tasks = max(1, -(-width // TASK_FOLDERS))
        listed = stage(level.repartition(tasks).mapInArrow(_list(os.fsencode(root)), _LISTED), "listed")
        found.append(listed.filter("NOT folder").select("name", "size", "mtime_ns"))
        level = listed.filter("folder").select("name")
        width = level.count()
    return reduce(DataFrame.unionByName, found)


def _read(root: bytes, most: int):
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime_ns", pa.int64()), ("content", pa.binary())])

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                content = None
                if row["size"] <= most:
                    try:
                        with open(os.path.join(root, row["name"]), "rb") as f:
                            content = f.read()
                    except (FileNotFoundError, PermissionError):
                        continue
                path = row["name"].decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((path, row["size"], row["mtime_ns"], content), schema.types, strict=True)], schema=schema)

    return reading


def read_files(files: DataFrame, root: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """(path, size, mtime_ns, content) of walked files, dealt evenly; content is null above ``read_bytes``."""
    tasks = max(1, -(-files.count() // TASK_FILES))
    return files.repartition(tasks).mapInArrow(_read(os.fsencode(os.path.realpath(root)), read_bytes), "path string, size long, mtime_ns long, content binary")


def scan(spark: SparkSession, root: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """Files with text (invalid UTF-8 replaced) and the hash of their bytes."""
    files = read_files(walk(spark, os.path.realpath(root)), root, read_bytes)
    return files.select("path", "size", "mtime_ns", F.sha2("content", 256).alias("content_hash"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
