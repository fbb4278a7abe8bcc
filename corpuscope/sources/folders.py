"""Listing and reading folders as rows, in tasks.

A folder is a row; one level of folders is listed by one job, its rows dealt over the
tasks, and gives the next level and the files found. So the driver sees counts only, a
tree of millions of folders is listed by the cluster, and files are dealt out by what
they hold before any is opened. Names count whatever they begin with, which Spark's own
file index does not do; links are not followed.

Folders are named by a path that every executor sees (a shared mount), or by a URI that
``pyarrow.fs`` opens. Files are read by the task that has their row.
"""

from __future__ import annotations

import glob
import os
import sys
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.session import materialize

# Bytes of files that one task should read.
TASK_BYTES = 64 << 20
# Contents that go to Spark in one batch. A file of 2 GB or more is no Spark value.
BATCH_BYTES = 8 << 20
MAX_FILE = (1 << 31) - 1
_NAMES = ["path", "is_dir", "ext", "size"]
_KINDS = [pa.string(), pa.bool_(), pa.string(), pa.int64()]
_ENTRY = "path string, is_dir boolean, ext string, size long"


def local_path(path: str) -> str | None:
    """The path of a plain or ``file:`` name, else None."""
    parts = urlsplit(path)
    if parts.scheme == "file" and parts.netloc in ("", "localhost"):
        return parts.path
    return path if parts.scheme == "" or len(parts.scheme) == 1 else None


def can_list(path: str) -> bool:
    """Whether a root is a path, or a URI that ``pyarrow.fs`` can open here."""
    if local_path(path) is not None:
        return True
    try:
        pafs.FileSystem.from_uri(path)
        return True
    except (pa.ArrowInvalid, OSError):
        return False


def extension_of(name: str) -> str:
    """Lower-cased extension of a file name; empty without one, or before the only dot."""
    stem, dot, ext = name.rpartition(".")
    return ext.lower() if dot and stem else ""


def entries(folder: str) -> Iterator[tuple[str, bool, int]]:
    """(path, is_dir, size) of what a folder holds; nothing if it cannot be read."""
    local = local_path(folder)
    if local is not None:
        try:
            with os.scandir(local) as found:
                for entry in found:
                    if entry.is_dir(follow_symlinks=False):
                        yield entry.path, True, 0
                    elif entry.is_file(follow_symlinks=False):
                        yield entry.path, False, _size(entry)
        except OSError:
            return
        return
    system, base = pafs.FileSystem.from_uri(folder)
    prefix = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
    try:
        found = system.get_file_info(pafs.FileSelector(base, recursive=False))
    except OSError:
        return
    for info in found:
        if info.type in (pafs.FileType.Directory, pafs.FileType.File):
            yield prefix + info.path, info.type == pafs.FileType.Directory, info.size or 0


def _size(entry: os.DirEntry) -> int:
    try:
        return entry.stat(follow_symlinks=False).st_size
    except OSError:
        return 0


def content_of(path: str) -> bytes | None:
    """A file's bytes; None if it cannot be read, or is too large for one value."""
    local = local_path(path)
    try:
        if local is not None:
            with open(local, "rb") as file:
                data = file.read(MAX_FILE)
        else:
            system, base = pafs.FileSystem.from_uri(path)
            with system.open_input_stream(base) as file:
                data = file.read(MAX_FILE)
        return data if len(data) < MAX_FILE else None
    except OSError:
        return None


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], _NAMES)

    rows: list[tuple] = []
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            for path, is_dir, size in entries(folder):
                rows.append((path, is_dir, "" if is_dir else extension_of(path.rsplit("/", 1)[-1]), size))
                if len(rows) >= 10_000:
                    yield made(rows)
                    rows = []
    if rows:
        yield made(rows)


def _roots(roots: Sequence[str]) -> list[str]:
    """The folders meant: patterns resolved, hidden names included."""
    out = []
    for root in roots:
        local = local_path(root)
        if local is None:
            out.append(root.rstrip("/"))
        elif os.path.lexists(local) or not glob.has_magic(local):
            out.append(os.path.abspath(local))
        else:
            # A pattern may lead through links: what they point to counts once.
            out += sorted(os.path.realpath(p) for p in glob.glob(local, include_hidden=True))
    return list(dict.fromkeys(out))


def list_files(spark: SparkSession, roots: Sequence[str], exts: Sequence[str]) -> DataFrame:
    """``path, ext, size`` of every file below the roots that has one of the extensions.

    A root that is a file is listed itself; folders that several roots reach count once.
    """
    named = _roots(roots)
    level = spark.createDataFrame([(r,) for r in named], "path string")
    single = [r for r in named if local_path(r) is not None and os.path.isfile(r)]
    sized = [(r, extension_of(os.path.basename(r)), os.path.getsize(r)) for r in single]
    found = spark.createDataFrame(sized, "path string, ext string, size long").where(F.col("ext").isin(*exts))
    while True:
        # Dealt by name, so that the folders of one parent are listed by many tasks.
        listed = level.repartition("path").mapInArrow(_listed, _ENTRY)
        listed = materialize(listed.where(F.col("is_dir") | F.col("ext").isin(*exts)), "folder-level")
        found = found.unionByName(listed.where(~F.col("is_dir")).select("path", "ext", "size"))
        level = listed.where("is_dir").select("path")
        if level.isEmpty():
            break
    return found.distinct() if len(named) > 1 else found


def with_content(files: DataFrame) -> DataFrame:
    """Adds ``content`` (binary), null for a file that cannot be read, to rows with
    ``path`` and ``size``; rows are dealt so that a task reads about 64 MB."""
    spark = files.sparkSession
    counted = files.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).head()
    cores = spark.sparkContext.defaultParallelism
    tasks = max(1, min(counted.n, cores), -(-(counted.bytes or 0) // TASK_BYTES))
    kept = files.drop("size")
    at = kept.columns.index("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, size, contents = 0, 0, []
            for i, path in enumerate(batch.column(at).to_pylist()):
                data = content_of(path)
                if contents and size + len(data or b"") > BATCH_BYTES:
                    yield _joined(batch.slice(low, i - low), contents)
                    low, size, contents = i, 0, []
                contents.append(data)
                size += len(data or b"")
            if contents:
                yield _joined(batch.slice(low), contents)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.repartition(tasks, "path").mapInArrow(read, f"{schema}, content binary")


def _joined(batch: pa.RecordBatch, contents: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(contents, pa.binary())], [*batch.schema.names, "content"])


# Send the helpers with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
