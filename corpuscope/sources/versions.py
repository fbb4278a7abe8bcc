"""Tables that are replaced as a whole, or not at all.

A table is a folder of data folders and of numbered commits. A commit is a small file
that names the data folders which make up the table from then on; it is written aside and
renamed into place, which fails if the number is taken. So a reader sees one commit or the
next, never a half-written one; a writer that fails leaves the table as it was; and of two
writers at once one notices, and bases its work on the other's.

Files go through Hadoop's file systems, so any that Spark reaches will do. On a file
system whose rename is not atomic (an object store), writers must take turns.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_COMMITS = "_commits"


class Taken(Exception):
    """Another writer has committed this number."""


def _paths(spark: SparkSession, folder: str):
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{_COMMITS}")
    return jvm, root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """The last commit's number and what it says; 0 and nothing before the first."""
    jvm, root, files = _paths(spark, folder)
    if not files.exists(root):
        return 0, {}
    names = [s.getPath().getName() for s in files.listStatus(root)]
    numbers = [int(n) for n in names if n.isdigit()]
    if not numbers:
        return 0, {}
    stream = files.open(jvm.org.apache.hadoop.fs.Path(root, f"{max(numbers):012d}"))
    try:
        return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, number: int, what: dict) -> None:
    """Publishes ``what`` as commit ``number``; raises :class:`Taken` if there is one."""
    jvm, root, files = _paths(spark, folder)
    files.mkdirs(root)
    aside = jvm.org.apache.hadoop.fs.Path(root, f"_{uuid.uuid4().hex}")
    stream = files.create(aside, False)
    stream.write(json.dumps(what).encode())
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(aside, jvm.org.apache.hadoop.fs.Path(root, f"{number:012d}"), options)
    except Exception as error:
        files.delete(aside, False)
        if "FileAlreadyExists" in str(error):
            raise Taken(f"commit {number} of {folder} is taken") from None
        raise


def new_folder() -> str:
    """A data folder's name, not yet created."""
    return f"data-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str, name: str) -> None:
    """Removes a data folder that no commit in use names any more."""
    _, root, files = _paths(spark, folder)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(root.getParent(), name), True)


def read_folders(spark: SparkSession, folder: str, names: list[str], schema: T.StructType | str) -> DataFrame:
    """The rows of some data folders of a table."""
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder.rstrip('/')}/{n}" for n in names])
