"""Code folders as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.paths import extension
from corpuscope.operators.modules import with_walk_order
from corpuscope.rules import CODE_EXTENSIONS
from corpuscope.sources.folders import can_list, list_files, with_content


def utf8_text(content: Column) -> Column:
    """Bytes to text; bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def read_text(df: DataFrame) -> DataFrame:
    """Turn a binary ``content`` column into text."""
    return df.withColumn("content", utf8_text(F.col("content")))


def scan_code_files(
    spark: SparkSession,
    root: str | Iterable[str],
    exts: Iterable[str] = CODE_EXTENSIONS,
    walk_order: bool = False,
) -> DataFrame:
    """``seq, path, ext, content`` for every file below ``root`` with one of ``exts``.

    Hidden names and names with ``_`` in front count like any others; links are not
    followed; other files are never opened. A file that cannot be read is a row with
    null content. A root may be a glob.

    ``seq`` follows the path if ``walk_order`` is set, else it is null. The sort moves
    the listing only: contents are read afterwards.

    A root of a file system that ``pyarrow.fs`` does not know is read by Spark's own
    reader, which passes over names that start with ``_`` or ``.`` and skips files that
    it cannot read.
    """
    roots, exts = [root] if isinstance(root, str) else list(root), [e.lower() for e in exts]
    if not all(map(can_list, roots)):
        return _by_file_index(spark, roots, exts, walk_order)
    listed = list_files(spark, roots, exts)
    listed = with_walk_order(listed) if walk_order else listed.withColumn("seq", F.lit(None).cast("bigint"))
    return read_text(with_content(listed)).select("seq", "path", "ext", "content")


def _by_file_index(spark: SparkSession, roots: list[str], exts: list[str], walk_order: bool) -> DataFrame:
    # Case-blind, and applied to names while listing.
    names = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in exts)
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{{{names}}}")
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .load(roots)
    )
    files = found.where(extension(F.col("path")).isin(*exts)).select(
        "path", extension(F.col("path")).alias("ext"), utf8_text(F.col("content")).alias("content")
    )
    files = with_walk_order(files) if walk_order else files.withColumn("seq", F.lit(None).cast("bigint"))
    return files.select("seq", "path", "ext", "content")
