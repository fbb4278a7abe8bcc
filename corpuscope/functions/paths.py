"""Column functions over file paths and specifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CODE_SUFFIX = r"\.(js|ts|jsx|tsx)$"


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Everything before the last slash, empty when there is none."""
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def strip_code_suffix(name: Column) -> Column:
    return F.regexp_replace(name, _CODE_SUFFIX, "")


def extension(path: Column) -> Column:
    """Lower-cased extension of the last segment; empty without one."""
    return F.lower(F.regexp_extract(last_segment(path), r"^.+\.([^.]*)$", 1))


def module_name(path: Column) -> Column:
    """File name without a code suffix; ``unknown`` when nothing is left."""
    name = strip_code_suffix(last_segment(path))
    return F.when(name == "", "unknown").otherwise(name)


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root`` with forward slashes; other paths stay as they are."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(slashed.startswith(prefix), F.substring(slashed, len(prefix) + 1, 2**31 - 1)).otherwise(slashed)


def node_key(path: Column) -> Column:
    """Diagram id of a path; different paths may share one."""
    return F.concat(F.lit("node_"), F.regexp_replace(path, "[^a-zA-Z0-9]", "_"))


def with_rel_path(df: DataFrame, root: str) -> DataFrame:
    return df.withColumn("rel", relative_path(F.col("path"), root))


def with_module_name(df: DataFrame) -> DataFrame:
    return df.withColumn("name", module_name(F.col("path")))


def within_size_limit(df: DataFrame, n: int = 1_024_000) -> DataFrame:
    """Files of at most ``n`` characters. Opt-in: no operator applies it."""
    return df.where(F.length("content") <= n)
