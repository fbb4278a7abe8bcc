"""The module table: every per-file feature in one narrow pass over the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.metrics import utf16_length
from corpuscope.functions.paths import module_name
from corpuscope.operators.complexity import complexity_of
from corpuscope.operators.structure import (
    class_names,
    export_names,
    function_names,
    with_structure,
)
from corpuscope.operators.tokens import dependency_structs, is_parseable


def module_table(files: DataFrame) -> DataFrame:
    """``seq, path, name, dependencies, exports, functions, classes, size, complexity``.

    One scan, no shuffle, no join: each file is lexed once and every feature is
    read off its own arrays. A file that cannot hold code gets the empty form.
    """
    parsed = with_structure(files).withColumn("deps", dependency_structs("toks"))
    return parsed.select(
        "seq",
        "path",
        module_name(F.col("path")).alias("name"),
        F.array_distinct(F.transform("deps", lambda d: d.specifier)).alias("dependencies"),
        export_names("nodes").alias("exports"),
        function_names("nodes").alias("functions"),
        class_names("nodes").alias("classes"),
        F.when(is_parseable(), F.coalesce(utf16_length(F.col("content")), F.lit(0)))
        .otherwise(0)
        .cast("bigint")
        .alias("size"),
        complexity_of("nodes").alias("complexity"),
    )


def with_walk_order(df: DataFrame) -> DataFrame:
    """Add ``seq``, increasing with ``path``, to rows that carry no walk order.

    A range-partitioned sort and per-partition ids: no single task sees all rows.
    Apply it to module rows rather than to file contents.
    """
    return df.orderBy("path").withColumn("seq", F.monotonically_increasing_id())
