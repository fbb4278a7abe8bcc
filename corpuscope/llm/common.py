"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.session import run_dir, ship_package

# What counts as white space between words: space and the five ASCII controls.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str) -> Column:
    """Unsigned crc32 of an id written as decimal text (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(column: str, folds: int) -> Column:
    """True for ids whose crc32 leaves remainder 1; false for others and null ids."""
    return F.coalesce(F.pmod(id_crc(column), F.lit(folds)) == 1, F.lit(False))


def fold_blocks(rows: Column, per_block: int) -> Column:
    """How many blocks of about ``per_block`` rows a group of ``rows`` is cut into."""
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(per_block))).cast("long")


def hash_block(hash64: Column, blocks: Column) -> Column:
    """Block of a row: the range of its 64-bit hash, so that blocks keep hash order."""
    # The top 31 bits, made non-negative, times the number of blocks stays below 2^63.
    top = F.shiftrightunsigned(hash64.bitwiseXOR(F.lit(-(2**63))), 33)
    return F.shiftright(top * blocks, 31)


def bucketed(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Writes wide rows once, bucketed by ``key``, and reads them back.

    Joins of thin tables on that key then come to the rows; the rows are not shuffled.
    Each task writes a file for each bucket, so small splits are put together: as many
    tasks as there are cores, or an eighth of the buckets.
    """
    spark = rows.sparkSession
    table_name = f"{name}_{uuid.uuid4().hex}"
    # As many buckets as the shuffles of this session have partitions.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.coalesce(max(spark.sparkContext.defaultParallelism, buckets // 8)).write.bucketBy(buckets, key)
    path = run_dir(spark, name)
    writer.option("path", path).option("compression", "zstd").saveAsTable(table_name)
    stored = spark.table(table_name)
    # Spark knows buckets through its catalog only; the files stay when the entry goes.
    spark.sql(f"DROP TABLE {table_name}")
    return stored
