"""Choosing stored rows without moving them.

Rows with contents are written once, and each gets a number. To choose some of them later,
only their numbers travel: as bitmaps, one of 4 KB for every 32,768 rows, which are sent to
where the rows are stored. The stored table is bucketed by the number of the bitmap, so a
task that writes up to 32,768 rows writes one file, and a join with the bitmaps moves no
row, whatever share of them is chosen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.session import run_dir

# Bits of a bitmap, as Spark's own aggregate makes them.
CHUNK = 32_768
ROW, _CHUNK = "__row", "__chunk"


def store(rows: DataFrame, name: str) -> DataFrame:
    """Writes rows once and reads them back with ``__row``, their number."""
    spark = rows.sparkSession
    numbered = rows.withColumn(ROW, F.monotonically_increasing_id())
    numbered = numbered.withColumn(_CHUNK, F.floor(F.col(ROW) / F.lit(CHUNK)).cast("long"))
    table, path = f"{name.replace('-', '_')}_{uuid.uuid4().hex}", run_dir(spark, name)
    # As many buckets as the shuffles of this session have partitions.
    writer = numbered.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), _CHUNK)
    writer.option("path", path).option("compression", "zstd").saveAsTable(table)
    stored = spark.table(table)
    # Spark knows buckets through its catalog only; the files stay when the entry goes.
    stored.schema  # resolved before
    spark.sql(f"DROP TABLE {table}")
    return stored


def choose(stored: DataFrame, rows: DataFrame, inside: bool = True) -> DataFrame:
    """The stored rows whose number is in ``rows`` (``__row``), or is not; bitmaps are
    the only thing that is shuffled."""
    bit = (F.col(ROW) % CHUNK).cast("int")
    chunk = F.floor(F.col(ROW) / F.lit(CHUNK)).cast("long")
    bitmaps = rows.select(chunk.alias(_CHUNK), bit.cast("long").alias("__bit")).groupBy(_CHUNK)
    bitmaps = bitmaps.agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    # Few and small next to the rows they tell of, so the rows need no sort either.
    joined = stored.join(bitmaps.hint("shuffle_hash"), _CHUNK, "left")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))
    return joined.where(marked if inside else ~marked).drop("__bits")


def without_numbers(rows: DataFrame) -> DataFrame:
    return rows.drop(ROW, _CHUNK)
