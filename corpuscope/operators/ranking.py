"""Top-n helpers that never gather a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.session import materialize

# Fan-out of the first ranking step: a task of the second one gets SALTS * n rows.
SALTS = 64
# Parts that a key's range is cut into per round of a selection, and the rows of the part
# with the cut from which on another round is worth a look at the data.
BINS = 4096
EDGE_ROWS = 50_000
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_n_by(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str | None = None,
) -> DataFrame:
    """The first ``n`` rows per key under ``order``, in two ranking steps.

    Step one ranks inside (key, salt), step two ranks the survivors inside key. The salt
    is drawn from the partition, so a map task has one salt, and Spark's group limit cuts
    it to n rows per key before anything is shuffled; a key that holds most of the rows is
    cut down by many tasks before it meets in one.

    Spark cuts groups map-side up to ``spark.sql.optimizer.windowGroupLimitThreshold``
    rows (1000 unless raised); for larger ``n`` of a whole number see :func:`greatest_n`.
    """
    salted = df.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    kept = salted.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= n)
    kept = kept.drop("__salt", "__rank")
    if not keys:
        top = kept.orderBy(*order).limit(n)
        if rank is None:
            return top
        return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    final = Window.partitionBy(*keys).orderBy(*order)
    ranked = kept.withColumn(rank or "__rank", F.row_number().over(final))
    ranked = ranked.where(F.col(rank or "__rank") <= n)
    return ranked if rank else ranked.drop("__rank")


def _cuts(thin: DataFrame, n: int, edge_rows: int) -> DataFrame:
    """``__key, low, high, need`` for every key with more than ``n`` values in ``thin``
    (``__key, v``): all values above ``high`` are among the n greatest, and ``need`` of
    those from ``low`` to ``high``.

    Each round counts the values in the bins of a range, one row per key and bin, and
    goes on inside the bin that holds the n-th one.
    """
    spans = thin.groupBy("__key").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    live = materialize(spans.where(F.col("n") > n).select("__key", "low", "high", F.lit(n).cast("long").alias("need")), "cuts")
    done = None
    while not live.isEmpty():
        # Dividing the ends before subtracting cannot overflow.
        width = F.expr(f"high div {BINS} - low div {BINS} + 1").alias("width")
        ranges = live.select(F.col("__key").alias("__k"), F.col("low"), F.col("high"), "need", width)
        inside = thin.join(ranges, F.col("__key").eqNullSafe(F.col("__k"))).where(F.col("v").between(F.col("low"), F.col("high")))
        bins = inside.groupBy("__key", F.expr("v div width").alias("bin")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("need").alias("need")
        )
        # About BINS rows of a key meet here, whatever the number of its values.
        down = Window.partitionBy("__key").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        reached = bins.withColumn("upto", F.sum("n").over(down)).where(F.col("upto") >= F.col("need"))
        cut = reached.groupBy("__key").agg(F.max(F.struct("bin", "n", "upto", "low", "high", "need")).alias("c"))
        found = cut.select("__key", "c.low", "c.high", (F.col("c.need") - F.col("c.upto") + F.col("c.n")).alias("need"), "c.n")
        found = materialize(found, "cuts")
        settled = (F.col("n") <= edge_rows) | (F.col("low") == F.col("high"))
        ready = found.where(settled).drop("n")
        done = ready if done is None else done.unionByName(ready)
        live = found.where(~settled).drop("n")
    return live.select("__key", "low", "high", "need") if done is None else done


def greatest_n(df: DataFrame, keys: Sequence[str], by: str, n: int, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """The ``n`` rows per key with the greatest whole number ``by``, nulls last, by selection.

    Counts per range find the n-th value of every key; rows above it are kept where they
    are, and only those of the last range, some ``edge_rows`` per key, are shuffled and
    ranked. ``df`` is read a few times: give a stored table.
    """
    key = F.struct(*[F.col(k).alias(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    thin = df.select(key.alias("__key"), F.col(by).cast("long").alias("v"))
    cuts = materialize(_cuts(thin.where(F.col("v").isNotNull()), n, edge_rows), "cuts")
    cuts = cuts.select(F.col("__key").alias("__k"), F.col("low").alias("__low"), F.col("high").alias("__high"), F.col("need").alias("__need"))
    if not keys:
        cuts = F.broadcast(cuts)  # one row at most
    placed = df.withColumn("__key", key).join(cuts, F.col("__key").eqNullSafe(F.col("__k")), "left")
    value = F.col(by).cast("long")
    columns = df.columns
    sure = placed.where(value > F.col("__high")).select(*columns)
    # Keys without a cut have n values or fewer: all of them, and nulls as long as there is room.
    edge = placed.where(F.col("__low").isNull() | value.between(F.col("__low"), F.col("__high")))
    edge = edge.withColumn("__need", F.coalesce("__need", F.lit(n))).withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    order = F.col(by).desc_nulls_last()
    for by_ in (["__key", "__salt"], ["__key"]):
        ranked = edge.withColumn("__rank", F.row_number().over(Window.partitionBy(*by_).orderBy(order)))
        edge = ranked.where(F.col("__rank") <= F.col("__need")).drop("__rank")
    return sure.unionByName(edge.select(*columns))
