"""Joins that keep a hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOIN_SALTS = 16
# Any key outside the HOT_KEYS most frequent ones holds less than 1/HOT_KEYS of
# the rows, so this list is all the broadcast below ever needs.
HOT_KEYS = 256
# Rows of a hot key that a task gets of either side.
GRID_BLOCK = 50_000


def _salt(spread_by: Sequence[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")


def hot_keys(rows: DataFrame, on: str, k: int = HOT_KEYS) -> DataFrame:
    """The k most frequent values of ``on``: at most k rows, whatever the input."""
    counted = rows.groupBy(on).agg(F.count("*").alias("__n"))
    return counted.orderBy(F.desc("__n"), on).limit(k).select(on)


def hot_split_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: str,
    spread_by: Sequence[str],
    how: str = "left",
    salts: int = JOIN_SALTS * 4,
) -> DataFrame:
    """Join ``rows`` (any skew on ``on``) with a large or wide ``lookup``.

    Only rows of the most frequent keys are dealt over ``salts`` tasks, and only
    the lookup rows of those keys are repeated. ``rows`` is read twice: give it a
    stored or thin table.
    """
    hot = F.broadcast(hot_keys(rows, on).withColumn("__hot", F.lit(True)))
    salted = rows.join(hot, on, "left").withColumn(
        "__salt", F.when(F.col("__hot"), _salt(spread_by, salts)).otherwise(0)
    )
    every = F.array(*[F.lit(i) for i in range(salts)])
    copies = lookup.join(hot, on, "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot"), every).otherwise(F.array(F.lit(0))))
    )
    return salted.drop("__hot").join(copies.drop("__hot"), [on, "__salt"], how).drop("__salt")


def _counted(rows: DataFrame, on: str, name: str) -> DataFrame:
    """Rows per hot value of ``on``; the whole count stands beside each."""
    counted = rows.groupBy(on).agg(F.count("*").alias(name))
    return counted.orderBy(F.desc(name), on).limit(HOT_KEYS)


def grid_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    left_by: Sequence[str],
    right_by: Sequence[str],
    block: int = GRID_BLOCK,
) -> DataFrame:
    """Inner join of two sides either of which, or both, may be hot on a key.

    The rows of a hot key form a grid: left rows are dealt over as many lines, and right
    rows over as many columns, as their own measured count asks for, and each is
    repeated along the other dimension. So the pairs of one key are made in many tasks,
    and no task sees all rows of either side. Only the most frequent keys of each side
    are laid out so, at most ``2 * HOT_KEYS``; the others hold less than one part in
    ``HOT_KEYS`` of the rows each. Both sides are read twice: give stored tables.
    ``left_by`` and ``right_by`` name columns that spread a key's rows.
    """
    nulls = [F.coalesce(c, F.lit(1)).alias(c) for c in ("__l", "__r")]
    hot = _counted(left, on, "__l").join(_counted(right, on, "__r"), on, "full").select(on, *nulls)
    hot = hot.where((F.col("__l") > block) | (F.col("__r") > block))
    lines, columns = (F.ceil(F.col(c) / F.lit(block)).cast("int").alias(c) for c in ("__l", "__r"))
    hot = F.broadcast(hot.select(on, lines, columns))  # at most 2 * HOT_KEYS rows

    def dealt(rows: DataFrame, by: Sequence[str], own: str, own_place: str, other: str, other_place: str) -> DataFrame:
        marked = rows.join(hot, on, "left")
        blocks = F.coalesce(F.col(own), F.lit(1))
        along = F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)
        placed = marked.withColumn(own_place, F.pmod(F.xxhash64(*by), blocks).cast("int"))
        return placed.withColumn(other_place, F.explode(along)).drop("__l", "__r")

    lefts = dealt(left, left_by, "__l", "__line", "__r", "__column")
    rights = dealt(right, right_by, "__r", "__column", "__l", "__line")
    return lefts.join(rights, [on, "__line", "__column"]).drop("__line", "__column")
