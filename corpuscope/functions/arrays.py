"""Array helpers used inside one row."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_BUILT: dict[tuple, Column] = {}


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the Column a function of column *names* returns.

    A Column is an immutable description, but describing a deep one takes
    thousands of small calls to the JVM. Kept per JVM gateway.
    """

    @wraps(build)
    def cached(*names: str) -> Column:
        context = SparkContext._active_spark_context
        key = (build.__module__, build.__qualname__, names, id(context and context._gateway))
        if key not in _BUILT:
            _BUILT[key] = build(*names)
        return _BUILT[key]

    return cached


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def indexes(array: Column) -> Column:
    """0 .. size-1, empty for an empty array."""
    n = F.size(array)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def between(first: Column, last: Column) -> Column:
    """first .. last, empty when last < first (or either is null)."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def counted(array: Column) -> Column:
    """``array<struct<value, n>>``: how often each value stands in the array, in order of
    the values. One sort and one pass over the places where the value changes."""

    def runs(env: Column) -> Column:
        values, firsts = env.values, env.firsts
        return F.transform(
            firsts,
            lambda at, k: F.struct(
                F.get(values, at).alias("value"),
                (F.coalesce(F.get(firsts, k + 1), F.size(values)) - at).cast("bigint").alias("n"),
            ),
        )

    def with_firsts(values: Column) -> Column:
        changes = F.filter(indexes(values), lambda i: ~F.get(values, i).eqNullSafe(F.get(values, i - 1)) | (i == 0))
        return let(F.struct(values.alias("values"), changes.alias("firsts")), runs)

    return let(F.array_sort(array), with_firsts)


def explode_structs(df: DataFrame, array: Column, keep: list[str], probe: str, pos: str | None = None) -> DataFrame:
    """One row per struct in ``array`` next to the ``keep`` columns.

    Uses the outer form plus a filter on ``probe`` (a field that is never null):
    for a plain explode Catalyst adds a size check in front that would evaluate
    the array expression a second time.
    """
    if pos is None:
        rows = df.select(*keep, F.inline_outer(array))
    else:
        rows = df.select(*keep, F.posexplode_outer(array).alias(pos, "__s"))
        fields = [F.col(pos), F.col("__s.*")]
        rows = rows.select(*keep, *fields)
    return rows.where(F.col(probe).isNotNull())


def explode_values(df: DataFrame, array: Column, keep: list[str], pos: str, value: str) -> DataFrame:
    """``keep..., pos, value`` for every non-null element, without a size check."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.where(F.col(value).isNotNull())
