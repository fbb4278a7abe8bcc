"""Tables of the complexity and layer reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.metrics import complexity_band, size_kb
from corpuscope.operators.layers import layer_order
from corpuscope.operators.ranking import top_n_by
from corpuscope.rules import BANDS, CRITICAL_ABOVE


def complexity_overview(modules: DataFrame) -> DataFrame:
    """One row: ``total_modules, total_complexity, avg_complexity``."""
    return modules.agg(
        F.count("*").alias("total_modules"),
        F.sum("complexity").alias("total_complexity"),
        F.round(F.avg("complexity"), 2).alias("avg_complexity"),
    )


def complexity_distribution(modules: DataFrame) -> DataFrame:
    """``band, n`` for all four bands, empty ones included."""
    band = complexity_band(F.col("complexity"))
    counted = modules.agg(*[F.count_if(band == b).alias(b) for b in BANDS])
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("n")) for b in BANDS])
    return counted.select(F.inline(rows))


def layer_summary(classified: DataFrame) -> DataFrame:
    """``layer, modules, avg_complexity, total_kb, critical`` per non-empty layer."""
    return (
        classified.groupBy("layer")
        .agg(
            F.count("*").alias("modules"),
            F.round(F.avg("complexity"), 2).alias("avg_complexity"),
            size_kb(F.sum("size")).alias("total_kb"),
            F.count_if(F.col("complexity") > CRITICAL_ABOVE).alias("critical"),
        )
        .orderBy(layer_order(F.col("layer")))
    )


def most_complex_modules(modules: DataFrame, k: int = 10) -> DataFrame:
    """``rank, name, complexity, functions, classes, size_kb``: the first k.

    A top-k first, then ranks over its k rows.
    """
    top = (
        modules.select(
            "seq",
            "path",
            "name",
            "complexity",
            F.size("functions").alias("functions"),
            F.size("classes").alias("classes"),
            size_kb(F.col("size")).alias("size_kb"),
        )
        .orderBy(F.desc("complexity"), "seq", "path")
        .limit(k)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("complexity"), "seq", "path"))
    return top.select(
        rank.alias("rank"), "name", "complexity", "functions", "classes", "size_kb"
    )


def refactoring_candidates(modules: DataFrame, k: int = 5) -> DataFrame:
    """``band, rank, name, complexity``: up to k critical and k high modules."""
    banded = modules.select(
        complexity_band(F.col("complexity")).alias("band"), "seq", "path", "name", "complexity"
    ).where(F.col("band").isin("critical", "high"))
    order = [F.desc("complexity"), F.asc("seq"), F.asc("path")]
    top = top_n_by(banded, ["band"], order, k, rank="rank")
    return top.select("band", "rank", "name", "complexity")


def layer_critical_modules(classified: DataFrame, k: int = 5) -> DataFrame:
    """``layer, rank, name, complexity, remaining``: up to k critical per layer.

    Walk order, not score order. ``remaining`` is how many more there are; the
    count is a plain aggregate (one row per layer), not a window over the layer.
    """
    critical = classified.where(F.col("complexity") > CRITICAL_ABOVE).select(
        "layer", "seq", "path", "name", "complexity"
    )
    totals = critical.groupBy("layer").agg(
        F.greatest(F.count("*") - k, F.lit(0)).alias("remaining")
    )
    top = top_n_by(
        critical, ["layer"], [F.asc("seq"), F.asc("path")], k, rank="rank"
    )
    return top.join(totals, "layer").select("layer", "rank", "name", "complexity", "remaining")
