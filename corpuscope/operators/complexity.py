"""Complexity scores in closed form.

A function's own score is R = floor(W + 0.5), W being the in-function weight of
everything below it, plus one. Scores of nested functions are added at every
level, so a function g nested k functions deep below f counts 2^(k-1) times in
f, and one nested d deep counts 2^d times in its module.

Scores are summed in double precision, as by the tool whose scores they match, and given
as whole numbers; one beyond a bigint (some sixty nested functions double it each) is
the largest bigint, in every way of computing it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.arrays import built_once, explode_structs
from corpuscope.operators.structure import weight_twice
from corpuscope.rules import FUNCTION_KINDS, NODE_WEIGHTS


@built_once
def complexity_of(nodes: str) -> Column:
    """Module score from the in-row ``nodes`` array."""
    outside = F.aggregate(
        F.transform(nodes, lambda n: weight_twice(n.kind, 0)), F.lit(0), lambda a, w: a + w
    )
    functions = F.aggregate(
        F.filter(nodes, lambda n: n.kind.isin(*FUNCTION_KINDS)),
        F.lit(0.0),
        lambda a, n: a + F.pow(F.lit(2.0), n.depth) * (1 + F.floor((n.inner + 1) / 2)),
    )
    return F.floor(outside / 2 + functions + 0.5).cast("bigint")


def _weight(slot: int) -> Column:
    column = F.lit(0.0)
    for name, weights in NODE_WEIGHTS.items():
        if weights[slot]:
            column = F.when(F.col("kind") == name, weights[slot]).otherwise(column)
    return column


def _own_scores(nodes: DataFrame) -> DataFrame:
    """``path, fn_id, depth, fn_ancestors, own``: 1 + R per function of a nodes table.

    A null ``fn_id`` row carries the weight outside of functions. Each node sends
    its weight to the functions around it, and each function announces itself, so
    one grouping does it and no join.
    """
    is_function = F.col("kind").isin(*FUNCTION_KINDS)

    def part(fn_id: Column, w: Column, announced: Column) -> Column:
        ancestors = F.when(announced, F.col("fn_ancestors"))
        return F.struct(
            fn_id.cast("bigint").alias("fn_id"),
            w.alias("w"),
            F.size(ancestors).alias("depth"),
            ancestors.alias("fn_ancestors"),
        )

    no, nothing = F.lit(False), F.lit(0.0)
    around = F.transform("fn_ancestors", lambda a: part(a, F.col("w_fn"), no))
    itself = F.array(
        part(F.lit(None), F.col("w_top"), no),
        F.when(is_function, part(F.col("node_id"), nothing, F.lit(True))),
    )
    weighted = nodes.withColumns({"w_top": _weight(0), "w_fn": _weight(1)})
    sent = explode_structs(weighted, F.concat(around, F.array_compact(itself)), ["path"], "w")
    own = F.when(F.col("fn_id").isNull(), F.col("w")).otherwise(1 + F.floor(F.col("w") + 0.5))
    return (
        sent.groupBy("path", "fn_id")
        .agg(
            F.sum("w").alias("w"),
            F.max("depth").alias("depth"),
            F.first("fn_ancestors", ignorenulls=True).alias("fn_ancestors"),
        )
        .select("path", "fn_id", "depth", "fn_ancestors", own.alias("own"))
    )


def function_complexity(nodes: DataFrame) -> DataFrame:
    """``path, fn_id, complexity`` from ``path, node_id, kind, fn_ancestors``.

    ``fn_ancestors`` lists the enclosing functions, innermost first.
    """
    own = _own_scores(nodes).where(F.col("fn_id").isNotNull())
    itself = F.array(F.struct(F.col("fn_id").alias("target"), F.col("own").alias("part")))
    nested = F.transform(
        "fn_ancestors",
        lambda a, k: F.struct(a.alias("target"), (F.pow(F.lit(2.0), k) * F.col("own")).alias("part")),
    )
    parts = explode_structs(own, F.concat(itself, nested), ["path"], "target")
    return parts.groupBy("path", F.col("target").alias("fn_id")).agg(
        F.floor(F.sum("part")).cast("bigint").alias("complexity")
    )


def module_complexity(nodes: DataFrame) -> DataFrame:
    """``path, complexity`` from a nodes table, one row per path that has nodes."""
    copies = F.when(F.col("fn_id").isNull(), 1.0).otherwise(
        F.pow(F.lit(2.0), F.col("depth"))
    )
    return (
        _own_scores(nodes)
        .groupBy("path")
        .agg(F.floor(F.sum(copies * F.col("own")) + 0.5).cast("bigint").alias("complexity"))
    )
