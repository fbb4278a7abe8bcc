"""Architecture layers by an ordered rule list."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.arrays import built_once
from corpuscope.rules import (
    BUSY_CLASSES,
    BUSY_COMPLEXITY,
    BUSY_FUNCTIONS,
    BUSY_LABEL,
    EXPORT_RULES,
    LAYERS,
    PATH_RULES,
    UNKNOWN_LAYER,
)


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def _any_export(words: tuple[str, ...]) -> Column:
    return F.exists("exports", lambda e: _holds(F.lower(e), words))


@built_once
def raw_layer() -> Column:
    """Label of the first matching rule, content rules first."""
    path, name = F.lower("path"), F.lower("name")
    rules: list[tuple[str, Column]] = []
    for label, in_export, in_path in EXPORT_RULES:
        test = _any_export(in_export)
        rules.append((label, test & _holds(path, in_path) if in_path else test))
    for label, in_path, in_name, in_export in PATH_RULES:
        tests = [_holds(path, in_path)]
        if in_name:
            tests.append(_holds(name, in_name))
        if in_export:
            tests.append(_any_export(in_export))
        rules.append((label, reduce(or_, tests)))
    busy = (
        (F.col("complexity") > BUSY_COMPLEXITY)
        | (F.size("functions") > BUSY_FUNCTIONS)
        | (F.size("classes") > BUSY_CLASSES)
    )
    rules.append((BUSY_LABEL, busy))
    label, test = rules[0]
    chain = F.when(test, label)
    for label, test in rules[1:]:
        chain = chain.when(test, label)
    return chain.otherwise(UNKNOWN_LAYER)


def classify_layer(modules: DataFrame) -> DataFrame:
    """Add ``raw_label`` and ``layer``; labels outside the fixed layers fold to Unknown."""
    known = [name for name, _ in LAYERS]
    labelled = modules.withColumn("raw_label", raw_layer())
    return labelled.withColumn(
        "layer",
        F.when(F.col("raw_label").isin(known), F.col("raw_label")).otherwise(UNKNOWN_LAYER),
    )


def layer_order(layer: Column) -> Column:
    """Position of a layer in reports."""
    chain = F.lit(len(LAYERS) - 1)
    for i, (name, _) in enumerate(LAYERS):
        chain = F.when(layer == name, i).otherwise(chain)
    return chain


def layer_color(layer: Column) -> Column:
    chain = F.lit(LAYERS[-1][1])
    for name, color in LAYERS:
        chain = F.when(layer == name, color).otherwise(chain)
    return chain
