"""Inventory of the call sites that tracing would wrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope import rules
from corpuscope.functions.arrays import counted, explode_structs
from corpuscope.operators.structure import with_structure


def _sites(family: str, targets: Column) -> Column:
    return F.transform(
        targets, lambda t: F.struct(F.lit(family).alias("family"), t.alias("target"))
    )


def _found(pattern: str, group: int) -> Column:
    return F.regexp_extract_all("content", F.lit(pattern), F.lit(group))


def _constant(pattern: str, target: str) -> Column:
    return F.transform(_found(pattern, 0), lambda _: F.lit(target))


def instrumentation_sites(
    files: DataFrame,
    track_functions: bool = True,
    track_variables: bool = True,
    track_api_calls: bool = True,
    track_dom_access: bool = True,
    track_storage_access: bool = True,
) -> DataFrame:
    """``path, family, target, n``: how often each file touches each target.

    Functions are declarations with their names; variables are the targets of an
    ``=`` (comparisons included, as plain text search sees them).
    """
    df = files
    families: list[Column] = []
    if track_functions:
        df = with_structure(files)
        declared = F.transform(
            F.filter("nodes", lambda n: n.kind == "fn_decl"),
            lambda n: F.coalesce(n.getField("name"), F.lit("anonymous")),
        )
        families.append(_sites("function", declared))
    if track_variables:
        families.append(_sites("variable", _found(rules.SITE_VARIABLE, 1)))
    if track_api_calls:
        families.append(_sites("api", _constant(rules.SITE_XHR, "XMLHttpRequest")))
        families.append(_sites("api", _constant(rules.SITE_FETCH, "fetch")))
    if track_dom_access:
        families.append(_sites("dom", _found(rules.SITE_DOM, 1)))
    if track_storage_access:
        families.append(_sites("storage", _found(rules.SITE_STORAGE, 0)))
    if not families:
        return files.select("path", F.lit("").alias("family"), F.lit("").alias("target"), F.lit(0).cast("bigint").alias("n")).limit(0)
    # Counted inside the row: a file's sites never leave it before they are few.
    sites = F.transform(
        counted(F.concat(*families)),
        lambda c: F.struct(c.value.family.alias("family"), c.value.target.alias("target"), c.n.alias("n")),
    )
    return explode_structs(df, sites, ["path"], "family")
