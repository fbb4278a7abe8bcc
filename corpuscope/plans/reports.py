"""Reports made of several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.metrics import complexity_band
from corpuscope.functions.paths import node_key
from corpuscope.operators import events as ev
from corpuscope.operators import graph, reports
from corpuscope.operators.layers import classify_layer, layer_color
from corpuscope.operators.modules import module_table, with_walk_order
from corpuscope.session import materialize


def diagram_nodes(classified: DataFrame) -> DataFrame:
    """``node, name, complexity, band, layer, color``: one node per module."""
    return classified.select(
        node_key(F.col("path")).alias("node"),
        "name",
        "complexity",
        complexity_band(F.col("complexity")).alias("band"),
        "layer",
        layer_color(F.col("layer")).alias("color"),
    )


def architecture_report(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of the architecture report.

    The corpus is lexed once: module rows are written to the shared folder and
    every table reads only the columns it needs from there. Files without a walk
    order are ordered by path, after lexing.
    """
    modules = materialize(classify_layer(module_table(files)), "modules")
    if not modules.where(F.col("seq").isNull()).isEmpty():
        modules = materialize(with_walk_order(modules.drop("seq")), "modules")
    edges = graph.module_edges(modules)
    resolved = graph.resolve_dependencies(edges, modules)
    return {
        "nodes": diagram_nodes(modules),
        "edges": graph.internal_edges(resolved),
        "layers": reports.layer_summary(modules),
        "layer_critical": reports.layer_critical_modules(modules),
        "matrix": graph.dependency_matrix(modules, edges),
        "overview": reports.complexity_overview(modules),
        "most_complex": reports.most_complex_modules(modules),
        "distribution": reports.complexity_distribution(modules),
        "candidates": reports.refactoring_candidates(modules),
    }


def runtime_report(events: DataFrame) -> dict[str, DataFrame]:
    """All sections of the runtime report, as tables."""
    return {
        "summary": ev.event_summary(events),
        "event_types": ev.event_type_counts(events),
        "function_calls": ev.function_call_stats(events),
        "most_called": ev.most_called(events),
        "call_frequency": ev.function_call_frequency(events),
        "api_calls": ev.api_call_stats(events),
        "endpoints": ev.api_endpoints(events),
        "methods": ev.api_methods(events),
        "dom_access": ev.dom_access_stats(events),
        "storage_access": ev.storage_access_stats(events),
        "timeline": ev.event_timeline(events),
    }
