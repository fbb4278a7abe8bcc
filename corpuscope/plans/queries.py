"""Every operator as a registered query over the test-data tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.functions import metrics, paths, text
from corpuscope.operators import complexity, docs_queue, graph, layers, modules, obfuscation, reports, structure, tokens
from corpuscope.operators import events as ev
from corpuscope.operators.instrumentation import instrumentation_sites
from corpuscope.plans import fixtures as fx
from corpuscope.plans.reports import architecture_report, diagram_nodes, runtime_report
from corpuscope.schemas import EVENTS_TABLE
from corpuscope.session import materialize, run_dir
from corpuscope.sources import events as event_log
from corpuscope.sources import responses as response_cache
from corpuscope.sources.files import scan_code_files
from corpuscope.sources.reports import read_report_table, write_report_tables
from corpuscope.streaming import events as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LATEST_N = 1000
LATEST_PER_TYPE = 200
LATEST_PER_LOCATION = 1500
SIZE_LIMIT = 4000


# Columns of the sections of both reports.
RUNTIME_SECTIONS = {
    "summary": ("total_events", "duration_ms"),
    "event_types": ("type", "n"),
    "function_calls": ("total_calls", "unique_functions"),
    "most_called": ("location", "n"),
    "call_frequency": ("location", "n"),
    "api_calls": ("total_calls", "unique_endpoints"),
    "endpoints": ("endpoint", "first_seq"),
    "methods": ("method", "n"),
    "dom_access": ("method", "n"),
    "storage_access": ("operation", "n"),
    "timeline": ("seq", "type", "location", "details"),
}
ARCHITECTURE_SECTIONS = {
    "nodes": ("node", "name", "complexity", "band", "layer", "color"),
    "edges": ("src_key", "dst_key"),
    "layers": ("layer", "modules", "avg_complexity", "total_kb", "critical"),
    "layer_critical": ("layer", "rank", "name", "complexity", "remaining"),
    "matrix": ("src", "dst"),
    "overview": ("total_modules", "total_complexity", "avg_complexity"),
    "most_complex": ("rank", "name", "complexity", "functions", "classes", "size_kb"),
    "distribution": ("band", "n"),
    "candidates": ("band", "rank", "name", "complexity"),
}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _modules(spark: SparkSession, sf: str) -> DataFrame:
    return modules.module_table(fx.code_files(spark, sf))


def _stored_modules(spark: SparkSession, sf: str) -> DataFrame:
    """The module table, written once: a graph query reads it several times."""
    return materialize(_modules(spark, sf), "modules")


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return layers.classify_layer(_modules(spark, sf))


def _deps(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.extract_dependencies(fx.code_files(spark, sf))


def _joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


# --- sources and sinks ----------------------------------------------------------


@_query
def scan_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as text files, then scanned as a folder."""
    folder = run_dir(spark, "pages")
    pages = fx.table(spark, sf, "pages")
    pages.select((F.col("page_id") % 16).alias("bucket"), "html").write.partitionBy("bucket").text(folder)
    files = scan_code_files(spark, folder, exts=("txt",))
    bucket = F.regexp_extract("path", r"/bucket=(\d+)/", 1).cast("bigint")
    return files.groupBy(bucket.alias("bucket"), "ext").agg(F.sum(F.length("content")).alias("chars"))


@_query
def scan_hidden_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Folders with all kinds of names, found from their one root."""
    folder = run_dir(spark, "site")
    pages = fx.table(spark, sf, "pages").withColumn("bucket", F.col("page_id") % 24)
    # One file per bucket, its lines in order.
    dealt = pages.repartition(8, "bucket").sortWithinPartitions("bucket", "page_id")
    for i, name in enumerate(("_next", ".hid", "plain")):
        part = dealt.where(F.col("bucket") % 3 == i).select("bucket", "html")
        part.write.partitionBy("bucket").text(f"{folder}/{name}/_sub")
    files = scan_code_files(spark, folder, exts=("TXT",))
    place = F.regexp_extract("path", r"/([^/]+/_sub/bucket=\d+)/", 1)
    return files.select(
        place.alias("folder"), "ext", F.length("content").alias("chars"), metrics.content_key(F.col("content")).alias("cache_key")
    )


@_query
def event_log_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    folder = run_dir(spark, "event-log")
    event_log.write_runtime_events(fx.runtime_events(spark, sf), folder)
    back = event_log.read_runtime_events(spark, folder, lines=True)
    return back.select(
        "seq", "type", "location", F.unix_millis("ts").alias("ms"), ev.details_summary(F.col("details")).alias("details")
    )


@_query
def response_cache_append(spark: SparkSession, sf: str) -> DataFrame:
    """Appending the answers of repeated texts keeps one per key."""
    path = run_dir(spark, "responses")
    keyed = docs_queue.with_content_key(fx.prose_files(spark, sf))
    answers = keyed.select("cache_key", F.lit("ask").alias("prompt"), F.col("content").alias("response"))
    response_cache.append_response_cache(answers, path)
    known = response_cache.read_response_table(spark, path)
    response_cache.append_response_cache(answers, path, existing=known)
    stored = response_cache.read_response_table(spark, path)
    return stored.select("cache_key", F.length("response").alias("chars"))


@_query
def response_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Stored answers as a folder of files, one per key, read back."""
    folder = run_dir(spark, "answers")
    response_cache.write_response_files(fx.responses(spark, sf), folder)
    return response_cache.read_response_cache(spark, folder)


@_query
def exported_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Events exported as indented arrays, one per day, and read in the order of the files."""
    folder = run_dir(spark, "exports")
    events = fx.runtime_events(spark, sf)
    lines = F.concat(
        F.lit('  {\n    "type": "'), F.col("type"), F.lit('",\n    "timestamp": '), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"),
        F.lit(',\n    "location": "'), F.col("location"), F.lit('",\n    "stackTrace": [],\n    "id": "e'), F.col("seq").cast("string"), F.lit('"\n  }'),
    )
    thin = events.select("seq", "ts", "type", "location", F.date_format("ts", "yyyyMMdd").alias("day"))
    # A day is one file, so one task's work; with four ranges a day, few tasks have two.
    days = thin.select("day").distinct().count()
    dealt = thin.repartitionByRange(max(1, 4 * days), "day")
    # Both ends are found in the one order in which the events are written; texts are made
    # behind it, so no sort holds them.
    in_day = Window.partitionBy("day").orderBy("seq")
    ends = {"first": F.lag(F.lit(1)).over(in_day).isNull(), "last": F.lead(F.lit(1)).over(in_day).isNull()}
    ordered = dealt.withColumns(ends).sortWithinPartitions("day", "seq")
    opened = F.when(F.col("first"), F.lit("[\n")).otherwise(F.lit(",\n"))
    closed = F.when(F.col("last"), F.lit("\n]")).otherwise(F.lit(""))
    text = ordered.select("day", F.concat(opened, lines, closed).alias("value"))
    text.write.option("lineSep", " ").partitionBy("day").text(folder)
    back = event_log.read_runtime_events(spark, folder)
    return back.select("seq", "type", "location", F.unix_millis("ts").alias("ms"), "id")


@_query
def report_tables_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    folder = run_dir(spark, "report")
    found = _modules(spark, sf)
    write_report_tables({"overview": reports.complexity_overview(found)}, folder)
    return read_report_table(spark, folder, "overview")


@_query
def pending_files(spark: SparkSession, sf: str) -> DataFrame:
    labels = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("size"))
    files = fx.prose_files(spark, sf).select(F.col("seq").alias("path"))
    done = labels.select(F.col("doc_id").alias("path"), "size")
    return docs_queue.pending_files(files, done).select(F.col("path").alias("doc_id"))


# --- projections and predicates -------------------------------------------------


@_query
def rel_path(spark: SparkSession, sf: str) -> DataFrame:
    return paths.with_rel_path(fx.code_files(spark, sf), "/proj").select("path", "rel")


@_query
def module_name(spark: SparkSession, sf: str) -> DataFrame:
    return paths.with_module_name(fx.code_files(spark, sf)).select("path", "name")


@_query
def only_parseable(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.only_parseable(fx.code_files(spark, sf)).select("path", "ext")


@_query
def within_size_limit(spark: SparkSession, sf: str) -> DataFrame:
    kept = paths.within_size_limit(fx.prose_files(spark, sf), SIZE_LIMIT)
    return kept.select(F.col("seq").alias("doc_id"))


@_query
def content_key(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", metrics.content_key(F.col("text")).alias("cache_key"))


@_query
def event_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return ev.event_timeline(fx.runtime_events(spark, sf))


@_query
def events_of_type(spark: SparkSession, sf: str) -> DataFrame:
    return ev.events_of_type(fx.runtime_events(spark, sf), "api_call").select("seq", "location")


@_query
def filter_events_by_config(spark: SparkSession, sf: str) -> DataFrame:
    kept = ev.filter_events_by_config(
        fx.runtime_events(spark, sf), track_variables=False, track_dom_access=False
    )
    return kept.select("seq", "type")


@_query
def with_event_id(spark: SparkSession, sf: str) -> DataFrame:
    return ev.with_event_id(fx.runtime_events(spark, sf)).select("seq", "id")


@_query
def module_bands(spark: SparkSession, sf: str) -> DataFrame:
    return _modules(spark, sf).select(
        "path",
        metrics.complexity_band(F.col("complexity")).alias("band"),
        metrics.size_kb(F.col("size")).alias("kb"),
        paths.node_key(F.col("path")).alias("node"),
    )


@_query
def classify_layer(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("path", "raw_label", "layer")


# --- corpus extraction ----------------------------------------------------------


@_query
def code_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.code_tokens(fx.code_files(spark, sf))


@_query
def extract_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return _deps(spark, sf)


@_query
def dependency_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dependency_graph(_deps(spark, sf))


@_query
def dependency_kind_counts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dependency_kind_counts(_deps(spark, sf))


@_query
def module_symbols(spark: SparkSession, sf: str) -> DataFrame:
    symbols = structure.module_symbols(fx.code_files(spark, sf))
    return symbols.select("path", _joined("exports"), _joined("functions"), _joined("classes"))


@_query
def code_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = structure.code_nodes(fx.code_files(spark, sf))
    return nodes.groupBy("path", "kind").agg(
        F.count("*").alias("n"), F.sum(F.size("fn_ancestors")).alias("ancestors")
    )


@_query
def module_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return complexity.module_complexity(structure.code_nodes(fx.code_files(spark, sf)))


@_query
def function_complexity(spark: SparkSession, sf: str) -> DataFrame:
    scored = complexity.function_complexity(structure.code_nodes(fx.code_files(spark, sf)))
    return scored.groupBy("path", "complexity").agg(F.count("*").alias("n"))


@_query
def module_table(spark: SparkSession, sf: str) -> DataFrame:
    return _modules(spark, sf).select(
        "seq",
        "path",
        "name",
        _joined("dependencies"),
        _joined("exports"),
        _joined("functions"),
        _joined("classes"),
        "size",
        "complexity",
    )


@_query
def rich_modules(spark: SparkSession, sf: str) -> DataFrame:
    """The module table over files of every construct, with the kinds found in each."""
    files = fx.rich_files(spark, sf)
    kinds = structure.code_nodes(files).groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"))
    found = modules.module_table(files).join(kinds, "path", "left")
    names = [_joined(c) for c in ("dependencies", "exports", "functions", "classes")]
    return found.select("path", *names, "complexity", F.coalesce("kinds", F.lit("")).alias("kinds"))


@_query
def split_bundle_modules(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.split_bundle_modules(fx.obfuscated_files(spark, sf))


# --- joins ----------------------------------------------------------------------


@_query
def files_with_deps(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.code_files(spark, sf)
    joined = graph.files_with_deps(files.select("seq", "path"), tokens.extract_dependencies(files))
    return joined.select("seq", "path", _joined("dependencies"))


@_query
def resolve_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    found = _stored_modules(spark, sf)
    return graph.resolve_dependencies(graph.module_edges(found), found)


@_query
def dependency_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with the leading ``./`` taken off, so that they spell module names."""
    found = _stored_modules(spark, sf)
    edges = graph.module_edges(found).withColumn("specifier", F.regexp_replace("specifier", r"^\./", ""))
    return graph.dependency_matrix(found, edges)


@_query
def internal_edges(spark: SparkSession, sf: str) -> DataFrame:
    found = _stored_modules(spark, sf)
    resolved = graph.resolve_dependencies(graph.module_edges(found), found)
    return graph.internal_edges(resolved)


@_query
def external_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    found = _stored_modules(spark, sf)
    edges = graph.module_edges(found)
    resolved = graph.resolve_dependencies(edges, found, match_empty_dir=False)
    return graph.external_dependencies(edges, resolved).select("path", "specifier")


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    """Stored answers for the texts of labelled documents."""
    labelled = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("seq"))
    keyed = docs_queue.with_content_key(fx.prose_files(spark, sf)).join(labelled, "seq", "left_semi")
    answer = F.concat(F.lit("# "), F.col("cache_key"), F.lit("\ntext\n# cut"))
    return keyed.select("cache_key", F.lit("ask").alias("prompt"), answer.alias("response"))


@_query
def cached_responses(spark: SparkSession, sf: str) -> DataFrame:
    keyed = docs_queue.with_content_key(fx.prose_files(spark, sf))
    return docs_queue.cached_sections(keyed, _cache(spark, sf))


@_query
def documentation_worklist(spark: SparkSession, sf: str) -> DataFrame:
    work = docs_queue.documentation_worklist(fx.prose_files(spark, sf), _cache(spark, sf), "/docs")
    return work.select("rel", "cache_key", F.length("prompt").alias("prompt_chars"), "deps", "status")


# --- aggregations ---------------------------------------------------------------


@_query
def complexity_overview(spark: SparkSession, sf: str) -> DataFrame:
    return reports.complexity_overview(_modules(spark, sf))


@_query
def complexity_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return reports.complexity_distribution(_modules(spark, sf))


@_query
def layer_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.layer_summary(_classified(spark, sf))


@_query
def event_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ev.event_summary(fx.runtime_events(spark, sf))


@_query
def event_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ev.event_type_counts(fx.runtime_events(spark, sf))


@_query
def function_call_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ev.function_call_stats(fx.runtime_events(spark, sf))


@_query
def function_call_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return ev.function_call_frequency(fx.runtime_events(spark, sf))


@_query
def api_call_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ev.api_call_stats(fx.runtime_events(spark, sf))


@_query
def api_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    return ev.api_endpoints(fx.runtime_events(spark, sf))


@_query
def api_methods(spark: SparkSession, sf: str) -> DataFrame:
    return ev.api_methods(fx.runtime_events(spark, sf))


@_query
def dom_access_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ev.dom_access_stats(fx.runtime_events(spark, sf))


@_query
def storage_access_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ev.storage_access_stats(fx.runtime_events(spark, sf))


@_query
def identifier_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return obfuscation.identifier_frequency(fx.prose_files(spark, sf))


@_query
def deps_per_file(spark: SparkSession, sf: str) -> DataFrame:
    return graph.deps_per_file(_modules(spark, sf))


# --- windows, sorts, limits -----------------------------------------------------


@_query
def most_complex_modules(spark: SparkSession, sf: str) -> DataFrame:
    return reports.most_complex_modules(_modules(spark, sf))


@_query
def most_called(spark: SparkSession, sf: str) -> DataFrame:
    return ev.most_called(fx.runtime_events(spark, sf))


@_query
def refactoring_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return reports.refactoring_candidates(_modules(spark, sf))


@_query
def layer_critical_modules(spark: SparkSession, sf: str) -> DataFrame:
    return reports.layer_critical_modules(layers.classify_layer(_stored_modules(spark, sf)))


@_query
def rename_map(spark: SparkSession, sf: str) -> DataFrame:
    return obfuscation.file_renames(fx.prose_files(spark, sf))


@_query
def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    return ev.latest_events(fx.runtime_events(spark, sf), LATEST_N).select("seq", "type", "location")


@_query
def latest_events_per_type(spark: SparkSession, sf: str) -> DataFrame:
    latest = ev.latest_events(fx.runtime_events(spark, sf), LATEST_PER_TYPE, "type")
    return latest.select("seq", "type", "location")


@_query
def latest_events_default(spark: SparkSession, sf: str) -> DataFrame:
    """The last 10,000 events, the default, found by selection."""
    events = materialize(fx.runtime_events(spark, sf), "events")
    return ev.latest_events(events).select("seq", "type", "location")


@_query
def latest_events_by_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The last 1,500 events of each location."""
    events = materialize(fx.runtime_events(spark, sf), "events")
    return ev.latest_events(events, LATEST_PER_LOCATION, "location").select("seq", "type", "location")


@_query
def dependency_matrix_factors(spark: SparkSession, sf: str) -> DataFrame:
    """How many sources and targets meet in each name of the factored matrix."""
    modules = _stored_modules(spark, sf)
    edges = graph.module_edges(modules).withColumn("specifier", F.regexp_replace("specifier", r"^\./", ""))
    sources, targets = graph.matrix_factors(modules, edges)
    per_name = [side.groupBy("specifier").agg(F.count("*").alias(n)) for side, n in ((sources, "sources"), (targets, "targets"))]
    return per_name[0].join(per_name[1], "specifier")


@_query
def ranked_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return obfuscation.ranked_patterns(fx.obfuscated_files(spark, sf))


@_query
def distinct_specifiers(spark: SparkSession, sf: str) -> DataFrame:
    return graph.distinct_specifiers(_deps(spark, sf))


# --- text functions -------------------------------------------------------------


@_query
def detect_obfuscation(spark: SparkSession, sf: str) -> DataFrame:
    return obfuscation.detect_obfuscation(fx.obfuscated_files(spark, sf))


@_query
def registered_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """A user's own rule next to the built-in ones."""
    rules = obfuscation.register_pattern(
        "storage_write",
        0.5,
        lambda c: c.contains("localStorage.setItem"),
        lambda c: F.replace(c, F.lit("localStorage.setItem"), F.lit("store")),
    )
    found = obfuscation.detect_obfuscation(fx.obfuscated_files(spark, sf), rules)
    return found.groupBy("pattern", "confidence").agg(F.count("*").alias("n"))


def _rewritten(spark: SparkSession, sf: str, rewrite: Callable) -> DataFrame:
    return fx.obfuscated_files(spark, sf).select("path", rewrite(F.col("content")).alias("content"))


@_query
def deobfuscate(spark: SparkSession, sf: str) -> DataFrame:
    done = obfuscation.deobfuscate(fx.obfuscated_files(spark, sf))
    return done.select("path", "content", F.array_join("applied", ",").alias("applied"))


@_query
def decode_char_codes(spark: SparkSession, sf: str) -> DataFrame:
    return _rewritten(spark, sf, text.decode_char_codes)


@_query
def decode_base64_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _rewritten(spark, sf, text.decode_base64_calls)


@_query
def decode_hex_escapes(spark: SparkSession, sf: str) -> DataFrame:
    return _rewritten(spark, sf, text.decode_hex_escapes)


@_query
def mark_eval_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return _rewritten(spark, sf, text.mark_eval_payloads)


@_query
def extract_eval_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return obfuscation.extract_eval_payloads(fx.obfuscated_files(spark, sf))


@_query
def encoded_payloads(spark: SparkSession, sf: str) -> DataFrame:
    return obfuscation.encoded_payloads(fx.obfuscated_files(spark, sf))


@_query
def reflow_uglify(spark: SparkSession, sf: str) -> DataFrame:
    return _rewritten(spark, sf, text.reflow_uglify)


@_query
def reflow_terser(spark: SparkSession, sf: str) -> DataFrame:
    return _rewritten(spark, sf, text.reflow_terser)


@_query
def apply_renames(spark: SparkSession, sf: str) -> DataFrame:
    return obfuscation.apply_renames(fx.prose_files(spark, sf)).select("path", "content")


@_query
def registered_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Rewrites of a user's own rules, one built of functions and one an Arrow function."""

    @F.arrow_udf(T.StringType())
    def upper_reads(column: pa.Array) -> pa.Array:
        return pc.replace_substring(column, pattern="querySelector", replacement="SELECT")

    rules = obfuscation.register_pattern(
        "storage_write", 0.5, lambda c: c.contains("localStorage.setItem"),
        lambda c: F.replace(c, F.lit("localStorage.setItem"), F.lit("store")), patterns=[],
    )
    rules = obfuscation.register_pattern("dom_read", 0.99, lambda c: c.contains("querySelector"), upper_reads, rules)
    done = obfuscation.deobfuscate(fx.obfuscated_files(spark, sf), rules)
    return done.select("path", "content", F.array_join("applied", ",").alias("applied"))


@_query
def normalise_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's words as split, joined and escaped literals, repaired."""
    parts = fx.table(spark, sf, "part")
    name, brand = F.col("p_name"), F.col("p_brand")
    broken = F.concat(
        F.lit("a=`"), name, F.lit("` + `"), brand, F.lit("`;\nb=\""), name, F.lit("\"\n  \""), brand,
        F.lit("\";\nc='"), name, F.lit("' + '"), brand, F.lit("';\nd=\"\\u"), F.hex(F.col("p_size") % 16), F.lit("\";"),
    )
    return parts.select("p_partkey", text.normalise_strings(broken).alias("content"))


@_query
def strip_comments(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.page_files(spark, sf)
    return pages.select("path", text.strip_comments(F.col("content")).alias("content"))


@_query
def halve_indent(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.code_files(spark, sf)
    return files.select("path", text.halve_indent(F.col("content")).alias("content"))


@_query
def instrumentation_sites_inventory(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.code_files(spark, sf).unionByName(fx.obfuscated_files(spark, sf))
    return instrumentation_sites(files)


@_query
def first_markdown_section(spark: SparkSession, sf: str) -> DataFrame:
    return docs_queue.first_markdown_sections(fx.responses(spark, sf))


# --- streaming ------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    raw = streaming.read_event_stream(spark, EVENTS_TABLE, sf, "events.parquet")
    return fx.derive(raw, "events", fx.RUNTIME_EVENTS_SQL)


@_query
def stream_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = streaming.stream_event_counts(_event_stream(spark, sf))
    return streaming.drain_to_table(counts, "complete", "event-counts")


@_query
def stream_latest_events(spark: SparkSession, sf: str) -> DataFrame:
    table = streaming.drain_latest(_event_stream(spark, sf), LATEST_PER_TYPE, "type", "latest-events")
    return table.select("seq", "type", "location")


# --- reports --------------------------------------------------------------------


def _report_rows(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]]) -> DataFrame:
    """``section, line``: the rows of a report's tables, column by column as text."""
    out = None
    for section, names in columns.items():
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in names]
        rows = tables[section].select(F.lit(section).alias("section"), F.concat_ws("|", *cells).alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_query
def runtime_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every section of the runtime report, row by row."""
    events = materialize(fx.runtime_events(spark, sf), "events")
    return _report_rows(runtime_report(events), RUNTIME_SECTIONS)


@_query
def architecture_report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every section of the architecture report, row by row."""
    return _report_rows(architecture_report(fx.code_files(spark, sf)), ARCHITECTURE_SECTIONS)


@_query
def runtime_report_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counted sections of the runtime report in one long table."""
    tables = runtime_report(fx.runtime_events(spark, sf))
    sections = (
        ("event_types", "type"),
        ("call_frequency", "location"),
        ("methods", "method"),
        ("dom_access", "method"),
        ("storage_access", "operation"),
    )
    out = None
    for section, label in sections:
        part = tables[section].select(F.lit(section).alias("section"), F.col(label).alias("label"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@_query
def architecture_report_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of all tables of the architecture report."""
    out = None
    for name, df in architecture_report(fx.code_files(spark, sf)).items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@_query
def architecture_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return diagram_nodes(_classified(spark, sf))
