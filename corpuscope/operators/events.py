"""Runtime-event operators: filters, identifiers, statistics, retention.

Every count aggregates map-side first, so a location or type that holds most of
the log still reaches its reducer as one partial row per task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.ranking import GROUP_LIMIT, greatest_n, top_n_by
from corpuscope.rules import EVENT_TYPES, MAX_EVENTS


def events_of_type(events: DataFrame, event_type: str) -> DataFrame:
    return events.where(F.col("type") == event_type)


def enabled_types(
    track_functions: bool = True,
    track_variables: bool = True,
    track_api_calls: bool = True,
    track_dom_access: bool = True,
    track_storage_access: bool = True,
) -> list[str]:
    """Event types left on by the tracking switches (all on by default)."""
    switches = (
        track_functions,
        track_variables,
        track_api_calls,
        track_dom_access,
        track_storage_access,
    )
    return [name for name, on in zip(EVENT_TYPES, switches) if on]


def filter_events_by_config(events: DataFrame, **switches: bool) -> DataFrame:
    return events.where(F.col("type").isin(enabled_types(**switches)))


def with_event_id(events: DataFrame, columns: Iterable[str] = ("seq", "type", "location")) -> DataFrame:
    """Add a 16-hex ``id``. It is a digest, so a re-run task gives the same id."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return events.withColumn("id", F.left(F.sha2(text, 256), F.lit(16)))


def details_summary(details: Column) -> Column:
    """Key names of a JSON object, index list of a JSON array, else the value."""
    keys = F.array_join(F.json_object_keys(details), ", ")
    n = F.json_array_length(details)
    indexes = F.when(n > 0, F.array_join(F.sequence(F.lit(0), n - 1), ", ")).when(n == 0, F.lit(""))
    return F.coalesce(keys, indexes, details)


def event_timeline(events: DataFrame) -> DataFrame:
    """``seq, ts, type, location, details`` with details reduced to key names.

    The log keeps its order in ``seq``; sorting the whole log is left to the
    caller that displays it.
    """
    return events.select(
        "seq", "ts", "type", "location", details_summary(F.col("details")).alias("details")
    )


def event_type_counts(events: DataFrame) -> DataFrame:
    """``type, n``."""
    return events.groupBy("type").agg(F.count("*").alias("n"))


def event_summary(events: DataFrame) -> DataFrame:
    """One row: ``total_events, start_ts, end_ts, duration_ms``.

    First and last follow log order (``seq``), not the clock, so an unsorted log
    may have a negative duration. An empty log gives nulls.
    """
    ends = events.agg(
        F.count("*").alias("total_events"),
        F.min_by("ts", "seq").alias("start_ts"),
        F.max_by("ts", "seq").alias("end_ts"),
    )

    def millis(name: str) -> Column:
        return F.unix_millis(F.col(name).cast("timestamp"))

    return ends.withColumn("duration_ms", millis("end_ts") - millis("start_ts"))


def _located(events: DataFrame, event_type: str, name: str) -> DataFrame:
    return (
        events_of_type(events, event_type)
        .groupBy(F.col("location").alias(name))
        .agg(F.count("*").alias("n"))
    )


def function_call_frequency(events: DataFrame) -> DataFrame:
    """``location, n``."""
    return _located(events, "function_call", "location")


def function_call_stats(events: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: ``total_calls, unique_functions``.

    Exact by default, by counting the grouped locations: a distinct count in one
    global aggregate would expand and shuffle the same rows.
    """
    calls = events_of_type(events, "function_call")
    if approximate:
        return calls.agg(
            F.count("*").alias("total_calls"),
            F.approx_count_distinct("location").alias("unique_functions"),
        )
    return function_call_frequency(events).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_calls"),
        F.count("location").alias("unique_functions"),
    )


def most_called(events: DataFrame, k: int = 10) -> DataFrame:
    """``location, n``: the k most called functions, ties by first appearance."""
    calls = (
        events_of_type(events, "function_call")
        .groupBy("location")
        .agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    )
    return calls.orderBy(F.desc("n"), "first_seq").limit(k).select("location", "n")


def _json_field(name: str) -> Column:
    # Missing, null and empty values are all "absent".
    return F.nullif(F.get_json_object("details", f"$.{name}"), F.lit(""))


def api_endpoints(events: DataFrame) -> DataFrame:
    """``endpoint, first_seq``: distinct endpoints with their first appearance."""
    return (
        events_of_type(events, "api_call")
        .groupBy(F.coalesce(_json_field("url"), F.col("location")).alias("endpoint"))
        .agg(F.min("seq").alias("first_seq"))
    )


def api_methods(events: DataFrame) -> DataFrame:
    """``method, n``."""
    return (
        events_of_type(events, "api_call")
        .groupBy(F.coalesce(_json_field("method"), F.lit("unknown")).alias("method"))
        .agg(F.count("*").alias("n"))
    )


def api_call_stats(events: DataFrame) -> DataFrame:
    """One row: ``total_calls, unique_endpoints``."""
    return (
        events_of_type(events, "api_call")
        .groupBy(F.coalesce(_json_field("url"), F.col("location")).alias("endpoint"))
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_calls"),
            F.count("*").alias("unique_endpoints"),
        )
    )


def dom_access_stats(events: DataFrame) -> DataFrame:
    """``method, n``; the total is the sum of ``n``."""
    return _located(events, "dom_access", "method")


def storage_access_stats(events: DataFrame) -> DataFrame:
    """``operation, n``; the total is the sum of ``n``."""
    return _located(events, "storage_access", "operation")


def latest_events(events: DataFrame, n: int = MAX_EVENTS, key: str | None = None) -> DataFrame:
    """The last ``n`` events in log order, over the whole log or per ``key``.

    Up to the number that Spark cuts map-side (1000 unless the session raises it) by
    ranking, beyond it by selection; the result is the same.
    """
    keys = [key] if key else []
    if n <= int(events.sparkSession.conf.get(GROUP_LIMIT, "1000")):
        return top_n_by(events, keys, [F.col("seq").desc_nulls_last()], n)
    return greatest_n(events, keys, "seq", n)
