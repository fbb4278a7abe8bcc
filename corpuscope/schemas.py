"""Explicit schemas of the files that the sources read."""

from __future__ import annotations

from pyspark.sql import types as T

RESPONSES = T.StructType(
    [
        T.StructField("cache_key", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("response", T.StringType()),
    ]
)

# One element of the exported event log (a JSON array).
EVENT_LOG_JSON = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("location", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("stackTrace", T.ArrayType(T.StringType())),
        T.StructField("id", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)

# The driver's ``events`` table, as a streaming source needs it spelled out.
EVENTS_TABLE = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
