"""The exported runtime-event log (JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscope.schemas import EVENT_LOG_JSON


# What ends an event of an export that is indented by two.
_BORDER = "\n  }"


def _one_line(details: Column) -> Column:
    """Indented JSON on one line, key order kept; other text as it is.

    Inside valid JSON a raw line break never belongs to a string.
    """
    joined = F.regexp_replace(details, r"\s*[\r\n]+\s*", "")
    return F.when(F.try_parse_json(details).isNotNull(), joined).otherwise(details)


def _placed(raw: DataFrame) -> DataFrame:
    """Rows of files with their file and the place of their split."""
    return raw.withColumns({"__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start")})


def _numbered(placed: DataFrame) -> DataFrame:
    """``seq`` 0, 1, ... by file, by place of the split in the file, and in it.

    Spark deals splits to tasks by size, so row ids alone follow no order; here one row
    per split is ordered, and no event is moved.
    """
    rows = placed.withColumn("__id", F.monotonically_increasing_id())
    splits = rows.groupBy("__file", "__start").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    joined = rows.join(splits, ["__file", "__start"])
    seq = F.col("__base") + F.col("__id") - F.col("__first")
    return joined.withColumn("seq", seq).drop("__file", "__start", "__id", "__n", "__first", "__base")


def _exported(spark: SparkSession, path: str) -> DataFrame:
    """``e``, and where it stands, of exported arrays of events.

    An export is indented by two, so that a brace at that depth ends an event and nothing
    else: no string holds a line break. Text is read up to there, so a large export is as
    many tasks as it has splits. An array without line breaks is one record, and one
    task's work.
    """
    pieces = _placed(spark.read.option("lineSep", _BORDER).text(path))
    # A record is an event without its last brace, or what stands behind the last event,
    # or a whole array, which goes on behind its first bracket without a line break.
    whole = F.col("value").rlike(r"^\s*\[(?!\s*\n)")
    event = F.regexp_replace("value", r"^\s*[\[,]?\s*", "")
    array = F.when(whole, F.col("value")).otherwise(F.concat(F.lit("["), event, F.lit("}]")))
    kept = pieces.where(~F.col("value").rlike(r"^\s*\]?\s*$"))
    events = F.from_json(array, f"array<{EVENT_LOG_JSON.simpleString()}>")
    return kept.select("__file", "__start", F.explode(events).alias("e"))


def read_runtime_events(spark: SparkSession, path: str, lines: bool = False, split: bool = True) -> DataFrame:
    """``seq, ts, type, location, details, stack_trace, id`` from exported logs.

    An export is a JSON array of events, one per file, indented by two or not at all; with
    ``lines`` a log holds one event per line, as ``write_runtime_events`` writes it. Either
    splits freely. ``split=False`` reads arrays of any layout, one task a file.

    ``seq`` is the one the log was written with; without one, events are numbered by file
    name and by place in the file.
    """
    if lines or not split:
        raw = _placed(spark.read.schema(EVENT_LOG_JSON).json(path, multiLine=not lines))
    else:
        raw = _exported(spark, path).select("__file", "__start", "e.*")
    numbered = _numbered(raw.withColumnRenamed("seq", "own"))
    return numbered.select(
        F.coalesce("own", "seq").alias("seq"),
        F.timestamp_millis("timestamp").alias("ts"),
        "type",
        "location",
        _one_line(F.col("details")).alias("details"),
        F.col("stackTrace").alias("stack_trace"),
        "id",
    )


def _json_member(name: str, value: Column) -> Column:
    """``"name":value`` with the value as JSON, null included."""
    text = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
    return F.regexp_replace(text, r"^\{|\}$", "")


def _details_member(details: Column) -> Column:
    """JSON text goes out as it is (key order kept), other text as a JSON string."""
    raw = F.concat(F.lit('"details":'), _one_line(details))
    return F.when(F.try_parse_json(details).isNotNull(), raw).otherwise(
        _json_member("details", details)
    )


def write_runtime_events(events: DataFrame, path: str) -> None:
    """Write events as JSON, one per line, in the export's field names."""
    stack = (
        F.col("stack_trace")
        if "stack_trace" in events.columns
        else F.array().cast("array<string>")
    )
    members = [
        _json_member("type", F.col("type")),
        _json_member("timestamp", F.unix_millis(F.col("ts").cast("timestamp"))),
        _json_member("location", F.col("location")),
        _details_member(F.col("details")),
        _json_member("stackTrace", stack),
    ]
    members += [_json_member(name, F.col(name)) for name in ("id", "seq") if name in events.columns]
    line = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    events.select(line.alias("value")).write.text(path)
