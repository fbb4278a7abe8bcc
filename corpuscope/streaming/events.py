"""Runtime events as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from corpuscope.operators.events import latest_events
from corpuscope.rules import MAX_EVENTS
from corpuscope.session import run_dir
from corpuscope.sources import versions


def stream_event_counts(stream: DataFrame) -> DataFrame:
    """``type, location, n``: counts over everything logged so far.

    State holds one row per (type, location); partial counts are taken before
    the shuffle, so a hot location costs its reducer one row per task.
    """
    return stream.groupBy("type", "location").agg(F.count("*").alias("n"))


def keep_latest(folder: str, n: int = MAX_EVENTS, key: str | None = "type") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the table in ``folder`` holds the last ``n`` events of
    every ``key`` of all batches so far, and nothing else.

    A batch is first cut to its own last n, where it lies; those few rows and the table
    make the next version of the table, which replaces it in one commit. The commit
    carries the batch's number, so a batch that is run again after a failure changes
    nothing. The state of the stream is the table itself: n rows per key, however long the
    stream has run.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done, what = versions.current(spark, folder)
        if done and what["batch"] >= number:
            return
        latest = latest_events(batch, n, key)
        if done:
            before = versions.read_folders(spark, folder, [what["folder"]], batch.schema)
            latest = latest_events(before.unionByName(latest), n, key)
        name = versions.new_folder()
        latest.write.parquet(f"{folder.rstrip('/')}/{name}")
        versions.commit(spark, folder, done + 1, {"folder": name, "batch": number, "before": what.get("folder")})
        if what.get("before"):
            versions.drop_folder(spark, folder, what["before"])

    return merge


def retain_latest(
    stream: DataFrame, folder: str, checkpoint: str, n: int = MAX_EVENTS, key: str | None = "type"
) -> DataStreamWriter:
    """The writer, to be started, that keeps the last ``n`` events of every ``key`` of a
    stream as a table in ``folder``; read it by :func:`read_latest`."""
    return stream.writeStream.foreachBatch(keep_latest(folder, n, key)).option("checkpointLocation", checkpoint)


def read_latest(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The retained events as of the last batch; none before the first."""
    _, what = versions.current(spark, folder)
    return versions.read_folders(spark, folder, [what["folder"]] if what else [], schema)


def drain_latest(stream: DataFrame, n: int, key: str | None, name: str) -> DataFrame:
    """Retention over all available input, and its result."""
    folder, checkpoint = run_dir(stream.sparkSession, name), run_dir(stream.sparkSession, f"{name}-progress")
    retain_latest(stream, folder, checkpoint, n, key).trigger(availableNow=True).start().awaitTermination()
    return read_latest(stream.sparkSession, folder, stream.schema)


def drain_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a streaming query over all available input and read its result.

    ``complete`` rewrites the result table per batch, ``append`` adds to it.
    """
    spark = stream.sparkSession
    target, checkpoint = run_dir(spark, name), run_dir(spark, f"{name}-progress")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", target).outputMode("append")
    else:
        writer = stream.writeStream.foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(target)
        ).outputMode(mode)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def read_event_stream(spark: SparkSession, schema: T.StructType, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a file stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
