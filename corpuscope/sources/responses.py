"""The cache of stored answers, keyed by content."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.schemas import RESPONSES
from corpuscope.sources import versions
from corpuscope.sources.folders import local_path


def read_response_cache(spark: SparkSession, folder: str) -> DataFrame:
    """``cache_key, prompt, response`` from a folder of ``<key>.json`` files.

    A file whose response is no text counts as a miss.
    """
    raw = spark.read.schema("prompt string, response string").json(folder, multiLine=True)
    key = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return raw.where(F.col("response").isNotNull()).select(
        key.alias("cache_key"), "prompt", "response"
    )


def write_response_files(responses: DataFrame, folder: str) -> int:
    """Writes each answer as ``<cache_key>.json`` in a folder that every executor sees,
    the layout that :func:`read_response_cache` reads; returns how many.

    A file is written aside and renamed, so an answer is there as a whole or not at all,
    and a task that runs again writes the same files.
    """
    rows = responses.select("cache_key", "prompt", "response").where(F.col("cache_key").isNotNull())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        n = 0
        for batch in batches:
            for row in batch.to_pylist():
                aside = os.path.join(folder, f".{row['cache_key']}.{uuid.uuid4().hex}")
                with open(aside, "w", encoding="utf-8") as file:
                    json.dump({"prompt": row["prompt"], "response": row["response"]}, file, ensure_ascii=False)
                os.replace(aside, os.path.join(folder, f"{row['cache_key']}.json"))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    local = local_path(folder)
    if local is None:
        raise ValueError("answers are written as files to a shared path; use append_response_cache elsewhere")
    folder = local
    os.makedirs(folder, exist_ok=True)
    return rows.mapInArrow(write, "n long").agg(F.sum("n")).head()[0] or 0


def read_response_table(spark: SparkSession, path: str) -> DataFrame:
    """``cache_key, prompt, response`` of a table of answers; a plain Parquet folder will
    do, too."""
    number, what = versions.current(spark, path)
    return versions.read_folders(spark, path, what["folders"], RESPONSES) if number else spark.read.schema(RESPONSES).parquet(path)


def append_response_cache(responses: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Appends one answer per key that the table at ``path`` (and ``existing``) lacks.

    Of several answers to a key the least one counts. Writers may append at once: the one
    that comes second leaves out what the first has added, so a key is never stored twice.
    """
    spark = responses.sparkSession
    answer = F.min(F.struct("response", "prompt")).alias("a")
    fresh = responses.groupBy("cache_key").agg(answer).select("cache_key", "a.prompt", "a.response")
    if existing is not None:
        fresh = fresh.join(existing.select("cache_key"), "cache_key", "left_anti")
    seen: list[str] = []
    while True:
        number, what = versions.current(spark, path)
        folders = what.get("folders", [])
        added = versions.read_folders(spark, path, [f for f in folders if f not in seen], RESPONSES)
        name = versions.new_folder()
        target = f"{path.rstrip('/')}/{name}"
        fresh.join(added.select("cache_key"), "cache_key", "left_anti").write.parquet(target)
        try:
            versions.commit(spark, path, number + 1, {"folders": [*folders, name]})
            return
        except versions.Taken:
            # What is left of ours goes on from the table as it is now.
            fresh, seen = spark.read.schema(RESPONSES).parquet(target), folders
