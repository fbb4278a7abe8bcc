"""Work queue for file descriptions: what is done, cached, or still to ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.metrics import content_key
from corpuscope.functions.paths import relative_path
from corpuscope.functions.text import first_markdown_section
from corpuscope.operators.graph import dependency_list
from corpuscope.operators.in_place import ROW, choose, store, without_numbers
from corpuscope.operators.joins import hot_split_join
from corpuscope.operators.tokens import dependency_structs, with_tokens
from corpuscope.session import materialize

PROMPT_HEAD = (
    "Describe the source file below for a code audit. Cover its purpose, inputs and outputs, "
    "dependencies, side effects, main logic and structure.\n\n```ts\n"
)
PROMPT_TAIL = "\n```"


# Paths of finished files that are sent to every task; more are looked up in place.
BROADCAST_PATHS = 1_000_000


def pending_files(files: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Files without a non-empty document in ``done(path, size)``; all when forced.

    Contents are not shuffled: a short list of finished paths goes to the files, for a
    longer one the files are stored and chosen in place.
    """
    if force:
        return files
    finished = materialize(done.where(F.col("size") > 0).select("path").distinct(), "finished")
    if finished.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS:
        return files.join(F.broadcast(finished), "path", "left_anti")
    stored = store(files, "files")
    left = stored.select(ROW, "path").join(finished, "path", "left_anti")
    return without_numbers(choose(stored, left))


def prompt_for(content: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), content, F.lit(PROMPT_TAIL))


def with_content_key(files: DataFrame) -> DataFrame:
    return files.withColumn("cache_key", content_key(F.col("content")))


def cached_responses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """``path, cache_key, response``: the stored answer of each file that has one.

    The keys are taken in one pass over the contents and stored. Copies of one
    text share a key, so a key may be hot on the file side; answers are wide, so
    only those of hot keys are repeated.
    """
    rows = materialize(keyed.select("path", "cache_key"), "content-keys")
    answers = cache.select("cache_key", "response").dropDuplicates(["cache_key"])
    return hot_split_join(rows, answers, "cache_key", ["path"], "inner").select(
        "path", "cache_key", "response"
    )


def cached_sections(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """``path, cache_key, section``: stored answers cut to their first section."""
    return cached_responses(keyed, cache).select(
        "path", "cache_key", first_markdown_section(F.col("response")).alias("section")
    )


def first_markdown_sections(responses: DataFrame) -> DataFrame:
    """``cache_key, section``."""
    return responses.select(
        "cache_key", first_markdown_section(F.col("response")).alias("section")
    )


def _with_status(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``status`` to stored rows with ``seq``, ``path`` and ``cache_key``.

    Rows without a walk order choose their first file by a digest of the path.
    """
    order = F.coalesce(F.col("seq"), F.xxhash64("path"))
    firsts = rows.groupBy("cache_key").agg(F.min(order).alias("first_seq"))
    known = cache.select("cache_key", F.lit(True).alias("known")).distinct()
    keys = firsts.join(known, "cache_key", "left")
    status = (
        F.when(F.col("known"), "cached")
        .when(order == F.col("first_seq"), "pending")
        .otherwise("shared")
    )
    joined = hot_split_join(rows, keys, "cache_key", ["path"], "inner")
    return joined.withColumn("status", status).drop("first_seq", "known")


def documentation_status(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``path, cache_key, status``; contents are read once and never shuffled.

    cached   a stored answer exists
    pending  the first file (by ``seq``) of a text nobody has described yet
    shared   a copy of a pending file's text
    """
    rows = materialize(with_content_key(files).select("seq", "path", "cache_key"), "content-keys")
    return _with_status(rows, cache).select("path", "cache_key", "status")


def documentation_worklist(files: DataFrame, cache: DataFrame, root: str = "/") -> DataFrame:
    """``rel, cache_key, prompt, deps, status``.

    Only pending rows carry a prompt: equal texts are one unit of work. Contents are
    lexed, keyed and stored in one pass; of what follows only keys and bitmaps are
    shuffled, on a first run, too, when nearly every file is pending.
    """
    deps = F.array_distinct(F.transform(dependency_structs("toks"), lambda d: d.specifier))
    stored = store(
        with_tokens(files).select(
            "seq",
            "path",
            relative_path(F.col("path"), root).alias("rel"),
            content_key(F.col("content")).alias("cache_key"),
            dependency_list(deps).alias("deps"),
            "content",
        ),
        "worklist",
    )
    status = materialize(_with_status(stored.select(ROW, "seq", "path", "cache_key"), cache), "worklist-status")
    pending = choose(stored, status.where(F.col("status") == "pending"))
    asked = pending.select(
        "rel", "cache_key", prompt_for(F.col("content")).alias("prompt"), "deps", F.lit("pending").alias("status")
    )
    none = F.lit(None).cast("string").alias("prompt")
    rest = [
        choose(stored, status.where(F.col("status") == s)).select("rel", "cache_key", none, "deps", F.lit(s).alias("status"))
        for s in ("cached", "shared")
    ]
    return asked.unionByName(rest[0]).unionByName(rest[1])
