"""Mixing sources to target weights by exact budgets of words.

Each row gets a hash-random key; rows are sorted by key within their source, a
distributed prefix sum of word counts gives every row its place, and the source's
budget cuts the order at one exact word. A budget above the source's size takes whole
epochs first. The sort is cut into blocks (ranges of the key) of about equal row
count, so that a source with a third of all rows is many blocks, and only block sums
meet in one window.

Defined results: a null text has size 0 and takes nothing; a null source is a source
of its own, the last; sources without words have budget 0; repeated rows count each;
other columns are ignored; an empty table gives an empty result. Reruns over the same rows agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.common import WORD, fold_blocks, hash_block
from corpuscope.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
BLOCK_ROWS = 1_000
SEED = "mix"
# Sources whose ends are sent to every task; more are joined.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def budgets(
    sources: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
) -> DataFrame:
    """Adds ``rank`` and ``target`` to one row per source (source, source_size, n_rows).

    Sources weigh ``weights`` in turn by code point, null last. Together they get
    ``share`` of all words, none more than ``max_epochs`` times its own; what a capped
    source leaves goes to the others by weight. That is one water level: with sources
    ordered by cap per weight, a source is capped as long as the level that the ones
    before it leave is at or above its own ratio.
    """
    # One row per source meets here, whatever the number of documents.
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    left = left.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    is_capped = F.col("level") * F.col("weight") >= F.col("cap")
    # The first source that is not capped sets the level for it and all after it.
    place = F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "rank", "level")
    first = F.min(F.when(~is_capped, place)).over(everything)
    behind = (F.col("cap") / F.col("weight") > first["ratio"]) | (
        (F.col("cap") / F.col("weight") == first["ratio"]) & (F.col("rank") >= first["rank"])
    )
    target = F.when(behind, F.least(F.col("cap"), first["level"] * F.col("weight"))).otherwise(F.col("cap"))
    return left.withColumn("target", target).select("source", "source_size", "n_rows", "rank", "target")


def _random_key(id_: Column, seed: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(id_.cast("string"), F.lit(""))), 256)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
    seed: str = SEED,
    block_rows: int = BLOCK_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
    row_col: str | None = None,
) -> DataFrame:
    """(id, source, size, source_size, target, epochs, part, taken) of every row.

    ``epochs`` whole passes and the first ``part`` words of one more are taken. With
    ``row_col``, a column that numbers the rows, ties are in its order, and ``place``
    tells where each row stands in its source's order, for :func:`take`.
    """
    key = _random_key(F.col(id_col), seed)
    tie = F.col(row_col) if row_col else F.lit(0).cast("long")
    thin = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"),
        key.alias("key"), tie.alias("tie"), *[F.col(c).alias(f"__keep_{c}") for c in keep],
    )
    thin = materialize(thin, "mix-sizes")
    sums = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    plan = budgets(sums, weights, share, max_epochs)
    # A hot source is split by Spark's skew handling: both sides are plain exchanges.
    rows = thin.join(plan.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    top = F.conv(F.substring("key", 1, 15), 16, 10).cast("long")
    hash64 = F.shiftleft(top, 4).bitwiseXOR(F.lit(-(2**63)))
    rows = rows.withColumn("block", hash_block(hash64, fold_blocks(F.col("n_rows"), block_rows)))
    rows = rows.drop("__source")
    blocks = rows.groupBy("rank", "block").agg(F.sum("size").alias("block_size"))
    earlier = Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("rank", "block", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("block_start"))
    inside = Window.partitionBy("rank", "block").orderBy("key", "id", "size", "tie")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(starts, ["rank", "block"])
    start = F.col("block_start") + F.col("upto") - F.col("size")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        epochs.cast("long").alias("epochs"), part.cast("long").alias("part"),
        (epochs * F.col("size") + part).cast("long").alias("taken"), *[F.col(f"__keep_{c}").alias(c) for c in keep],
        *([F.struct("key", "id", "size", "tie").alias("place")] if row_col else []),
    )


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its first ``words`` words (a column, at least 1)."""
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    lead = F.length(text) - F.length(trimmed)
    pieces = F.split(trimmed, F.lit(r"[\x20\x09-\x0D]+"), (words + 1).cast("int"))
    rest = F.when(F.size(pieces) > words, F.length(F.element_at(pieces, -1))).otherwise(0)
    upto = text.substr(F.lit(1), lead + F.length(trimmed) - rest)
    return F.regexp_replace(upto, r"[\x20\x09-\x0D]+$", "")


def take(
    docs: DataFrame,
    mixed: DataFrame,
    row: str,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed rows themselves: whole copies, and the boundary row's first words.

    ``mixed`` is :func:`mix` of ``docs`` with ``row_col=row``. What a row gives follows
    from its place in its source's order and from where the source's budget ends, one
    place per source; so texts stay where they are.
    """
    at = F.when(F.col("part") > 0, F.struct("place", "part"))
    cuts = mixed.groupBy(F.col(source_col).alias("__source")).agg(F.max("epochs").alias("__epochs"), F.max(at).alias("__cut"))
    cuts = materialize(cuts, "mix-cuts")
    if cuts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    size = n_words(F.col(text_col))
    place = F.struct(_random_key(F.col(id_col), seed).alias("key"), F.col(id_col).alias("id"), size.alias("size"), F.col(row).alias("tie"))
    joined = docs.withColumn("__place", place).join(cuts, F.col(source_col).eqNullSafe(F.col("__source")))
    whole = F.array_repeat(F.lit(-1).cast("long"), F.col("__epochs").cast("int"))
    # All words of a row are the row itself, with its white space.
    words, end = F.col("__place.size"), F.col("__cut.place")
    part = F.when(F.col("__place") < end, words).when(F.col("__place") == end, F.col("__cut.part")).otherwise(F.lit(0).cast("long"))
    part = F.when(F.coalesce(part, F.lit(0)) < words, F.coalesce(part, F.lit(0))).otherwise(F.when(words > 0, F.lit(-1)).otherwise(F.lit(0)))
    tail = F.when(part != 0, F.array(part.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    rows = joined.withColumn("__words", F.explode(F.concat(whole, tail)))
    text = F.when(F.col("__words") < 0, F.col(text_col)).otherwise(first_words(F.col(text_col), F.col("__words")))
    return rows.withColumn(text_col, text).drop("__words", "__epochs", "__cut", "__source", "__place", row)
