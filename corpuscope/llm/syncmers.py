"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer of code points is an anchor when the least hash among its inner substrings is
that of its first or last one. That depends on nothing outside the k-mer, so a passage
has the same anchors wherever it stands. A text's fingerprint is its least anchor hashes;
two fingerprints are compared as bottom-k samples of the two anchor sets.

Defined results: a null text is an empty one, with an empty fingerprint; a text without
an anchor (shorter than a k-mer, or a single one that is none) has the hash of the whole
text instead; two empty fingerprints have likeness 1, an empty and another 0; null ids
come last in the order of documents; repeated rows are documents of their own; other
columns are ignored; an empty table gives an empty result. A text is handled in one row: some 40 bytes a code point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.arrays import let
from corpuscope.llm.common import bucketed
from corpuscope.session import materialize

INNER = 8
# Inner substrings in a k-mer; the first and the last one cover the k-mer between them.
INNERS = 8
K = INNER + INNERS - 1
KEPT = 64


def placed_anchors(text: Column) -> Column:
    """struct(places, hashes): where a text's closed syncmers start (from 0, rising), and
    their 32-bit hashes."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{INNER}}}))."), F.lit(1))

    def found(h: Column) -> Column:
        # Straight from the hashes: arrays of window minima cost more to build than they save.
        def closed(i: Column) -> Column:
            ends = F.least(F.get(h, i), F.get(h, i + (INNERS - 1)))
            return ends <= F.least(*[F.get(h, i + k) for k in range(1, INNERS - 1)])

        places = F.filter(F.sequence(F.lit(0), F.size(h) - INNERS), closed)

        def hashed(i: Column) -> Column:
            return F.shiftrightunsigned(F.xxhash64(F.get(h, i), F.get(h, i + (INNERS - 1))), 32)

        return let(places, lambda p: F.struct(p.alias("places"), F.transform(p, hashed).alias("hashes")))

    none = F.struct(F.array().cast("array<int>").alias("places"), F.array().cast("array<bigint>").alias("hashes"))
    hashes = F.transform(pieces, lambda p: F.xxhash64(p))
    return let(hashes, lambda h: F.when(F.size(h) >= INNERS, found(h)).otherwise(none))


def anchors(text: Column) -> Column:
    """Sorted distinct hashes of a text's closed syncmers."""
    return F.sort_array(F.array_distinct(placed_anchors(text)["hashes"]))


def sketch(hashes: Column, text: Column, kept: int = KEPT) -> Column:
    """The least of a text's anchor hashes; of a text without any, its own hash."""
    whole = F.when(F.length(text) > 0, F.array(F.shiftrightunsigned(F.xxhash64(text), 32)))
    none = F.array().cast("array<bigint>")
    # ``array_sort`` would call an interpreted comparator for every comparison.
    least = F.slice(F.sort_array(F.array_distinct(hashes)), 1, kept)
    return F.when(F.size(hashes) > 0, least).otherwise(F.coalesce(whole, none))


def as_string(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column, kept: int = KEPT) -> Column:
    """Share of the anchors common to both, among the least of their union."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, kept)
    share = let(union, lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(share)


def neighbours(rows: DataFrame) -> DataFrame:
    """(row, next_row) in the order of descending id, the last followed by the first.

    Rows (row, id) are range-partitioned; the running id is then increasing over the
    whole order, and only one row per partition meets in a window.
    """
    ordered = rows.repartitionByRange(F.desc_nulls_last("id"), "row").sortWithinPartitions(F.desc_nulls_last("id"), "row")
    placed = ordered.select("row", F.monotonically_increasing_id().alias("pos"))
    placed = materialize(placed.withColumn("part", F.shiftright("pos", 33)), "syncmer-order")
    parts = placed.groupBy("part").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    following = F.lead("first").over(Window.orderBy("part"))
    parts = parts.withColumn("then", F.coalesce(following, F.first("first").over(Window.orderBy("part"))))
    seams = parts.select(F.col("last").alias("pos"), "then")
    after = placed.join(F.broadcast(seams), "pos", "left")  # one row per partition
    after = after.select("row", F.coalesce("then", F.col("pos") + 1).alias("pos"))
    return after.join(placed.select("pos", F.col("row").alias("next_row")), "pos").select("row", "next_row")


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, next_row, text, edited): each text, and its edited form.

    Its last third (rounded down) is replaced by as many first code points of the next
    text. Texts are written once, bucketed by row; only the borrowed parts are shuffled.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    texts = bucketed(rows, "row", "syncmer_texts")
    order = materialize(neighbours(texts.select("row", "id")), "syncmer-next")
    lent = texts.select("row", F.floor(F.col("n_chars") / 3).cast("int").alias("lent")).join(order, "row")
    lent = lent.select(F.col("next_row").alias("row"), F.col("row").alias("to"), "lent")
    heads = texts.select("row", "text").join(lent, "row").select(F.col("to").alias("row"), F.expr("left(text, lent)").alias("head"))
    own = texts.join(order, "row").join(heads, "row")
    stays = F.expr("left(text, cast(n_chars - floor(n_chars / 3) as int))")
    return own.select("id", "row", "next_row", "n_chars", "text", F.concat(stays, "head").alias("edited"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    pairs = edited_pairs(docs, id_col, text_col)
    # Anchors know no context: those of the edited text are the ones that start early
    # enough in the text to lie before the cut, and those of what stands from just
    # before the cut on. Only that part is read again.
    stays = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    tail = F.col("edited").substr(F.greatest(F.lit(1), stays - (K - 2)).cast("int"), F.length("edited"))
    made = pairs.select(
        "id", "row", "next_row", "n_chars", "text", "edited", stays.alias("stays"),
        placed_anchors(F.col("text")).alias("own"), placed_anchors(tail)["hashes"].alias("tail"),
    )
    before = F.size(F.filter(F.col("own.places"), lambda i: i + K <= F.col("stays")))
    edited = F.concat(F.slice(F.col("own.hashes"), F.lit(1), before), F.col("tail"))
    made = made.select(
        "id", "row", "next_row", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        sketch(F.col("own.hashes"), F.col("text")).alias("sketch"),
        sketch(edited, F.col("edited")).alias("edited_sketch"),
    )
    made = materialize(made, "syncmer-sketches")
    others = made.select(F.col("row").alias("next_row"), F.col("sketch").alias("next_sketch"))
    out = made.join(others, "next_row")
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
