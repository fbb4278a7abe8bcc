"""K-d tree sharding: split at weighted medians until leaves reach the target bytes.

Every node is split along its widest metadata dimension, at the value where the bytes
below it match the leaves to go there. Values are refined by counting bytes in bins,
all nodes of a level at once: one aggregation per round, one row per node back to the
driver. Where a single value spans the median (a source with a third of all rows, say)
the cut goes through it by a hash of the row. Only native functions.

Defined results: a null text counts 8 bytes (the row's overhead); null metadata sort
first; repeated rows are rows of their own; columns that are no dimension are ignored;
with fewer rows than leaves some shards stay empty; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.llm.common import fold_blocks, hash_block
from corpuscope.session import materialize

BINS = 4096
BLOCK_ROWS = 1_000
# A cut is taken as exact once the bin that holds it has at most this share of a leaf.
TOLERANCE = 1e-3
ROW_BYTES = 8
_TIE = "__tie"
_TIE_BITS = 48


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long")


def coordinate(column: Column, kind: T.DataType) -> Column:
    """A non-negative long that keeps the order of a value; null is 0.

    Strings count by their first six bytes: enough to spread a column, and rows that
    agree there are told apart by the row hash.
    """
    if isinstance(kind, T.StringType):
        lead = F.rpad(F.substring(F.hex(F.encode(column, "utf-8")), 1, 12), 12, "0")
        value = F.conv(lead, 16, 10).cast("long") + 1
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        value = F.unix_micros(column.cast("timestamp")) + F.lit(2**61)
    else:
        # Beyond 2^60 either way numbers share an end of the range; the row hash tells
        # them apart. Fractions count by their whole part.
        ends = (F.lit(-(2**60)), F.lit(2**60))
        value = F.greatest(ends[0], F.least(ends[1], F.floor(column).cast("long"))) + F.lit(2**61)
    return F.when(column.isNull(), F.lit(0)).otherwise(value).cast("long")


class _Node:
    """One node of a level: its leaves, its dimension, and the range that holds its cut."""

    def __init__(self, first: int, leaves: int):
        self.first, self.leaves = first, leaves
        self.dim = self.of = _TIE
        self.low = self.high = 0
        self.below = 0  # bytes of the node's rows before ``low``
        self.want = 0.0  # bytes wanted on the left side
        self.value: int | None = None  # the single value that the cut goes through
        self.done = False

    @property
    def right(self) -> int:
        """The first leaf of the right child."""
        return self.first + -(-self.leaves // 2)

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BINS))


def _told(placed: DataFrame, nodes: list[_Node], columns: list[str], how: str) -> DataFrame:
    """Rows with what their node decided. One row per node is broadcast, at most as many
    as there are leaves."""
    every = [*columns, _TIE]
    rows = ", ".join(
        f"({n.first}, {every.index(n.dim) + 1}, {n.low}L, {n.high}L, {n.width}L, {float(n.want - n.below)!r}D,"
        f" {every.index(n.of) + 1}, {'NULL' if n.value is None else f'{n.value}L'}, {n.right})"
        for n in nodes
    )
    names = "node, dim, low, high, step, need, of, value, right"
    told = placed.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t({names})")
    told = told.withColumn("value", F.col("value").cast("long"))
    joined = placed.join(F.broadcast(told), "node", how)
    pick = F.array(*[F.col(c) for c in every])
    return joined.withColumn("at", F.element_at(pick, F.col("dim"))).withColumn("in", F.element_at(pick, F.col("of")))


def shards(
    docs: DataFrame,
    n_leaves: int | None = None,
    target_bytes: int | None = None,
    dims: Sequence[str] = ("lang", "source", "n_chars", "doc_id"),
    id_col: str = "doc_id",
    text_col: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row.

    Give the number of leaves, or the bytes a leaf should reach. ``slot`` counts the
    rows of a shard from 0 without gaps.
    """
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    thin = docs.select(
        F.col(id_col).alias("id"),
        text_bytes(F.col(text_col)).alias("size"),
        F.crc32(F.col(text_col).cast("binary")).alias("crc"),
        F.monotonically_increasing_id().alias("row"),
        *[coordinate(F.col(d), kinds[d]).alias(f"d{i}") for i, d in enumerate(dims)],
    )
    spread = F.xxhash64("id", "crc", "size", "row")
    thin = thin.withColumn(_TIE, F.shiftrightunsigned(spread, 64 - _TIE_BITS)).withColumn("spread", spread)
    placed = thin = materialize(thin.withColumn("node", F.lit(0)), "kd-rows")
    columns = [f"d{i}" for i in range(len(dims))]
    total = thin.agg(F.sum("size")).head()[0] or 0
    if n_leaves is None:
        if not target_bytes:
            raise ValueError("give n_leaves or target_bytes")
        n_leaves = max(1, -(-total // target_bytes))
    level = [_Node(0, n_leaves)]
    whole: dict[str, float] = {}
    while any(n.leaves > 1 for n in level):
        nodes = [n for n in level if n.leaves > 1]
        _widest(placed, nodes, columns, whole)
        while any(not n.done for n in nodes):
            _refine(placed, [n for n in nodes if not n.done], columns, total / n_leaves)
        placed = _split(placed, nodes, columns)
        halves = [(_Node(n.first, n.right - n.first), _Node(n.right, n.first + n.leaves - n.right)) for n in nodes]
        level = [n for n in level if n.leaves == 1] + [half for both in halves for half in both]
    return _slots(placed, block_rows).select(
        F.col("id").alias(id_col), "size", F.coalesce("crc", F.crc32(F.lit("").cast("binary"))).alias("text_crc32"),
        F.col("node").cast("int").alias("shard"), "slot",
    )


def _widest(placed: DataFrame, nodes: list[_Node], columns: list[str], whole: dict[str, float]) -> None:
    """Bytes and range of each node; its dimension is the one widest against the root's."""
    ranges = [f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))]
    stats = placed.groupBy("node").agg(F.sum("size").alias("bytes"), *ranges)
    rows = {r["node"]: r for r in stats.collect()}  # one row per node
    for node in nodes:
        r = rows.get(node.first)
        if r is None:
            node.done = True  # no rows: nothing to cut
            continue
        extents = {c: float(r[f"hi_{c}"] - r[f"lo_{c}"]) for c in columns}
        if not whole:
            whole.update(extents)
        shares = {c: extents[c] / whole[c] for c in columns if whole[c] > 0 and extents[c] > 0}
        node.want = r["bytes"] * (-(-node.leaves // 2)) / node.leaves
        if shares:
            node.dim = max(shares, key=shares.get)
            node.low, node.high = r[f"lo_{node.dim}"], r[f"hi_{node.dim}"]
        else:
            node.low, node.high = 0, 2**_TIE_BITS - 1


def _refine(placed: DataFrame, nodes: list[_Node], columns: list[str], leaf: float) -> None:
    """One round: bytes per bin of each node's range, and the bin that holds its cut."""
    rows = _told(placed, nodes, columns, "inner")
    rows = rows.where(F.col("at").between(F.col("low"), F.col("high")))
    rows = rows.where(F.col("value").isNull() | (F.col("in") == F.col("value")))
    # Whole-number division: a division of longs by "/" would go through doubles.
    rows = rows.select("node", "size", "need", F.expr("(at - low) div step").alias("bin"))
    bins = rows.groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.first("need").alias("need"))
    upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = bins.withColumn("upto", F.sum("bytes").over(upto)).groupBy("node").agg(
        F.min(F.when(F.col("upto") >= F.col("need"), F.struct("bin", "upto", "bytes"))).alias("cut"),
        F.max(F.struct("bin", "upto", "bytes")).alias("last"),
    )
    cuts = {r["node"]: r["cut"] or r["last"] for r in found.collect()}  # one row per node
    for node in nodes:
        cut = cuts[node.first]
        node.below += cut["upto"] - cut["bytes"]
        low, width = node.low + cut["bin"] * node.width, node.width
        node.low, node.high = low, min(node.high, low + width - 1)
        if cut["bytes"] <= TOLERANCE * leaf:
            node.done = True
        elif node.low == node.high and node.dim != _TIE:
            # One value holds the cut: go on inside it, by the rows' hash.
            node.value, node.of, node.dim = node.low, node.dim, _TIE
            node.low, node.high = 0, 2**_TIE_BITS - 1
        elif node.low == node.high:
            node.done = True


def _split(placed: DataFrame, nodes: list[_Node], columns: list[str]) -> DataFrame:
    """Rows go to the left child up to the cut's bin, else to the right one."""
    rows = _told(placed, nodes, columns, "left")
    left = F.when(F.col("value").isNull(), F.col("at") <= F.col("high")).otherwise(
        (F.col("in") < F.col("value")) | ((F.col("in") == F.col("value")) & (F.col("at") <= F.col("high")))
    )
    node = F.when(F.col("right").isNull() | left, F.col("node")).otherwise(F.col("right"))
    return rows.withColumn("node", node).select(*placed.columns)


def _slots(placed: DataFrame, block_rows: int) -> DataFrame:
    """Adds the place in the shard: rows are numbered in blocks of hash ranges, and
    blocks start where the earlier ones end."""
    sizes = placed.groupBy("node").agg(F.count("*").alias("n"))
    blocked = placed.join(F.broadcast(sizes), "node")  # one row per shard
    blocked = blocked.withColumn("block", hash_block(F.col("spread"), fold_blocks(F.col("n"), block_rows)))
    counts = blocked.groupBy("node", "block").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("node", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("node", "block").orderBy("spread", "row")
    numbered = blocked.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["node", "block"]).withColumn("slot", (F.col("start") + F.col("place")).cast("long"))
