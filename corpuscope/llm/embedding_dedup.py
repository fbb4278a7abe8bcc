"""Embedding near-duplicates by sorted projection passes.

Each pass draws random hyperplanes; the sides of a vector are the bits of a key, and
vectors are sorted by it. Every vector is compared with its ``window`` neighbours behind
it, over the borders of tasks, too. Vectors on the same sides of the first planes, the
prefix, stand together: a run of them no longer than the window is compared as a whole
by that, and in a run more crowded than the window all pairs are compared block against
block, in many tasks. So the recall holds for any data: a pair at the threshold shares
the prefix of a pass with a chance that its angle and the number of planes alone give,
and the number of passes follows from that chance. How many planes make the prefix
follows from the cost of the runs they would make of all the rows; where planes do not
separate the vectors, that is none, and one pass compares all pairs. Linked pairs are
united across passes. Equal vectors are one class.

Inside a component all members are then compared exactly, block against block, so link
counts miss nothing there, however many near copies it has; pairs leave no task.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different length do not link; null ids keep
their row; repeated rows are copies of each other; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.llm.components import components
from corpuscope.llm.jaccard_join import by_group
from corpuscope.session import materialize

COSINE = 0.95
TARGET_RECALL = 0.9999
# Neighbours that a vector is compared with in a pass. Runs are not cut to fewer vectors
# than half of this, on average.
WINDOW = 48
# Vectors of a block, in the sorted order and of a crowded run, and of a component.
BLOCK = 512
LINK_BLOCK = 4096
# Planes behind the prefix that put like vectors of a run next to each other.
ORDER_BITS = 16
# Passes whose cells are counted, over all rows, to choose the number of planes.
COUNTED = 2
# Bits of a key at most, and signs computed at once in a worker.
KEY_BITS = 62
SIGNS_AT_ONCE = 1 << 22


def passes_needed(bits: int, cosine: float, target: float) -> int:
    """Passes of cells of ``bits`` planes after which a pair at the threshold has met
    with the target probability."""
    meets = (1.0 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return 1 if meets >= target else math.ceil(math.log(1.0 - target) / math.log1p(-meets))


def unit_vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors of length one in double precision; None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for value in column:
        if not value.is_valid or len(value.values) == 0 or value.values.null_count:
            out.append(None)
            continue
        vector = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(vector).max()
        if not np.isfinite(top) or top == 0.0:
            out.append(None)
            continue
        vector = vector / top  # so that squares neither vanish nor overflow
        out.append(vector / np.sqrt(np.dot(vector, vector)) + 0.0)
    return out


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    target_recall: float = TARGET_RECALL,
    window: int = WINDOW,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    source = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    kind = source.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            units = unit_vectors(part.column(2))
            packed = pa.array([None if u is None else u.tobytes() for u in units], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed], ["row", "id", "unit"])

    packed = source.mapInArrow(pack, f"row long, id {kind}, unit binary")
    rows = materialize(packed.withColumn("digest", F.sha2("unit", 256)), "embed-rows")
    classes = rows.where(F.col("unit").isNotNull()).groupBy("digest").agg(
        F.min("row").alias("rep"), F.count("*").alias("n"), F.min_by("unit", "row").alias("unit")
    )
    classes = materialize(classes, "embed-classes")
    most = min(KEY_BITS, max(0, math.ceil(math.log2(max(classes.count(), 1) / window))))
    bits = _cheapest_bits(classes, most, cosine, target_recall)
    passes = passes_needed(bits, cosine, target_recall)
    keys = materialize(_cells(classes, passes, min(KEY_BITS, bits + ORDER_BITS)), "embed-keys")
    shift = min(KEY_BITS, bits + ORDER_BITS) - bits
    near = _window_links(keys, classes, cosine, window)
    crowded = _crowded_links(keys, shift, classes, cosine, window)
    edges = materialize(near.unionByName(crowded).distinct(), "embed-edges")
    roots = components(edges)
    links = _links(classes.join(roots.withColumnRenamed("node", "rep"), "rep"), cosine)

    reps = classes.select("digest", "rep", "n").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.join(links, "rep", "left")
    joined = rows.select("row", "id", "digest").join(reps, "digest", "left").select(
        "row", "id", F.coalesce("root", "rep", "row").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_links"),
    )
    joined = materialize(joined, "embed-joined")
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    out = joined.join(least, "root")
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def _cells(classes: DataFrame, passes: int, bits: int) -> DataFrame:
    """(rep, pass, dim, key): the sides of a pass's planes that each vector lies on."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        at_once = max(1, SIGNS_AT_ONCE // max(1, passes * bits))
        for whole in batches:
            for low in range(0, len(whole), at_once):
                part = whole.slice(low, at_once)
                reps, units = part.column(0).to_numpy(), part.column(1)
                size = np.array([len(u) // 8 for u in units.to_pylist()])
                for dim in np.unique(size).tolist():
                    at = np.flatnonzero(size == dim)
                    matrix = np.frombuffer(b"".join(units.take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), dim)
                    if dim not in planes:
                        drawn = [np.random.default_rng([p, dim]).standard_normal((bits, dim)) for p in range(passes)]
                        planes[dim] = np.concatenate(drawn).T
                    signs = (matrix @ planes[dim] > 0).reshape(len(at), passes, bits)
                    columns = [pa.array(np.repeat(reps[at], passes)), pa.array(np.tile(np.arange(passes, dtype=np.int32), len(at)))]
                    columns += [pa.array(np.full(len(at) * passes, dim, np.int32)), pa.array((signs @ weights).ravel())]
                    yield pa.RecordBatch.from_arrays(columns, ["rep", "pass", "dim", "key"])

    return classes.select("rep", "unit").mapInArrow(keys, "rep long, pass int, dim int, key long")


def _cheapest_bits(classes: DataFrame, most: int, cosine: float, target: float) -> int:
    """The number of planes, up to ``most``, with the least cost by the cells that
    they make of all rows. Any number has the same recall."""
    if most == 0:
        return 0
    cells = _cells(classes, COUNTED, most).groupBy("pass", "dim", "key").agg(F.count("*").alias("n"))
    cells = cells.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(most))))
    cells = cells.groupBy("pass", "dim", "bits", F.expr(f"shiftright(key, {most} - bits)").alias("key")).agg(F.sum("n").alias("n"))
    # Each row of a cell is compared with all others, and carried to as many tasks as the
    # cell has blocks; carrying it costs about as much as comparing it with a block.
    carried = F.when(F.col("n") > 1, F.ceil(F.col("n") / F.lit(BLOCK)) * F.lit(BLOCK)).otherwise(F.lit(0))
    cost = F.sum(F.col("n").cast("double") * (F.col("n") + carried)).alias("cost")
    costs = {r.bits: r.cost for r in cells.groupBy("bits").agg(cost).collect()}  # a row per number
    return min(costs, key=lambda b: (costs[b] * passes_needed(b, cosine, target), b), default=0)


def _window_links(keys: DataFrame, classes: DataFrame, cosine: float, window: int) -> DataFrame:
    """(a, b): links between neighbours in the order of each pass's keys."""
    order = ["dim", "pass", "key", "rep"]
    ranked = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = ranked.select("rep", "dim", "pass", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    ranked = materialize(ranked, "embed-sorted")
    # One row per task meets here.
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = ranked.join(parts, "part").withColumn("pos", F.col("base") + F.col("id") - F.col("first"))
    block = F.floor(F.col("pos") / F.lit(BLOCK)).cast("long")
    # A block's first rows are neighbours of the last ones of the blocks before it.
    back = F.floor((F.col("pos") - F.lit(window)) / F.lit(BLOCK)).cast("long")
    placed = placed.withColumn("own", block).withColumn("grp", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), back), block)))
    placed = placed.select("rep", "dim", "pass", "pos", "grp", (F.col("grp") < F.col("own")).alias("late"))
    dealt = placed.join(classes.select("rep", "unit"), "rep").repartition("grp").sortWithinPartitions("grp", "pos")

    def compare(part: pa.Table) -> pa.RecordBatch | None:
        reps, pos, late = part["rep"].to_numpy(), part["pos"].to_numpy(), part["late"].to_numpy()
        run = part["dim"].to_numpy().astype(np.int64) << 32 | part["pass"].to_numpy()
        units = part["unit"].to_pylist()
        union = _Union(len(reps))
        bounds = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(reps)]
        for low, high in zip(bounds[:-1], bounds[1:]):
            matrix = np.frombuffer(b"".join(units[low:high]), np.float64).reshape(high - low, -1)
            for step in range(1, min(window, high - low - 1) + 1):
                near = np.einsum("ij,ij->i", matrix[:-step], matrix[step:]) >= cosine
                # Rows of later blocks are compared with each other there.
                for i in (np.flatnonzero(near & ~late[low : high - step]) + low).tolist():
                    if pos[i + step] - pos[i] <= window:
                        union.join(i, i + step)
        return union.edges(reps)

    return dealt.mapInArrow(by_group("grp", compare), "a long, b long")


def _crowded_links(keys: DataFrame, shift: int, classes: DataFrame, cosine: float, window: int) -> DataFrame:
    """(a, b): links between vectors of a prefix that more than a window of them share."""
    cells = keys.withColumn("key", F.shiftright("key", shift))
    # Sizes aggregate map-side; both sides of the join are plain exchanges.
    sizes = cells.groupBy("pass", "dim", "key").agg(F.count("*").alias("size")).where(F.col("size") > window + 1)
    sizes = sizes.withColumn("blocks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    met = cells.join(sizes, ["pass", "dim", "key"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "rep", F.xxhash64("pass", "dim", "key", F.least("block", "other"), F.greatest("block", "other")).alias("grp"),
        (F.col("block") > F.col("other")).alias("late"), (F.col("block") == F.col("other")).alias("same"),
    )
    dealt = met.join(classes.select("rep", "unit"), "rep").repartition("grp").sortWithinPartitions("grp", "rep")
    return dealt.mapInArrow(by_group("grp", lambda part: _group_links(part, cosine)), "a long, b long")


class _Union:
    """Rows of a group joined by links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, *rows: int) -> None:
        tops = set(map(self.find, rows))
        if len(tops) > 1:
            least = min(tops)
            for top in tops:
                self.root[top] = least

    def edges(self, reps: np.ndarray) -> pa.RecordBatch | None:
        tops = np.array([self.find(i) for i in range(len(reps))], np.int64)
        # The same vector may stand in a group twice, in two passes.
        linked = np.flatnonzero((tops != np.arange(len(reps))) & (reps != reps[tops]))
        if len(linked) == 0:
            return None
        return pa.RecordBatch.from_arrays([pa.array(reps[linked]), pa.array(reps[tops[linked]])], ["a", "b"])


def _group_links(part: pa.Table, cosine: float) -> pa.RecordBatch | None:
    reps, late = part["rep"].to_numpy(), part["late"].to_numpy()
    same, units = part["same"].to_numpy().any(), part["unit"].to_pylist()
    union = _Union(len(reps))
    # One length only, but for two cells of one hash.
    size = np.array([len(u) for u in units])
    for length in np.unique(size).tolist():
        mine = size == length
        first = np.flatnonzero(mine if same else mine & ~late)
        second = first if same else np.flatnonzero(mine & late)
        a, b = (np.frombuffer(b"".join(units[i] for i in at.tolist()), np.float64).reshape(len(at), length // 8) for at in (first, second))
        for i, near in enumerate(a @ b.T >= cosine):
            # Rows linked to one row are joined at once.
            union.join(int(first[i]), *second[near].tolist())
    return union.edges(reps)


def _links(members: DataFrame, cosine: float) -> DataFrame:
    """(rep, links): other vectors linked to each, all members of a component compared."""
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / F.lit(LINK_BLOCK)).cast("int").alias("blocks"))
    rows = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("grp"),
        (F.col("block") > F.col("other")).alias("late"), (F.col("block") == F.col("other")).alias("same"),
        "rep", "n", "unit",
    )
    dealt = rows.repartition("grp").sortWithinPartitions("grp", "rep")

    def count(part: pa.Table) -> pa.RecordBatch:
        matrix = np.frombuffer(b"".join(part["unit"].to_pylist()), np.float64).reshape(len(part), -1)
        n, links = part["n"].to_numpy(), np.zeros(len(part), np.int64)
        late = part["late"].to_numpy()
        same = part["same"][0].as_py()
        second = np.arange(len(part)) if same else np.flatnonzero(late)
        first = second if same else np.flatnonzero(~late)
        # A few rows at a time against all others, so that no matrix of all pairs is held.
        for low in range(0, len(first), BLOCK):
            here = first[low : low + BLOCK]
            near = matrix[here] @ matrix[second].T >= cosine
            if same:
                near[np.arange(len(here)), here] = False
            else:
                links[second] += near.T @ n[here]
            links[here] += near @ n[second]
        return pa.RecordBatch.from_arrays([part["rep"].combine_chunks(), pa.array(links)], ["rep", "links"])

    counts = dealt.mapInArrow(by_group("grp", count), "rep long, links long")
    return counts.groupBy("rep").agg(F.sum("links").alias("links"))
