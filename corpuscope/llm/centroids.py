"""Centroid clustering over space-filling-curve zone maps.

Vectors become whole numbers, are sorted along a Hilbert curve and stored in blocks of
neighbours, each with its box (least and greatest value of every component). In a round,
a block's box alone tells which centroids can be nearest to any of its vectors: centroid
``c`` is out if some other one is nearer at every point of the box, by the greatest value
that the difference of both squared distances takes there. Only the centroids left are
compared with the vectors, exactly; a block with one left takes its stored sums.

All figures are whole numbers, so results do not depend on the order of additions. A
round returns one row per centroid, component and task at most.

Defined results: vectors that are null, of another length, or hold null or non-finite
components are left out; whole numbers beyond 2^27 either way count as that bound, so
that a squared distance fits a long; null ids keep their row (and hash as an empty
text); repeated rows are vectors of their own; with fewer vectors than centroids each
vector starts one; no vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.session import materialize

DIM = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = "1"
BOUND = 1 << 27
# Vectors of a block; halves of each component's range, so bits a component on the curve.
BLOCK = 256
CURVE_BITS = 2
# Up to this size all products and sums are exact in double precision (64 components).
_EXACT = 1 << 22


def whole_numbers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the rows that are kept, and floor(scale * x) of their components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(-1).to_numpy()
    rows = np.flatnonzero(sizes == dim)
    values = column.take(pa.array(rows)).flatten().cast(pa.float64())
    matrix = values.to_numpy(zero_copy_only=False).reshape(len(rows), dim)  # nulls are NaN
    sound = np.isfinite(matrix).all(axis=1)
    # Dividing first would round; a product beyond the doubles is cut off with the rest.
    with np.errstate(over="ignore"):
        floors = np.floor(matrix[sound] * float(scale))
    return rows[sound], np.clip(floors, -BOUND, BOUND).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row's cell on the Hilbert curve, as big-endian bytes.

    ``cells`` has one number of ``bits`` bits per component (Skilling's transform: undo
    the excess work from the top bit down, then Gray encode; all rows at once).
    """
    x = cells.astype(np.uint32).copy()
    n = x.shape[1]
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        low = np.uint32(q - 1)
        for i in range(n):
            is_set = (x[:, i] & np.uint32(q)) != 0
            swap = np.where(is_set, np.uint32(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(is_set, low, swap)
            x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint32)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        flip ^= np.where((x[:, n - 1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
    x ^= flip[:, None]
    planes = [(x >> np.uint32(k)) & np.uint32(1) for k in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids can be nearest (or equally near) to a point of the box."""
    # |x-a|^2 - |x-b|^2 is linear in x: its greatest value over the box is at a corner.
    step = centroids[None, :, :] - centroids[:, None, :]  # b - a
    square = (centroids * centroids).sum(axis=1)
    corner = np.where(step > 0, high, low)
    most = 2 * (step * corner).sum(axis=2) + square[:, None] - square[None, :]
    return ~(most < 0).any(axis=0)


def nearest(matrix: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row; ties go to the smaller number."""
    if len(matrix) and max(np.abs(matrix).max(), np.abs(centroids).max()) <= _EXACT:
        m, c = matrix.astype(np.float64), centroids.astype(np.float64)
        far = (m * m).sum(axis=1)[:, None] - 2.0 * (m @ c.T) + (c * c).sum(axis=1)
        far = far.astype(np.int64)
    else:
        far = np.stack([((matrix - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(far)), best]


class _Block:
    """One stored block."""

    def __init__(self, row: dict, dim: int):
        low_high_sum = np.frombuffer(row["box"], np.int64).reshape(3, dim)
        self.low, self.high, self.sum = low_high_sum
        self.row, self.n, self.dim = row, row["n"], dim

    @property
    def matrix(self) -> np.ndarray:
        return np.frombuffer(self.row["matrix"], np.int32).reshape(self.n, self.dim).astype(np.int64)

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero(candidates(self.low, self.high, centroids))
        best, far = nearest(self.matrix, centroids[left])
        return left[best], far


def _ranges(vectors: DataFrame, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Least and greatest whole number of each component, over all kept vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dim, BOUND), np.full(dim, -BOUND)
        any_ = False
        for batch in batches:
            _, matrix = whole_numbers(batch.column(0), dim, scale)
            if len(matrix):
                any_ = True
                low, high = np.minimum(low, matrix.min(axis=0)), np.maximum(high, matrix.max(axis=0))
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(low), pa.array(high)], ["c", "low", "high"])

    parts = vectors.select("vector").mapInArrow(run, "c long, low long, high long")
    rows = parts.groupBy("c").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("c").collect()
    return (np.array([r.low for r in rows]), np.array([r.high for r in rows])) if rows else None


def zone_maps(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, block: int = BLOCK) -> DataFrame | None:
    """Stored blocks (ids, n, box, matrix) of the kept vectors in Hilbert order,
    or None without any. ``vectors`` has ``id`` and ``vector``."""
    ends = _ranges(vectors, dim, scale)
    if ends is None:
        return None
    low, high = ends
    kind = vectors.schema["id"].dataType
    cells = 1 << CURVE_BITS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, matrix = whole_numbers(batch.column(1), dim, scale)
            cell = (matrix - low) * cells // np.maximum(high - low + 1, 1)
            curve = hilbert_keys(cell, CURVE_BITS)
            columns = [batch.column(0).take(pa.array(rows)), pa.array([k.tobytes() for k in curve], pa.binary())]
            columns.append(pa.array([m.tobytes() for m in matrix.astype(np.int32)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["id", "curve", "whole"])

    id_kind = kind.simpleString()
    placed = vectors.select("id", "vector").mapInArrow(place, f"id {id_kind}, curve binary, whole binary")
    placed = materialize(placed.withColumn("row", F.monotonically_increasing_id()), "centroid-rows")
    # The row breaks ties, so equal vectors are cut over tasks like any other rows.
    ordered = placed.repartitionByRange("curve", "row").sortWithinPartitions("curve", "row")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            rest = part if rest is None else pa.concat_tables([rest, part])
            whole = len(rest) // block * block
            if whole:
                rest = rest.combine_chunks()
                yield from (_packed(rest.slice(at, block), dim) for at in range(0, whole, block))
                rest = rest.slice(whole)
        if rest is not None and len(rest):
            yield _packed(rest.combine_chunks(), dim)

    stored = ordered.select("id", "whole").mapInArrow(pack, f"ids array<{id_kind}>, n int, box binary, matrix binary")
    return materialize(stored, "centroid-blocks")


def _packed(part: pa.Table, dim: int) -> pa.RecordBatch:
    data = b"".join(part["whole"].to_pylist())
    matrix = np.frombuffer(data, np.int32).reshape(len(part), dim).astype(np.int64)
    box = np.stack([matrix.min(axis=0), matrix.max(axis=0), matrix.sum(axis=0)])
    ids = part["id"].combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    lists = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids)
    columns = [lists, pa.array([len(part)], pa.int32()), pa.array([box.tobytes()], pa.binary()), pa.array([data], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["ids", "n", "box", "matrix"])


def _first_centroids(vectors: DataFrame, k: int, seed: str, dim: int, scale: int) -> np.ndarray:
    """The kept vectors with the least hashes of their ids, in hash order."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    hashed = vectors.where((F.size("vector") == dim) & sound).select(F.sha2(text.cast("binary"), 256).alias("hash"), "vector")
    first = hashed.orderBy("hash", "vector").limit(k).collect()  # k rows
    return whole_numbers(pa.array([r.vector for r in first], pa.list_(pa.float64())), dim, scale)[1]


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of their vectors' means."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                one = _Block(row, dim)
                left = np.flatnonzero(candidates(one.low, one.high, centroids))
                if len(left) == 1:
                    counts[left[0]] += one.n
                    sums[left[0]] += one.sum
                    continue
                matrix = one.matrix
                best, _ = nearest(matrix, centroids[left])
                for b in np.unique(best).tolist():
                    mine = best == b
                    counts[left[b]] += int(mine.sum())
                    sums[left[b]] += matrix[mine].sum(axis=0)
        used = np.flatnonzero(counts)
        columns = [pa.array(np.repeat(used, dim)), pa.array(np.tile(np.arange(dim), len(used)))]
        columns += [pa.array(np.repeat(counts[used], dim)), pa.array(sums[used].ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "c", "n", "sum"])

    parts = blocks.select("n", "box", "matrix").mapInArrow(run, "cluster long, c long, n long, sum long")
    # Decimals, as sums over very many rows may pass a long.
    total = parts.groupBy("cluster", "c").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(20,0)")).alias("sum"))
    moved = centroids.copy()
    for r in total.collect():  # clusters times components
        moved[r["cluster"], r["c"]] = int(r["sum"]) // r["n"]
    return moved


def cluster(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: int = SCALE,
    seed: str = SEED,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    id_kind = source.schema["id"].dataType
    blocks = zone_maps(source, dim, scale, block)
    if blocks is None:
        named = [T.StructField("id", id_kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
        assigned = spark.createDataFrame([], T.StructType(named))
        centroids = np.zeros((0, dim), np.int64)
    else:
        centroids = _first_centroids(source, k, seed, dim, scale)
        for _ in range(rounds):
            centroids = _moved(blocks, centroids)
        assigned = materialize(_assigned(blocks, centroids, id_kind.simpleString()), "centroid-assigned")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()  # a row per cluster
    inertia = sum(r["sum"] for r in sums)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(r["cluster"], r["sum"], inertia, digests[r["cluster"]]) for r in sums]
    told = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _assigned(blocks: DataFrame, centroids: np.ndarray, id_kind: str) -> DataFrame:
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i in range(len(batch)):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(("ids", "n", "box", "matrix")) if j}
                best, far = _Block(row, dim).assign(centroids)
                columns = [ids[i].values, pa.array(best.astype(np.int32)), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    return blocks.select("ids", "n", "box", "matrix").mapInArrow(run, f"id {id_kind}, cluster int, distance long")
