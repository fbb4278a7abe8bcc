"""Against SQL, and by a direct reading with Python's own whole numbers."""

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import compare, connect

from corpuscope.llm import centroids
from corpuscope.llm.queries import ORACLES, QUERIES
from corpuscope.session import materialize


def test_query_matches_sql(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, QUERIES["op12_centroids"], ORACLES["op12_centroids"]) is None


def direct(rows, k=16, rounds=3, dim=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(1 << 27), min(1 << 27, math.floor(64 * x))) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middles = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middles))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            middles[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(f[2] for f in found)
    sums = {n: sum(f[2] for f in found if f[1] == n) for _, n, _ in found}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    return sorted((str(i), n, far, sums[n], total, digest[n]) for i, n, far in found)


def rows_of(frame):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in frame.collect())


def odd_vectors():
    draw = np.random.default_rng(3)
    plain = [(i, (draw.standard_normal(64) + 3 * (i % 5)).tolist()) for i in range(150)]
    nan, inf = float("nan"), float("inf")
    return plain + [
        (200, None), (201, []), (202, [0.0] * 63), (203, [0.0] * 65), (204, [nan] + [0.0] * 63), (205, [inf] + [0.0] * 63),
        (206, [None] + [0.0] * 63), (207, [0.0] * 64), (207, [0.0] * 64), (207, [0.0] * 64), (None, [1.5] * 64), (None, None),
        (208, [1e300, -1e300] * 32), (209, [-0.001] * 64), (210, [float(1 << 20)] * 64),
    ]


def test_odd_rows_by_direct_reading(spark):
    rows = odd_vectors()
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, cluster int")
    assert rows_of(centroids.cluster(frame.repartition(7), block=8)) == direct(rows)
    assert rows_of(centroids.cluster(frame)) == direct(rows)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert rows_of(centroids.cluster(spark.createDataFrame(rows, schema))) == direct(rows)
    none = centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema))
    assert none.collect() == [] and none.columns[0] == "vec_id"
    assert centroids.cluster(materialize(spark.createDataFrame([], schema), "no-vectors")).collect() == []


def test_a_third_of_all_vectors_alike(spark):
    rows = [(i, [1.0] * 64 if i % 3 == 0 else [float((i * j) % 11) for j in range(64)]) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert rows_of(centroids.cluster(frame, block=16)) == direct(rows)


BOX = st.lists(st.tuples(st.integers(-6, 6), st.integers(0, 4)), min_size=2, max_size=2)


@settings(max_examples=200, deadline=None, database=None)
@given(BOX, st.lists(st.lists(st.integers(-8, 8), min_size=2, max_size=2), min_size=1, max_size=6))
def test_boxes_lose_no_centroid(box, middles):
    low, high = np.array([b for b, _ in box]), np.array([b + w for b, w in box])
    middles = np.array(middles)
    left = centroids.candidates(low, high, middles)
    points = np.array(list(itertools.product(*[range(a, b + 1) for a, b in zip(low, high)])))
    far = ((points[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert left[(far == far.min(axis=1)[:, None]).any(axis=0)].all()
    # And a centroid farther than another one from every corner is out.
    beaten = (far[:, :, None] > far[:, None, :]).all(axis=0).any(axis=1)
    assert not left[beaten].any()


def test_large_and_small_numbers_agree():
    draw = np.random.default_rng(5)
    m, c = draw.integers(-(1 << 20), 1 << 20, (40, 64)), draw.integers(-(1 << 20), 1 << 20, (7, 64))
    best, far = centroids.nearest(m, c)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, x)), n) for n, x in enumerate(c)) for v in m]
    assert list(zip(far.tolist(), best.tolist())) == want


def test_curve_visits_every_cell_once_by_single_steps():
    for dim, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dim)))
        keys = centroids.hilbert_keys(cells, bits)
        order = sorted(range(len(cells)), key=lambda i: keys[i].tobytes())
        assert len({k.tobytes() for k in keys}) == len(cells)
        steps = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_blocks_of_neighbours_have_few_candidates():
    draw = np.random.default_rng(9)
    middles = draw.integers(-4000, 4000, (16, 64))
    matrix = np.concatenate([m + draw.integers(-20, 20, (64, 64)) for m in middles])
    column = pa.array((matrix / 64).tolist(), pa.list_(pa.float64()))
    rows, whole = centroids.whole_numbers(column, 64, 64)
    assert len(rows) == len(matrix) and (whole == matrix).all()
    cell = (whole - whole.min(axis=0)) * 4 // (whole.max(axis=0) - whole.min(axis=0) + 1)
    order = sorted(range(len(cell)), key=lambda i, k=centroids.hilbert_keys(cell, 2): k[i].tobytes())
    left = [centroids.candidates(b.min(axis=0), b.max(axis=0), middles).sum() for b in np.split(whole[order], 64)]
    assert np.mean(left) < 6
