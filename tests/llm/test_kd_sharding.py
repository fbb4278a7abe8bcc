"""Sizes, slots, and a split by hand."""

import pytest

from corpuscope.llm import kd_sharding
from corpuscope.llm.queries import QUERIES


def check(rows, n_leaves):
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) <= set(range(n_leaves))
    for members in shards.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    return {k: sum(r["size"] for r in v) for k, v in shards.items()}


def test_query_makes_equal_shards(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_kd_sharding"](spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r["size"] == len(docs[r.doc_id].text.encode()) + 8 and r.law == "bytes" and r.grown_shard is None for r in rows)
    sizes = check(rows, 24)
    mean = sum(sizes.values()) / 24
    largest = max(r["size"] for r in rows)
    assert all(abs(s - mean) <= 2 * largest for s in sizes.values())
    again = QUERIES["op3_kd_sharding"](spark, sf).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


@pytest.mark.parametrize("leaves", [1, 2, 7])
def test_one_value_may_hold_most_rows(spark, leaves):
    rows = [(i % 3, "t" * 12, "hot" if i % 10 else f"s{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = kd_sharding.shards(df, n_leaves=leaves, dims=("source", "doc_id"), block_rows=16).collect()
    sizes = check(got, leaves)
    assert len(sizes) == leaves and max(sizes.values()) - min(sizes.values()) <= 0.05 * sum(sizes.values()) + 40


def test_leaves_are_boxes_of_the_dimension(spark):
    df = spark.createDataFrame([(i, "t" * 2) for i in range(64)], "doc_id long, text string")
    got = kd_sharding.shards(df, n_leaves=4, dims=("doc_id",)).collect()
    assert {r.shard for r in got if r.doc_id < 16} == {0} and {r.shard for r in got if r.doc_id >= 48} == {3}
    assert len({r.shard for r in kd_sharding.shards(df, target_bytes=160, dims=("doc_id",)).collect()}) == 4


def test_coordinates_keep_order(spark):
    from pyspark.sql import functions as F

    values = [None, "", "a", "ab", "b", "é"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(kd_sharding.coordinate(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == sorted(got) and got[0] == 0
    numbers = [None, -(2**62), -5, 0, 7, 2**62]
    df = spark.createDataFrame([(v,) for v in numbers], "v long")
    got = [r[0] for r in df.select(kd_sharding.coordinate(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == sorted(got) and len(set(got)) == 6


def test_odd_rows_and_empty_table(odd, empty):
    got = kd_sharding.shards(odd, n_leaves=24).collect()
    assert len(got) == odd.count()
    check(got, 24)
    assert sorted(r["size"] for r in got) == sorted(len((r.text or "").encode()) + 8 for r in odd.collect())
    assert kd_sharding.shards(empty, n_leaves=24).count() == 0
