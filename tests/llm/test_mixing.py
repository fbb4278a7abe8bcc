"""Against SQL, and by hand."""

import re

from oracle_check import compare, connect

from corpuscope.llm import mixing
from corpuscope.llm.queries import ORACLES, QUERIES
from corpuscope.session import materialize


def test_query_matches_sql(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, QUERIES["op5_mixing"], ORACLES["op5_mixing"]) is None


def test_blocks_do_not_change_the_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few, many = (mixing.mix(docs, block_rows=n).select("doc_id", "taken") for n in (10_000, 3))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 100, 1), ("b", 1000, 1), ("c", 1000, 1), (None, 0, 1)], "source string, source_size long, n_rows long")
    got = {r.source: r.target for r in mixing.budgets(sizes).collect()}
    # 3150 words by weights 3, 1, 2, 3: the null source and "a" stop at their caps.
    assert got[None] == 0 and got["a"] == 200
    assert abs(got["b"] - 2950 / 3) < 1e-6 and abs(got["c"] - 2 * 2950 / 3) < 1e-6


def test_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    by_source = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by_source.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(int(target) == taken for target, taken in by_source.values())
    assert mixing.mix(empty).count() == 0


def test_all_texts_null(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(df).collect()] == [0, 0]


def test_take_gives_the_words_counted(spark, odd):
    docs = materialize(odd.selectExpr("*", "monotonically_increasing_id() AS nr"), "mix-test")
    mixed = materialize(mixing.mix(docs, row_col="nr"), "mix-test")
    words = {}
    taken = mixing.take(docs, mixed, "nr")
    assert taken.columns == odd.columns
    for r in taken.collect():
        words[r.source] = words.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = {r.source: r.t for r in mixed.groupBy("source").agg({"taken": "sum"}).toDF("source", "t").collect()}
    assert words == {k: v for k, v in want.items() if v}


def test_first_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("  a b\n\tc  d ", k) for k in (1, 2, 3, 4)], "t string, k long")
    got = [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("k"))).collect()]
    assert got == ["  a", "  a b", "  a b\n\tc", "  a b\n\tc  d"]
