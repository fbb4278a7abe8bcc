"""Every registered query of the library against its SQL, over whole tables."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from corpuscope.plans.oracles import ORACLES
from corpuscope.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None


def test_entry_lists_every_query():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["rank", "name", "complexity", "functions", "classes", "size_kb"]
    assert [r["rank"] for r in df.collect()] == list(range(1, 11))
