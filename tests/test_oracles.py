"""Every registered query against its SQL twin, and no query without one."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as contract
from pagework.plans.catalog import QUERIES
from pagework.plans.oracles import ORACLES

SF_DIR = os.environ.get("PAGEWORK_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)

# Pairwise joins, Python workers, and everything in one task.
UNWANTED = ["CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "SinglePartition"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    return str(value)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_same_rows(key, spark, duck):
    ours = contract.queries()[key](spark, SF_DIR)
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in UNWANTED if word in plan]
    relation = duck.sql(contract.oracle_sql()[key])
    columns = sorted(ours.columns)
    assert columns == sorted(relation.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in ours.collect())
    order = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    assert len(got) == len(want)
    assert got == want
    assert got, "a query without rows checks nothing"


def test_entry(spark):
    assert contract.entry(spark).columns == ["doc_id", "output_name", "part_no", "out_no", "page_no"]
