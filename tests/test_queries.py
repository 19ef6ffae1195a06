"""Every linear-system query against its SQL at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lumenfold.plans import corpus_queries, factor_queries  # noqa: F401
from lumenfold.plans import queries as linear

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(linear.QUERIES))
def test_query(spark, tables, name):
    rows = linear.QUERIES[name](spark, SF).collect()
    assert rows
    if sql := linear.ORACLES.get(name):
        want = tables.sql(sql)
        assert sorted((tuple(r[c] for c in want.columns) for r in rows), key=str) == sorted(map(tuple, want.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 210
    assert set(linear.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_pattern_symmetry_reads_all_parts(spark):
    """sf0.01 has 2,000 parts; the query reads every one of them."""
    whole = duckdb.sql("""
        WITH e AS (SELECT DISTINCT l_partkey AS r, l_suppkey AS c FROM '/root/testdata/sf0.01/lineitem.parquet' WHERE l_partkey <> l_suppkey)
        SELECT floor(count(f.r) / CAST(count(*) AS DOUBLE) * 1e6 + 0.5) / 1e6, count(f.r) = count(*) FROM e LEFT JOIN e f ON f.r = e.c AND f.c = e.r""").fetchall()
    assert [tuple(r) for r in linear.QUERIES["pattern_symmetry"](spark, "/root/testdata/sf0.01").collect()] == whole
