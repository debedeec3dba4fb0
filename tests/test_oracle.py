"""Every registered query against DuckDB on the smallest fixture."""

import contextlib
import io
import os
import re

import duckdb
import pytest

from ledgerlake import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(repr(r[n]) for n in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_duckdb(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toArrow()
    want = duck.sql(registry.ORACLE_SQL[name]).to_arrow_table()
    assert rows(got) == rows(want)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_plans_prune_and_push(spark, sf):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        registry.QUERIES["q06"](spark, sf).explain("formatted")
    plan = out.getvalue()
    scan = re.search(r"ReadSchema: (\S+)", plan)[1]
    assert "l_orderkey" not in scan and "EqualTo(l_linestatus,F)" in plan and "GreaterThanOrEqual(l_quantity" in plan
