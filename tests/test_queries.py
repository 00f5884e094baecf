"""Registered queries against their SQL in DuckDB."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from tracewright import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in queries.SQL if not n.startswith("f") or n in ("f4_group", "f10_type_cast", "f13_up_select", "f19_xor", "f22_wide", "f23_divide", "f32_conditional", "f40_literal_text")))
def test_against_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({queries.SQL[name]})")
    assert [KINDS[dict(df.dtypes)[c]] for c in cols] == [str(t) for t in found.types]
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(found.fetchall())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)
