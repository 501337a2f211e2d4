"""Every registered query gives the rows of its SQL."""

import os

import duckdb
import pytest

from sparkloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def cell(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted("|".join(cell(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert mine == sorted("|".join(cell(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_queries_without_sql_are_few():
    assert set(catalog.queries()) - set(catalog.oracles()) <= {"bridge_edges", "note_windows"}
