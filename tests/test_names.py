"""Helper columns don't clash with columns of a table."""

from pyspark.sql import functions as F

from sparkloom.functions.names import free
from sparkloom.operators import graph, lifecycle, sync


def test_columns_of_any_name_stay(spark):
    rows = spark.createDataFrame([(1, 5, "a", 7), (1, 6, "b", 8)], "k long, at long, _n string, _N_ long")
    assert free(rows, "_n", "_n", "at") == ["_n__", "_n___", "at_"]
    assert [tuple(r) for r in graph.latest(rows, ["k"], ["at"]).collect()] == [(1, 6, "b", 8)]
    none = rows.limit(0).select("at")
    assert [tuple(r) for r in sync.retained(rows, "k", [F.desc("at")], 1, none, "at").select("k", "at", "_n", "_N_").collect()] == [(1, 5, "a", 7)]
    ids = spark.createDataFrame([(1, 10), (2, 20)], "old long, new long")
    arrays = spark.createDataFrame([([2, 3, 1], "x", 4)], "refs array<long>, _row string, old long")
    assert [tuple(r) for r in sync.remap(arrays, ids, "refs").collect()] == [([20, 3, 10], "x", 4)]
    edges = spark.createDataFrame([(1, 2, "s")], "src long, dst long, _s string")
    out = lifecycle.redirect(edges, spark.createDataFrame([(2, 9)], "origin long, survivor long")).collect()
    assert [(r["src"], r["dst"], r["_s"]) for r in out] == [(1, 9, "s")]
    files = spark.createDataFrame([(1, "p", "x"), (2, "p", "y")], "id long, path string, _same string")
    got = lifecycle.collisions(files, F.lower("path"), "id", "_same").collect()
    assert {(r["id"], r["state"]) for r in got} == {(1, "survivor"), (2, "refused")}
