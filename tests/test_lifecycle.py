"""Records as they change, on small inputs with known results."""

import duckdb
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.operators import lifecycle as L
from sparkloom.plans import lifecycle_queries
from sparkloom.plans.lifecycle_queries import headings


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scrub_keeps_order_and_empty_rows(spark):
    df = spark.createDataFrame([(1, [5, 3, 5, 9]), (2, [9]), (3, []), (4, None)], "k long, ids array<long>")
    gone = spark.createDataFrame([(9,), (3,), (9,)], "id long")
    assert rows(L.scrub(df, "k", "ids", gone, "id")) == [(1, [5, 5]), (2, []), (3, []), (4, [])]


def test_first_seen(spark):
    df = spark.createDataFrame([(1, [5, 3, 4, 7])], "k long, ids array<long>")
    of = spark.createDataFrame([(3, "b"), (4, "a"), (5, "a"), (6, "c")], "id long, v string")
    assert rows(L.first_seen(df, "k", "ids", of, "id", "v")) == [(1, ["a", "b"])]


def test_first_seen_sources_of_odd_lines_equal_sql_and_keep_their_partitions(spark, tmp_path, monkeypatch):
    lines = [(1, 10, 1), (1, 11, None), (1, 12, 2), (1, 10, 1), (2, 13, 1), (3, 99, 1), (3, None, 2), (None, 12, 1), (4, 13, 1), (4, 12, None)] + [(5, 10 + i % 3, i) for i in range(40)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(10, "x"), (11, "y"), (12, "z"), (13, None)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(lifecycle_queries, "LINES_EACH", 5)
    df = lifecycle_queries.first_seen_sources(spark, str(tmp_path))
    duck = duckdb.connect()
    for t in ("lineitem", "part"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(duck.execute(catalog.oracles()["first_seen_sources"]).fetchall(), key=str)
    assert df.rdd.getNumPartitions() == 10  # 50 lines by 5: small partitions are not put together again


def test_a_merge_can_be_taken_back(spark):
    edges = spark.createDataFrame([(1, 10, 20), (2, 20, 30), (3, 30, 10)], "edge_id long, src long, dst long")
    merges = spark.createDataFrame([(20, 10)], "origin long, survivor long")
    after = L.redirect(edges, merges)
    assert rows(after.select("edge_id", "src", "dst")) == [(1, 10, 10), (2, 10, 30), (3, 30, 10)]
    assert rows(L.restore(after).select("edge_id", "src", "dst")) == rows(edges)


def test_links_are_resolved_by_path_then_name_then_alias(spark):
    pages = spark.createDataFrame([(1, "a/One.md"), (2, "b/one.md"), (3, "b/Two.md"), (4, "Three.md")], "page long, path string")
    aliases = spark.createDataFrame([(3, "second"), (4, "One"), (3, "both"), (4, "both")], "page long, alias string")
    links = spark.createDataFrame([("A/one",), ("One",), ("two#Head",), ("SECOND",), ("both",), ("none",), ("three.md",)], "target string")
    got = {r["target"]: (r["found_by"], r["page"]) for r in L.resolve(links, pages, aliases).collect()}
    assert got == {"A/one": ("path", 1), "One": ("ambiguous", None), "two#Head": ("name", 3), "SECOND": ("alias", 3), "both": ("ambiguous", None), "none": ("unresolved", None), "three.md": ("path", 4)}


def test_portable_paths_take_the_longest_root(spark):
    files = spark.createDataFrame([("/a/b/c",), ("/a/x",), ("/ab/c",), ("/a/b",), ("/a",)], "path string")
    roots = spark.createDataFrame([("r", "/a"), ("s", "/a/b")], "key string, root string")
    assert {r["path"]: r["ref"] for r in L.portable(files, "path", roots).collect()} == {"/a/b/c": "s:c", "/a/x": "r:x", "/ab/c": None, "/a/b": "r:b", "/a": None}


def test_collisions(spark):
    files = spark.createDataFrame([(3, "A", "x"), (1, "a", "x"), (5, "b", "x"), (4, "b", "y"), (6, "c", "z")], "id long, p string, h string")
    assert rows(L.collisions(files, F.lower("p"), "id", "h")) == [(1, 1, "survivor"), (3, 1, "merged"), (4, 4, "survivor"), (5, 4, "refused")]


def test_omitted_items_are_tried_against_the_whole_limit(spark):
    items = spark.createDataFrame([(1, k, c) for k, c in enumerate([6, 7, 4, 1, 2])], "k long, n long, cost long")
    got = L.expand(items, ["k"], ["n"], "cost", "n", 12).first()  # nine in the first pass
    assert (got["kept"], got["expanded"], got["refused"], got["used"]) == ([0, 3, 4], [], [1, 2], 9)
    more = L.expand(items, ["k"], ["n"], "cost", "n", 16).first()  # twelve, then sixteen
    assert (more["kept"], more["expanded"], more["refused"], more["used"]) == ([0, 2, 3], [4], [1], 13)


def test_newest_content_keeps_the_first_state(spark):
    df = spark.createDataFrame([(1, "a", "s1", 5), (1, "b", "s2", 9), (1, None, "s3", 1), (2, "c", "s", 1)], "k long, content string, state string, clock long")
    assert rows(L.newest(df, ["k"], "clock", ["state"]).select("k", "content", "state")) == [(1, "b", "s3"), (2, "c", "s")]


def test_headings(spark):
    lines = ["1. Introduction", "2.1. Methods here", "RESULTS AND MORE", "Future work:", "plain text", "", "x" * 90, "1.2 lower", "Abstract."]
    got = {r["title"]: r["level"] for r in headings(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")).collect()}
    assert got == {"1. Introduction": 1, "2.1. Methods here": 2, "RESULTS AND MORE": 1, "Future work:": 1, "Abstract.": 1}


def test_rewritten_relations_need_one_shuffle_and_null_ends_are_equal(spark):
    rows = [(1, 2, True, False), (1, 2, False, True), (1, 3, True, False), (1, 3, True, False), (2, 2, False, True), (None, 5, True, False), (None, 5, False, True), (None, 6, False, True), (9, 9, False, False)]
    got = L.rewritten(spark.createDataFrame(rows, "src long, dst long, old boolean, now boolean"))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 3, "retired"), (2, 2, "new"), (None, 6, "new")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
