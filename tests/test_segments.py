"""A refreshed index equals one that is built anew; publishing is a compare-and-set."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import index as X
from sparkloom.operators.segments import SIDE_BY_SIDE, SegmentedIndex, shared_index
from sparkloom.storage import Workspace
from sparkloom.versions import Conflict, Versions


def rows(df):
    return sorted((r["term"], r["doc_id"], r["dl"], r["tf"], tuple(r["places"])) for r in df.collect())


def test_refresh_equals_a_fresh_build(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))])
    docs = {i: text() for i in range(40)}
    index = SegmentedIndex(spark, f"file://{tmp_path}/index")
    assert index.open().postings.count() == 0
    merged = 0
    for _ in range(9):
        table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        did = index.refresh(table)
        merged += did.merged
        got, want = index.open(), X.build_index(table, Workspace(spark, "fresh"))
        assert rows(got.postings) == rows(want.postings)
        tidy = lambda v: sorted(map(tuple, v.select("term", "df", "cf").collect()))
        assert tidy(got.vocabulary) == tidy(want.vocabulary)
        assert (got.n_docs, round(got.avgdl, 9)) == (want.n_docs, round(want.avgdl, 9))
        before = index.versions.latest()
        folders = sorted(p.name for p in (tmp_path / "index/data").iterdir())
        again = index.refresh(table)
        assert not again.wrote and again.kept == len(docs) and index.versions.latest() == before and folders == sorted(p.name for p in (tmp_path / "index/data").iterdir())
        for i in rng.sample(sorted(docs), 4):
            docs.pop(i)
        for i in rng.sample(sorted(docs), 3):
            docs[i] = text()
        docs |= {i: text() for i in rng.sample(range(100), 5)}
    assert merged and len(index.state()["segments"]) <= 3 * SIDE_BY_SIDE


def test_search_of_a_refreshed_index(spark, tmp_path):
    docs = {1: "red apple", 2: "green apple pie", 3: "blue sky"}
    index = SegmentedIndex(spark, f"file://{tmp_path}/i")
    ask = spark.createDataFrame([(1, "apple"), (2, '"apple pie"')], "query_id long, question string")
    found = lambda: {(r["query_id"], r["doc_id"]) for r in X.lexical_hits(index.open(), ask, Workspace(spark, "ask")).collect()}
    put = lambda: index.refresh(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    put()
    assert found() == {(1, 1), (1, 2), (2, 2)}
    docs |= {1: "red plum", 3: "apple pie in the sky"}
    del docs[2]
    did = put()
    assert (did.inserted, did.updated, did.deleted, did.kept) == (0, 2, 1, 0) and found() == {(1, 3), (2, 3)}
    docs.clear()
    assert put().deleted == 2 and found() == set() and index.open().n_docs == 0


def test_a_failing_refresh_leaves_the_index(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/f")
    table = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    index.refresh(table)
    before, folders = rows(index.open().postings), sorted(p.name for p in (tmp_path / "f/data").iterdir())
    bad = table.withColumn("text", F.when(F.rand() < 2, F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        index.refresh(bad, input_hash=F.lit("another"))
    assert rows(index.open().postings) == before and folders == sorted(p.name for p in (tmp_path / "f/data").iterdir())


def test_versions_are_compared_and_set(spark, tmp_path):
    v, w = (Versions(spark, f"file://{tmp_path}/v") for _ in range(2))
    assert v.latest() == (0, {})
    assert v.publish(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        w.publish(0, {"a": 2})
    assert w.latest() == (1, {"a": 1}) and w.publish(1, {"a": 3}) == 2 and v.latest() == (2, {"a": 3})
    # A version whose writer has stopped half-way does not count, and can't be overwritten.
    (tmp_path / "v/versions/000000000003.json").write_text('{"a"')
    assert v.latest() == (2, {"a": 3})
    with pytest.raises(Conflict):
        v.publish(2, {"a": 4})
    v.repair()
    assert v.publish(2, {"a": 4}) == 3 and w.latest() == (3, {"a": 4})


def test_the_shared_index_follows_its_table(spark):
    one = spark.createDataFrame([(1, "red"), (2, "blue")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "red"), (2, "green"), (3, None)], "doc_id long, text string")
    first = shared_index(one, "follows")
    assert shared_index(one, "follows") is first
    later = shared_index(two, "follows")
    assert {r["term"] for r in later.postings.collect()} == {"red", "green"} and later.n_docs == 3
    # What was opened before stays readable.
    assert {r["term"] for r in first.postings.collect()} == {"red", "blue"}
