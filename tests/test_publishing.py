"""Rounds of publication: unchanged, refused, failing and concurrent ones."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.publishing import Publisher
from sparkloom.versions import Conflict


def test_rounds(spark, tmp_path):
    p = Publisher(spark, f"file://{tmp_path}/p", "source", "v1")
    frame = lambda rows: spark.createDataFrame(rows, "source long, claim string, ok boolean")
    gate = lambda staged: staged.where("not ok").select("source", F.lit("unproved").alias("code"))
    status = lambda df: {r["source"]: (r["status"], r["generation"]) for r in df.collect()}
    held = lambda: sorted((r["source"], r["claim"], r["generation"]) for r in p.units().collect())
    one = [(1, "a", True), (1, "a", True), (1, "b", True), (2, "c", True), (3, "d", False), (None, "x", True)]
    assert p.units() is None
    assert status(p.publish(frame(one), gate)) == {1: ("published", 1), 2: ("published", 1), 3: ("refused", None)}
    assert held() == [(1, "a", 1), (1, "b", 1), (2, "c", 1)]
    # The same again publishes nothing, and a refused scope is asked for once more.
    assert status(p.publish(frame(one[:4]), gate)) == {1: ("unchanged", 1), 2: ("unchanged", 1)} and p.versions.latest()[0] == 1
    two = [(1, "a", True), (1, "b", False), (3, "d", True), (4, "e", True)]
    assert status(p.publish(frame(two), gate)) == {1: ("refused", 1), 2: ("withdrawn", None), 3: ("published", 2), 4: ("published", 2)}
    assert held() == [(1, "a", 1), (1, "b", 1), (3, "d", 2), (4, "e", 2)]
    before, folders = held(), sorted(x.name for x in (tmp_path / "p/data").iterdir())

    def broken(staged):
        return staged.select("source", F.raise_error(F.lit("gate failed")).cast("string").alias("code")).where("code is null")

    with pytest.raises(Exception, match="gate failed"):
        p.publish(frame([(1, "z", True)]), broken)
    assert held() == before and folders == sorted(x.name for x in (tmp_path / "p/data").iterdir())

    def slow(staged):
        Publisher(spark, f"file://{tmp_path}/p", "source", "v1").publish(frame([(9, "first", True)]), gate)
        return gate(staged)

    with pytest.raises(Conflict):
        p.publish(frame([(8, "second", True)]), slow)
    assert held() == [(9, "first", 3)]
    # Another contract publishes all scopes anew.
    q = Publisher(spark, f"file://{tmp_path}/p", "source", "v2")
    assert status(q.publish(frame([(9, "first", True)]), gate)) == {9: ("published", 4)}
