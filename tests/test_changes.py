"""Removals of spans give what a build of what is left gives, and read only the buckets that they touch."""

import random

from sparkloom.operators.changes import LiveGraph


def test_removals_equal_builds(spark, tmp_path):
    rng = random.Random(3)
    relations = [(i, rng.randrange(60), rng.randrange(60), rng.random() < 0.1) for i in range(70)]
    supports = [(e, s, rng.randrange(5), span) for e, *_ in relations for s in range(rng.randrange(3)) for span in rng.sample(range(300), rng.randrange(1, 3))]
    frames = lambda rel, sup: (spark.createDataFrame(rel, "edge_id long, src long, dst long, authored boolean"), spark.createDataFrame(sup, "edge_id long, support long, lineage long, span long"))
    live = LiveGraph(spark, f"file://{tmp_path}/live", "c", 16)
    live.build(*frames(relations, supports))
    for k in range(2):
        gone = set(rng.sample(range(300), 25))
        before = live.versions.latest()[1]["buckets"]
        did = live.remove(spark.createDataFrame([(s,) for s in gone] * 2 + [(None,), (9999,)], "span long"))
        stale = {(e, s) for e, s, _, span in supports if span in gone}
        after = live.versions.latest()[1]["buckets"]
        supports = [r for r in supports if (r[0], r[1]) not in stale]
        fresh = LiveGraph(spark, f"file://{tmp_path}/fresh{k}", "c", 16)
        fresh.build(*frames(relations, supports))
        assert sorted(map(tuple, live.edges().collect())) == sorted(map(tuple, fresh.edges().collect()))
        assert sorted(map(tuple, live.reports().collect())) == sorted(map(tuple, fresh.reports().collect()))
        assert did["version"] == k + 2 and did["stale_supports"] > 0
        # Buckets that were not read are the same folders as before.
        assert sum(before[b] == after.get(b) for b in before) == len(before) - did["buckets_read"] > 0
    assert live.remove(spark.createDataFrame([(123456,)], "span long"))["version"] == 3


def test_a_graph_of_nothing(spark, tmp_path):
    live = LiveGraph(spark, f"file://{tmp_path}/none")
    live.build(spark.createDataFrame([], "edge_id long, src long, dst long, authored boolean"), spark.createDataFrame([], "edge_id long, support long, lineage long, span long"))
    assert live.reports().count() == 0
    assert live.remove(spark.createDataFrame([(1,)], "span long"))["stale_supports"] == 0
