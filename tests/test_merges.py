"""Merges applied to all ends at once against events one after another."""

import random

from sparkloom.operators import merges as M
from sparkloom.storage import Workspace


def replay(edges, events):
    ends = {(e, f): n for e, s, d in edges for f, n in (("src", s), ("dst", d))}
    asked, accepted, done, lineage = {}, {}, set(), {}
    for decision, _, action, origin, survivor in sorted(events, key=lambda e: e[1]):
        if action == "propose" and origin != survivor:
            asked.setdefault(decision, (origin, survivor))
        elif action == "accept" and decision in asked and decision not in accepted:
            o, s = accepted[decision] = asked[decision]
            lineage[decision] = {k for k, n in ends.items() if n == o}
            ends |= {k: s for k in lineage[decision]}
        elif action == "reverse" and decision in accepted and decision not in done:
            done.add(decision)
            ends |= {k: accepted[decision][0] for k in lineage[decision]}
    states = {d: "reversed" if d in done else "accepted" if d in accepted else "proposed" for d in asked}
    return ends, {(d, *k, accepted[d][0]) for d, ks in lineage.items() for k in ks}, states


def test_merges_equal_events_in_order(spark):
    rng = random.Random(5)
    for seed in range(2):
        edges = [(i, rng.randrange(12), rng.randrange(12)) for i in range(40)]
        events = []
        for d in range(14):
            a, b = rng.randrange(12), rng.randrange(12)
            events += [(d, "propose", a, b)] + [(d, x, None, None) for x in rng.sample(["accept", "accept", "reverse"], rng.randrange(4))]
        rng.shuffle(events)
        events = [(d, place, action, a, b) for place, (d, action, a, b) in enumerate(events)]
        ends, lineage, states = replay(edges, events)
        e, v = spark.createDataFrame(edges, "edge_id long, src long, dst long"), spark.createDataFrame(events, "decision long, place long, action string, origin long, survivor long")
        out, left = M.merged(e, v, Workspace(spark, "merges"))
        assert {(r["edge_id"], f): r[f] for r in out.collect() for f in ("src", "dst")} == ends
        assert {tuple(r[c] for c in ("decision", "edge_id", "field", "origin")) for r in left.collect()} == lineage
        assert {r["decision"]: r["state"] for r in M.decided(v)[0].collect()} == states


def test_a_reversed_merge_leaves_no_trace_in_the_graph(spark):
    e = spark.createDataFrame([(1, 5, 6), (2, 6, 5)], "edge_id long, src long, dst long")
    v = spark.createDataFrame([(1, 0, "propose", 5, 7), (1, 1, "accept", None, None), (1, 2, "reverse", None, None), (2, 3, "propose", 6, 8)], "decision long, place long, action string, origin long, survivor long")
    out, lineage = M.merged(e, v, Workspace(spark, "merges"))
    assert sorted(map(tuple, out.collect())) == [(1, 5, 6), (2, 6, 5)] and lineage.count() == 2
    assert M.redirects(v).count() == 0
    assert M.merged(e, v.limit(0), Workspace(spark, "merges"))[1].count() == 0


def test_stories_are_as_many_as_entities_not_relations(spark):
    e = spark.range(500).selectExpr("id as edge_id", "id % 2 as src", "id + 10 as dst")
    v = spark.createDataFrame([(1, 0, "propose", 1, 7), (1, 1, "accept", None, None)], "decision long, place long, action string, origin long, survivor long")
    work = Workspace(spark, "merges")
    out, lineage = M.merged(e, v, work)
    assert out.where("src = 7").count() == 250 == lineage.count() and spark.read.parquet(work.path("ends-1")).count() == 1
