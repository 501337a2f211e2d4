"""Any order and repetition of peers' exports gives one state, and replays change nothing."""

import datetime
import random
from itertools import permutations

import pytest

from sparkloom.operators.peers import Replica, Table

TABLES = [
    Table("sources", "sid long, path string, at timestamp_ntz", "sid", ["path"], "at"),
    Table("spans", "pid long, source long, hash string, at timestamp_ntz, note string", "pid", ["source", "hash"], "at", {"source": "sources"}),
    Table("claims", "cid long, name string, span long, at timestamp_ntz", "cid", ["name"], "at", {"span": "spans"}),
]


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def exports():
    """Two peers, two exports each: the second export of a peer refers to rows of its first."""
    a1 = {"sources": [(1, "x", day(1)), (2, "y", day(2)), (None, "z", day(1))], "spans": [(1, 1, "h", day(1), "a"), (2, 2, "h", day(5), "b")], "claims": [(1, "c", 1, day(3))]}
    a2 = {"claims": [(2, "d", 2, day(3)), (1, "c", None, day(2))], "spans": [(1, 1, "h", day(4), "later")]}
    b1 = {"sources": [(9, "x", day(3))], "spans": [(7, 9, "h", day(4), "tie"), (8, 9, "k", day(1), "c")], "claims": [(5, "e", 8, day(1))]}
    b2 = {"sources": [(10, "w", day(1))], "spans": [(11, 10, None, day(1), "no key")], "claims": [(6, "f", 77, day(1))]}
    gone = {("a", 2): {"claims": [(1, day(3))]}, ("b", 2): {"spans": [(8, day(1)), (123, day(9))]}}
    return [(p, n, rows, gone.get((p, n), {})) for p, n, rows in (("a", 1, a1), ("a", 2, a2), ("b", 1, b1), ("b", 2, b2))]


def pulled(spark, root, order):
    replica = Replica(spark, root, TABLES)
    schema = {t.name: t.schema for t in TABLES}
    for peer, n, rows, gone in order:
        replica.pull(peer, str(n), {t: spark.createDataFrame(r, schema[t]) for t, r in rows.items()}, {t: spark.createDataFrame(r, "local long, deleted_at timestamp_ntz") for t, r in gone.items()})
    return replica


def state(replica):
    return {t.name: sorted(map(str, replica.table(t.name).collect())) for t in TABLES}


def test_any_order_gives_one_state(spark, tmp_path):
    all_ = exports()
    want = pulled(spark, f"file://{tmp_path}/0", all_)
    got = {r["path"]: r for r in want.table("sources").collect()}
    spans = {r["note"]: r for r in want.table("spans").collect()}
    assert set(got) == {"x", "y", "w"} and got["x"]["sid"] == 9
    # The peers' spans of one key are one row; the later peer wins a tie; a deletion wins a tie too.
    assert set(spans) == {"tie", "b"} and spans["tie"]["source"] == got["x"]["id"]
    # c is deleted at its last time; e goes with its span; f waits for a span that never comes.
    assert {r["name"]: r["span"] for r in want.table("claims").collect()} == {"d": spans["b"]["id"]}
    rng = random.Random(6)
    for k, order in enumerate(rng.sample(list(permutations(all_)), 2)):
        again = [*order, *rng.sample(order, 2)]
        assert state(pulled(spark, f"file://{tmp_path}/{k + 1}", again)) == state(want)


def test_replays_are_not_read(spark, tmp_path):
    replica = pulled(spark, f"file://{tmp_path}/r", exports()[:1])
    before = replica.versions.latest()
    assert replica.pull("a", "1", {"sources": None}, {})["read"] == 0
    assert replica.versions.latest() == before


def test_tables_come_after_their_parents(spark, tmp_path):
    with pytest.raises(ValueError):
        Replica(spark, f"file://{tmp_path}/x", TABLES[::-1])


def test_an_export_is_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(1, "x", day(1)), (2, "y", day(2))], TABLES[0].schema).mapInArrow(counted, TABLES[0].schema)
    done = Replica(spark, f"file://{tmp_path}/o", TABLES[:1]).pull("a", "1", {"sources": rows}, {})
    assert (done["read"], done["rows"], made.value) == (2, 2, 2)
