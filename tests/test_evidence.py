"""Packs of evidence against a plain program."""

import random

from sparkloom.operators import evidence as E


def test_packs_equal_a_plain_program(spark):
    rng = random.Random(8)
    kinds = ["span", "synthesis", "report", "path", "entity", "hit"]
    requests = [(q, rng.choice([*E.ROUTES, "odd"]), rng.choice([None, "S1", "S1", "S0"])) for q in range(60)]
    found = [(q, k, i, float(rng.randrange(5)), [rng.randrange(30) for _ in range(rng.randrange(3))], rng.randrange(1, 60)) for q in range(60) for k in kinds if rng.random() < 0.6 for i in range(rng.randrange(1, 14))]
    allowed = set(range(26))
    frames = spark.createDataFrame(requests, "query_id long, route string, expected string"), spark.createDataFrame(found, "query_id long, kind string, item_id long, rank double, spans array<long>, cost long"), spark.createDataFrame([(s,) for s in [*allowed, 3]], "span_id long")
    got = {r["query_id"]: r for r in E.context_packs(*frames, "S1", 200).collect()}
    assert len(got) == 60
    for q, route, expected in requests:
        of = lambda plan: [x for kind, most in plan for x in sorted((f for f in found if f[:2] == (q, kind)), key=lambda f: (f[3], f[2]))[:most]]  # noqa: E731, B023
        items, instead = of(E.ROUTES.get(route, [])), False
        if not items and route in E.INSTEAD:
            items = of(E.INSTEAD[route])
            instead = bool(items)
        if expected == "S0":
            items, instead = [], False
        fit = [f for f in items if set(f[4]) <= allowed]
        used, kept = 0, []
        for f in fit:
            if used + f[5] <= 200:
                used += f[5]
                kept.append(f)
        r = got[q]
        assert r["status"] == ("conflict" if expected == "S0" else "ok" if kept else "empty")
        assert r["kept"] == [f"{f[1]}:{f[2]}" for f in kept] and r["used"] == used
        assert (r["omitted"], r["excluded"]) == (len(fit) - len(kept), len(items) - len(fit))
        assert r["span_ids"] == sorted({s for f in kept for s in f[4]})
        assert r["warning"] == ("no synthesis or report" if instead else "unknown route" if route == "odd" else None)


def test_what_requests_share_is_cut_to_what_a_route_takes(spark):
    rows = spark.createDataFrame([(g, i, float(i % 7)) for g in (1, 2) for i in range(50)], "nation long, item_id long, rank double")
    got = sorted((r["nation"], r["item_id"]) for r in E.shared_first(rows, "nation", "synthesis").collect())
    assert got == [(g, i) for g in (1, 2) for i in sorted(sorted(range(50), key=lambda i: (i % 7, i))[:6])]
    assert E.shared_first(rows, "nation", "span").count() == 100
