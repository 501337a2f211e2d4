"""Expansion of many questions at once against a queue for each."""

import random
from collections import defaultdict, deque

import pytest

from sparkloom.operators.expansion import expanded
from sparkloom.storage import Workspace


def brute(edges, seeds, budget, least):
    ways = defaultdict(list)
    for s, d, kind, c in edges:
        if s is not None and d is not None and c >= least:
            ways[s].append((-c, d, kind))
            ways[d].append((-c, s, kind))
    out = {}
    for q in {q for q, _ in seeds}:
        start = sorted({n for p, n in seeds if p == q})
        queue, seen, used = deque((n, (n,), ()) for n in start), set(start), 0
        while queue and used < budget:
            node, path, kinds = queue.popleft()
            for _, to, kind in sorted(ways[node]):
                if used >= budget:
                    break
                used += 1
                if to not in seen:
                    seen.add(to)
                    out[q, to] = (used, path + (to,), kinds + (kind,))
                    queue.append((to, path + (to,), kinds + (kind,)))
    return out


@pytest.mark.parametrize("seed, nodes, budget", [(1, 30, 8), (2, 12, 25)])
def test_expansion_equals_brute_force(spark, seed, nodes, budget):
    rng = random.Random(seed)
    edges = [(rng.randrange(nodes), rng.randrange(nodes), rng.choice("ab"), rng.randrange(10) / 10) for _ in range(40)] + [(None, 1, "a", 1.0)]
    seeds = [(q, rng.randrange(nodes)) for q in range(12) for _ in range(rng.randrange(1, 4))] + [(0, 999), (3, 5), (3, 5)]
    e, s = spark.createDataFrame(edges, "src long, dst long, kind string, confidence double"), spark.createDataFrame(seeds, "query long, node long")
    got = {(r["query"], r["node"]): (r["step"], tuple(r["path"]), tuple(r["kinds"])) for r in expanded(e, s, Workspace(spark, "x"), budget, 0.3).collect()}
    assert got == brute(edges, seeds, budget, 0.3)


def test_expansion_of_nothing(spark):
    e, s = spark.createDataFrame([], "src long, dst long, kind string, confidence double"), spark.createDataFrame([(1, 2)], "query long, node long")
    assert expanded(e, s, Workspace(spark, "x")).count() == 0
    with pytest.raises(ValueError):
        expanded(e, s, Workspace(spark, "x"), 0)
