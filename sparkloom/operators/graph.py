"""The knowledge graph: entities, relations, communities, paths and closures."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.names import free
from sparkloom.operators.components import connected_components
from sparkloom.storage import Workspace, partitions


#: Rows of a bucket of edges: few enough for a task's memory, enough to outweigh the task.
BUCKET_ROWS = 2_000_000


def merge_entities(rows: DataFrame) -> DataFrame:
    """Rows (name, type, spans, description, ts) of one entity as one: spans united, the newest description that says something."""
    said = F.when(F.trim("description") != "", F.col("description"))
    return rows.groupBy("name", "type").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.max_by(said, F.when(said.isNotNull(), F.struct("ts", "description"))).alias("description"),
        F.count(F.lit(1)).alias("merged"),
    )


def neighbourhood(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges (edge_id, src, dst) that touch a seed (node), whichever way they run, each once."""
    a = edges.join(seeds, edges["src"] == seeds["node"], "left_semi")
    b = edges.join(seeds, edges["dst"] == seeds["node"], "left_semi")
    return a.unionByName(b).distinct()


def communities(nodes: DataFrame, edges: DataFrame, work: Workspace) -> DataFrame:
    """node and component of every node, those without edges too."""
    parts = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), work)
    return nodes.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def bridges(edges: DataFrame, parts: DataFrame, work: Workspace) -> DataFrame:
    """Edges whose loss would cut a component in two parts of two nodes or more; parallel edges and loops never do.

    A breadth-first tree grows from the root of each component, all of them level
    by level. Each edge outside the tree puts one random number on both its ends;
    the numbers of a subtree, combined by exclusive or, cancel out exactly when no
    such edge leaves it, and then the edge above the subtree is a bridge (a chance
    of 2**-64 aside). No component is ever in one place.
    """
    pair = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("edge_id").alias("edge_id"))
    pair = work.put(pair, "bridge-pairs")
    both = pair.select(F.col("a").alias("x"), F.col("b").alias("y"), "edge_id").unionByName(pair.select(F.col("b").alias("x"), F.col("a").alias("y"), "edge_id"))
    none = F.lit(None).cast(dict(pair.dtypes)["edge_id"]).alias("via")
    roots = parts.select("component").distinct().select(F.col("component").alias("node"), none, F.lit(None).cast(dict(pair.dtypes)["a"]).alias("up"), F.lit(0).alias("depth"))
    levels = [work.put(roots, "bridge-level-0")]
    seen = levels[0].select("node")
    while True:
        step = both.join(levels[-1].select(F.col("node").alias("x")), "x").join(seen.select(F.col("node").alias("y")), "y", "left_anti")
        first = step.groupBy(F.col("y").alias("node")).agg(F.min(F.struct("x", "edge_id")).alias("t"))
        level = work.put(first.select("node", F.col("t.edge_id").alias("via"), F.col("t.x").alias("up"), F.lit(len(levels)).alias("depth")), f"bridge-level-{len(levels)}")
        if level.limit(1).count() == 0:
            break
        levels.append(level)
        # A node's neighbours are on its own level and the two beside it.
        seen = level.select("node").unionByName(levels[-2].select("node"))
    tree = levels[0].limit(0)
    for level in levels[1:]:
        tree = tree.unionByName(level)
    tree = work.put(tree, "bridge-tree")
    back = both.join(tree.select(F.col("via").alias("edge_id")), "edge_id", "left_anti").groupBy(F.col("x").alias("node")).agg(F.bit_xor(F.xxhash64(F.lit("bridge"), "edge_id")).alias("mark"))
    own = work.put(tree.join(back, "node", "left").select("node", "via", "up", "depth", F.coalesce("mark", F.lit(0).cast("long")).alias("mark"), F.lit(1).cast("long").alias("size")), "bridge-marks")
    below: DataFrame | None = None
    whole: DataFrame | None = None
    for d in range(len(levels) - 1, 0, -1):
        rows = own.where(F.col("depth") == d)
        if below is not None:
            rows = rows.join(below, "node", "left").select("node", "via", "up", "depth", F.col("mark").bitwiseXOR(F.coalesce("more", F.lit(0).cast("long"))).alias("mark"), (F.col("size") + F.coalesce("held", F.lit(0).cast("long"))).alias("size"))
        rows = work.put(rows, f"bridge-up-{d}")
        below = rows.groupBy(F.col("up").alias("node")).agg(F.bit_xor("mark").alias("more"), F.sum("size").alias("held"))
        whole = rows if whole is None else whole.unionByName(rows)
    if whole is None:
        return pair.limit(0).select("edge_id")
    totals = parts.groupBy("component").agg(F.count(F.lit(1)).alias("total"))
    cut = whole.where("mark = 0 and size >= 2").join(parts, "node").join(totals, "component").where("total - size >= 2")
    return cut.select(F.col("via").alias("edge_id")).join(pair.where("n = 1"), "edge_id", "left_semi")


def lifecycle(relations: DataFrame, nodes: DataFrame, authored: DataFrame, contradicted: DataFrame, bridge: DataFrame, least: int = 1) -> DataFrame:
    """The state of each relation (edge_id, src, dst, supports): the first of the tests that applies; an authored one needs no further proof."""
    known = lambda c, name: nodes.select(F.col("node").alias(c), F.lit(True).alias(name))
    rows = relations.join(known("src", "_s"), "src", "left").join(known("dst", "_d"), "dst", "left")
    rows = rows.join(contradicted.select("edge_id", F.lit(True).alias("_c")), "edge_id", "left").join(bridge.select("edge_id", F.lit(True).alias("_b")), "edge_id", "left")
    rows = rows.join(authored.select("edge_id", F.lit(True).alias("_a")), "edge_id", "left")
    state = (
        F.when(F.col("src") == F.col("dst"), "self_loop").when(F.col("_s").isNull() | F.col("_d").isNull(), "endpoint_unresolved").when(F.col("_a"), "active")
        .when(F.col("_c"), "contradiction").when(F.col("_b"), "bridge_risk").when(F.col("supports") < least, "unsupported").otherwise("active")
    )
    return rows.select("edge_id", state.alias("state"))


def paths(edges: DataFrame, seeds: DataFrame, domain: DataFrame, most: int = 20) -> DataFrame:
    """Paths of one and two hops from seeds (node) over edges (edge_id, src, dst, confidence, has_span), either way, no node twice.

    Score: (0.35 + 0.25 * mean confidence + 0.20 if a hop has a span + 0.10 if the
    end is one of ``domain`` (node)) / hops. Each seed keeps its first ``most``
    paths, edges taken in the order of their ids and a path before what goes on from it.
    """
    way = lambda a, b: edges.select("edge_id", F.col(a).alias("a"), F.col(b).alias("b"), "confidence", "has_span")
    both = way("src", "dst").unionByName(way("dst", "src"))
    one = seeds.join(both, seeds["node"] == both["a"]).where("b <> node").select("node", F.col("edge_id").alias("e1"), F.col("b").alias("via"), "confidence", "has_span")
    far = both.select(F.col("a").alias("via"), F.col("edge_id").alias("e2"), F.col("b").alias("end"), F.col("confidence").alias("c2"), F.col("has_span").alias("s2"))
    two = one.join(far, "via").where("end <> node and end <> via")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    found = one.select("node", "e1", none("long", "e2"), "via", none("long", "end"), F.col("confidence").alias("mean"), "has_span", F.lit(1).alias("hops")).unionByName(
        two.select("node", "e1", "e2", "via", "end", ((F.col("confidence") + F.col("c2")) / 2).alias("mean"), (F.col("has_span") | F.col("s2")).alias("has_span"), F.lit(2).alias("hops"))
    )
    first = F.row_number().over(Window.partitionBy("node").orderBy("e1", F.asc_nulls_first("e2"), "via", "end"))
    kept = found.withColumn("n", first).where(F.col("n") <= most).withColumn("last", F.coalesce("end", "via"))
    fits = domain.select(F.col("node").alias("last")).distinct().withColumn("fits", F.lit(True))
    score = (0.35 + 0.25 * F.col("mean") + F.when(F.col("has_span"), 0.20).otherwise(0.0) + F.when(F.col("fits"), 0.10).otherwise(0.0)) / F.col("hops")
    return kept.join(fits, "last", "left").select("node", "via", "end", F.round(score, 6).alias("score"))


def closure(edges: DataFrame, start: DataFrame, work: Workspace) -> DataFrame:
    """Nodes below the start (node) over edges (src, dst), with the least depth: a frontier that leaves visited nodes out, until it is empty."""
    seen = frontier = work.put(start.select("node", F.lit(0).cast("long").alias("depth")).distinct(), "closure-0")
    for d in count(1):
        step = edges.join(frontier, edges["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = work.put(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d).cast("long")), f"closure-{d}")
        if frontier.limit(1).count() == 0:
            return seen
        seen = seen.unionByName(frontier)
        if d % 16 == 0:  # one table again, so that the plan stays short
            seen = work.put(seen, f"closure-{d}-all")
    raise AssertionError("count never ends")


def pagerank(edges: DataFrame, seeds: DataFrame, work: Workspace, rounds: int = 30, damping: float = 0.85) -> DataFrame:
    """Personalised PageRank over undirected weighted edges (src, dst, weight); a node without edges keeps its share.

    The walk from the seeds is taken alone, step after step, and the ranks are the
    sum of its places, each weighed by its chance of going no further: places that
    the walk does not hold at a step ask no edges (in a graph of two kinds of nodes
    that is half of them). Edges are written once in buckets of their sources, so
    that only places and their sums are shuffled. Where the walk goes no further
    than some of the nodes, the edges of the others are left out from then on.
    """
    edges = work.put(edges.select("src", "dst", "weight"), "pagerank-edges")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    total = work.put(both.groupBy("src").agg(F.sum("weight").alias("total")), "pagerank-totals")
    step = both.join(total.hint("shuffle_hash"), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p"))
    step = work.bucket(step, "pagerank-steps", "src", partitions(both, BUCKET_ROWS))
    work.drop("pagerank-edges")
    n, nodes = seeds.count(), total.count()
    walk = [work.put(seeds.select("node", F.lit(1.0 / n).alias("r")), "pagerank-0")]
    held = [n]
    for i in range(1, rounds + 1):
        moved = step.join(walk[-1].hint("shuffle_hash"), step["src"] == walk[-1]["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("r")).alias("r"))
        walk.append(work.put(moved, f"pagerank-{i}"))
        if not held:
            continue
        held.append(walk[-1].count())
        # The walk can go back, so what it holds after a first step it holds again two steps later: equal numbers are equal nodes.
        if held[-1] == 0:
            break
        if i > 2 and held[i] == held[i - 2]:
            if 2 * (held[i] + held[i - 1]) < nodes and i < rounds:
                reached = walk[i].select("node").unionByName(walk[i - 1].select("node")).distinct()
                step = work.put(step.join(reached, step["src"] == reached["node"], "left_semi"), "pagerank-reached")
                step = work.bucket(step, "pagerank-reached-steps", "src", partitions(step, BUCKET_ROWS))
                work.drop("pagerank-steps")
            held = []
    work.drop(*work.named)
    stays = [(damping**i * (1 - damping if i < rounds else 1.0), w) for i, w in enumerate(walk)]
    ranks = reduce(DataFrame.unionByName, [w.select("node", (F.lit(c) * F.col("r")).alias("r")) for c, w in stays])
    return ranks.groupBy("node").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("r"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order. Columns of any name stay."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    (n,) = free(rows, "_n")
    return rows.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)
