"""Expansion from seeds over a graph under a budget of edges, for many questions at once, with the path to each node found.

Each question looks at edges breadth first: nodes in the order in which they were
found, a node's edges by confidence. Every edge looked at counts, also one that
leads back. All questions go on level by level, and a level needs only as many
edges of a node as the budget has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.storage import Workspace


def expanded(edges: DataFrame, seeds: DataFrame, work: Workspace, budget: int = 8, least: float = 0.0) -> DataFrame:
    """query, node, step (at which of its edges the question found it), and path and kinds from a seed to it.

    ``edges`` has src, dst, kind and confidence and goes both ways; ``seeds`` has
    query and node. Seeds of a question are taken in order, each once. Edges under
    ``least`` and nulls are left out. A question looks at ``budget`` edges at most.
    """
    if budget < 1:
        raise ValueError("the budget must be at least 1")
    sure = edges.where(F.col("confidence") >= least).where("src is not null and dst is not null")
    both = sure.select(F.col("src").alias("node"), F.col("dst").alias("to"), "kind", "confidence").unionByName(sure.select(F.col("dst").alias("node"), F.col("src").alias("to"), "kind", "confidence"))
    order = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("confidence"), "to", "kind"))
    ways = work.put(both.withColumn("way", order).where(F.col("way") <= budget).select("node", "to", "kind", "way"), "ways")
    kind_type = dict(edges.dtypes)["kind"]
    start = seeds.where("query is not null and node is not null").select("query", "node").distinct()
    start = start.select("query", "node", F.row_number().over(Window.partitionBy("query").orderBy("node")).cast("long").alias("step"), F.array("node").alias("path"), F.array().cast(f"array<{kind_type}>").alias("kinds"))
    front = work.put(start, "level-0")
    seen = front.select("query", "node")
    used = None
    found = front.limit(0)
    for level in range(1, budget + 1):
        seen_at = F.row_number().over(Window.partitionBy("query").orderBy("step", "way"))
        looks = front.join(ways, "node").withColumn("at", seen_at).where(F.col("at") <= budget)
        if used is not None:
            looks = looks.join(used, "query").withColumn("at", F.col("at") + F.col("used")).where(F.col("at") <= budget).drop("used")
        looks = work.put(looks.select("query", "to", F.col("at").cast("long").alias("at"), "path", "kind", "kinds"), f"looks-{level}")
        first = looks.groupBy("query", "to").agg(F.min_by(F.struct("at", "path", "kind", "kinds"), "at").alias("x"))
        new = first.select("query", F.col("to").alias("node"), F.col("x.at").alias("step"), F.concat("x.path", F.array("to")).alias("path"), F.concat("x.kinds", F.array("x.kind")).alias("kinds"))
        front = work.put(new.join(seen, ["query", "node"], "left_anti"), f"level-{level}")
        if front.limit(1).count() == 0:
            break
        found = found.unionByName(front)
        seen = seen.unionByName(front.select("query", "node"))
        # An edge looked at before counts for all levels to come.
        used = work.put(looks.groupBy("query").agg(F.max("at").alias("used")), f"used-{level}")
    return found
