"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import Workspace


def connected_components(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b", name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that has an edge to another.

    Edges are undirected; loops, repeats and rows with a null end are ignored.
    Nodes need an order. Every round is written to the shared folder, minima are
    combined before they are shuffled. A hub's edges meet in one partition of a
    join, which Spark's adaptive execution splits (both joins are inner and need no order).
    """
    e = edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = work.put(e, f"{name}-0")
    before, last = None, f"{name}-0"
    for i in range(1, max_rounds + 1):
        # Large star: every larger neighbour of a node is linked to the least one that the node knows.
        least = e.select(F.col("v").alias("y"), "v").unionByName(e.select(F.col("u").alias("y"), "v")).groupBy("y").agg(F.min("v").alias("m"))
        e = e.join(least, F.col("v") == F.col("y")).select("u", F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours are linked to the least of them.
        least = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "y")
        pair = e.join(least, F.col("u") == F.col("y"))
        e = pair.select("u", F.col("m").alias("v")).unionByName(pair.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = work.put(e, f"{name}-{i}")
        work.drop(last)
        last = f"{name}-{i}"
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
