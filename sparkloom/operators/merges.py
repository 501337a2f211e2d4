"""Merges of entities: proposed, accepted, reversed, with the lineage by which a merge is taken back.

What becomes of an end of a relation depends only on the entity that it named at
first, so events are applied to these entities, in the order of places and to all
at once: in each round every entity takes the next event that concerns it, be it
the acceptance of a merge of the entity that stands for it now or the reversal of
a merge that has moved it. Rounds are as many as the longest story of one entity.
Relations meet the stories once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.index import checked
from sparkloom.storage import Workspace


def decided(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions with their states, and the accepting and reversing events that count.

    ``events`` has decision, place, action (propose, accept or reverse), origin and
    survivor (of proposals). An acceptance counts once, after its proposal; a
    reversal once, after the acceptance; merges of an entity into itself don't count.
    """
    at = lambda action, after: F.min(F.when((F.col("action") == action) & (F.col("place") > after), F.col("place")))
    asked = events.where("action = 'propose' and origin is not null and survivor is not null and origin <> survivor").groupBy("decision").agg(F.min_by(F.struct("place", "origin", "survivor"), "place").alias("p")).select("decision", "p.*")
    taken = events.select("decision", "action", F.col("place").alias("event")).join(asked, "decision").withColumnRenamed("place", "proposed").withColumnRenamed("event", "place")
    accepted = taken.groupBy("decision", "proposed", "origin", "survivor").agg(at("accept", F.col("proposed")).alias("accepted"))
    both = taken.join(accepted.select("decision", "accepted"), "decision", "left").groupBy("decision", "proposed", "origin", "survivor", "accepted").agg(at("reverse", F.col("accepted")).alias("reversed"))
    state = F.when(F.col("reversed").isNotNull(), "reversed").when(F.col("accepted").isNotNull(), "accepted").otherwise("proposed")
    rows = both.select("decision", "origin", "survivor", "accepted", "reversed", state.alias("state"))
    return rows, rows.where("accepted is not null").select("decision", "origin", "survivor", F.col("accepted").alias("place")), rows.where("reversed is not null").select("decision", "origin", F.col("reversed").alias("place"))


def merged(edges: DataFrame, events: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Edges (edge_id, src, dst) after all events, and the lineage: decision, edge_id, field, origin of every end that a merge moved.

    A reversal puts back what its merge moved, wherever that is by then; the
    decision stays in the lineage. Relations made equal by a merge are not joined.
    """
    rows, accepts, reversals = decided(events)
    decisions = work.put(rows, "decisions")
    accepts = work.put(accepts, "accepts")
    reversals = work.put(reversals, "reversals")
    ends = decisions.select(F.col("origin").alias("was")).distinct()
    ends = work.put(ends.select("was", F.col("was").alias("now"), F.lit(None).cast("long").alias("at"), F.array().cast("array<struct<decision:bigint,origin:bigint>>").alias("moved")), "ends-0")
    turn = 0
    while True:
        later = F.col("at").isNull() | (F.col("place") > F.col("at"))
        to = ends.select("was", "now", "at").join(accepts, F.col("now") == F.col("origin")).where(later).select("was", "place", F.col("survivor").alias("next"), F.struct(F.col("decision").cast("long").alias("decision"), F.col("origin").cast("long").alias("origin")).alias("by"))
        back = ends.select("was", "at", F.explode("moved").alias("m")).select("was", "at", F.col("m.decision").alias("decision")).distinct().join(reversals, "decision").where(later)
        back = back.select("was", "place", F.col("origin").alias("next"), F.lit(None).cast("struct<decision:bigint,origin:bigint>").alias("by"))
        step = work.put(to.unionByName(back).groupBy("was").agg(F.min_by(F.struct("place", "next", "by"), "place").alias("e")), f"step-{turn}")
        if step.limit(1).count() == 0:
            break
        turn += 1
        moved = F.when(F.col("e.by").isNotNull(), F.concat("moved", F.array("e.by"))).otherwise(F.col("moved"))
        hit = F.col("e").isNotNull()
        ends = ends.join(step, "was", "left").select("was", F.when(hit, F.col("e.next")).otherwise(F.col("now")).alias("now"), F.when(hit, F.col("e.place").cast("long")).otherwise(F.col("at")).alias("at"), F.when(hit, moved).otherwise(F.col("moved")).alias("moved"))
        ends = work.put(ends, f"ends-{turn}")
    story = checked(ends.where("at is not null").select("was", "now", "moved"))
    new = lambda c: story.select(F.col("was").alias(c), F.col("now").alias(f"_{c}"))
    out = edges.select("edge_id", "src", "dst").join(new("src"), "src", "left").join(new("dst"), "dst", "left")
    told = lambda c: edges.select("edge_id", F.lit(c).alias("field"), F.col(c).alias("was")).join(story, "was").select(F.explode("moved").alias("m"), "edge_id", "field").select("m.decision", "edge_id", "field", "m.origin")
    # Relations of one id are told of once.
    lineage = told("src").unionByName(told("dst")).distinct()
    return out.select("edge_id", F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")), lineage


def redirects(events: DataFrame) -> DataFrame:
    """origin, survivor and decision of entities that are redirected now: by the last acceptance that is not reversed."""
    rows, _, _ = decided(events)
    return rows.where("state = 'accepted'").groupBy("origin").agg(F.max_by(F.struct("survivor", "decision"), "accepted").alias("r")).select("origin", "r.survivor", "r.decision")
