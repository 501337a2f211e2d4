"""Evidence for a table of requests: what each route takes, the policy, the budget, and conflicts of snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import packs as P

#: The kinds that each route takes, in the order in which they stand in a pack, with how many at most (null: all); and what a route without any takes in their place.
ROUTES: dict[str, list[tuple[str, int | None]]] = {
    "source-section": [("span", None)],
    "global": [("synthesis", 6), ("report", 10)],
    "explore": [("path", None), ("synthesis", 3), ("report", 3), ("entity", None)],
    "local": [("entity", None), ("span", None), ("hit", 8)],
}
INSTEAD = {"global": [("hit", 8)]}


def shared_first(items: DataFrame, group: str, kind: str) -> DataFrame:
    """Of candidates that all requests of a group share (group, item_id, rank), those that a route can take: no route takes more than its first few of a kind, by rank and id."""
    most = [m for plan in (ROUTES, INSTEAD) for kinds in plan.values() for name, m in kinds if name == kind]
    if None in most:
        return items
    n = F.row_number().over(Window.partitionBy(group).orderBy("rank", "item_id"))
    return items.withColumn("n", n).where(F.col("n") <= max(most, default=0)).drop("n")


def taken(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, route, kind, place, item_id, spans, cost, instead of what routes take from candidates (query_id, kind, item_id, rank, spans, cost).

    Items of one kind go by rank and id; ``instead`` marks those of a route that found nothing of its own.
    """
    spark = requests.sparkSession
    steps = [(route, kind, i, most, instead) for plan, instead in ((ROUTES, False), (INSTEAD, True)) for route, kinds in plan.items() for i, (kind, most) in enumerate(kinds)]
    plan = spark.createDataFrame(steps, "route string, kind string, step int, most int, instead boolean")
    wanted = requests.select("query_id", "route").join(F.broadcast(plan), "route")
    rows = candidates.join(wanted, ["query_id", "kind"])
    n = F.row_number().over(Window.partitionBy("query_id", "kind", "instead").orderBy("rank", "item_id"))
    rows = rows.withColumn("n", n).where("most is null or n <= most")
    own = F.max(~F.col("instead")).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("own", own).where("not instead or not own")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("step", "rank", "item_id"))
    return rows.select("query_id", "route", "kind", place.alias("place"), "item_id", "spans", "cost", "instead")


def context_packs(requests: DataFrame, candidates: DataFrame, allowed: DataFrame, snapshot: str, limit: int) -> DataFrame:
    """One row for each request (query_id, route, expected): status, kept items, used, omitted, excluded, span_ids, warning.

    A request that expects another snapshot than ``snapshot`` is a conflict and
    gets nothing; null expects none. Items with a span that is not among
    ``allowed`` (span_id) are excluded whole; the others are kept one after
    another while they fit, an item that does not fit being left out. An item is
    named as kind:id. Unknown routes take nothing.
    """
    open_ = requests.where(F.col("expected").isNull() | (F.col("expected") == snapshot))
    items = taken(open_, candidates).withColumn("item", F.concat_ws(":", "kind", F.col("item_id").cast("string")))
    known = allowed.select("span_id", F.lit(True).alias("in")).distinct()
    spans = items.select("query_id", "place", F.explode_outer("spans").alias("span_id")).join(known, "span_id", "left")
    judged = spans.groupBy("query_id", "place").agg(F.bool_and(F.col("span_id").isNull() | F.coalesce("in", F.lit(False))).alias("ok"))
    items = items.join(judged, ["query_id", "place"])
    kept = P.first_fit_budget(items.where("ok").select("query_id", "place", F.col("cost").cast("long").alias("cost"), "item"), ["query_id"], ["place"], "cost", "item", limit)
    counts = items.groupBy("query_id").agg(F.count_if("ok").alias("fit"), F.count_if(~F.col("ok")).alias("excluded"), F.max("instead").alias("instead"))
    held = items.where("ok").join(kept.select("query_id", F.explode("kept").alias("item")), ["query_id", "item"], "left_semi")
    cited = held.select("query_id", F.explode("spans").alias("s")).groupBy("query_id").agg(F.array_sort(F.collect_set("s")).alias("span_ids"))
    rows = reduce(lambda a, b: a.join(b, "query_id", "left"), [counts, kept, cited], requests)
    conflict = F.coalesce(F.col("expected") != snapshot, F.lit(False))
    zero = F.lit(0).cast("long")
    kept_items = F.coalesce("kept", F.array().cast("array<string>"))
    status = F.when(conflict, "conflict").when(F.size(kept_items) > 0, "ok").otherwise("empty")
    warning = F.when(F.col("instead"), "no synthesis or report").when(~F.col("route").isin(list(ROUTES)), "unknown route")
    return rows.select(
        "query_id", "route", status.alias("status"), kept_items.alias("kept"), F.coalesce("used", zero).alias("used"), (F.coalesce("fit", zero) - F.size(kept_items)).alias("omitted"),
        F.coalesce("excluded", zero).alias("excluded"), F.coalesce("span_ids", F.array().cast("array<long>")).alias("span_ids"), warning.alias("warning"),
    )


def assembled(pieces: dict[str, DataFrame]) -> DataFrame:
    """Candidates of each kind (query_id, item_id, rank, spans, cost) as one table."""
    cast = lambda df, kind: df.select(F.col("query_id").cast("long").alias("query_id"), F.lit(kind).alias("kind"), F.col("item_id").cast("long").alias("item_id"), F.col("rank").cast("double").alias("rank"), F.col("spans").cast("array<long>").alias("spans"), F.col("cost").cast("long").alias("cost"))
    return reduce(DataFrame.unionByName, [cast(df, kind) for kind, df in pieces.items()])
