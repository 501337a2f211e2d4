"""Merging replicas, retention, and the audits of a page store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.names import free


def last_write_wins(local: DataFrame, peer: DataFrame, key: str, clock: str, payload: str) -> DataFrame:
    """key, clock, payload and outcome of a merge: a strictly newer peer row wins, ties keep the local one."""
    p = peer.select(F.col(key), F.col(clock).alias("_pc"), F.col(payload).alias("_pp"))
    both = local.select(key, clock, payload).join(p, key, "full")
    wins = F.col(clock).isNull() | (F.col("_pc") > F.col(clock))
    outcome = F.when(F.col("_pc").isNull(), "local").when(F.col(clock).isNull(), "inserted").when(wins, "updated").otherwise("skipped")
    take = F.col("_pc").isNotNull() & wins
    return both.select(key, F.when(take, F.col("_pc")).otherwise(F.col(clock)).alias(clock), F.when(take, F.col("_pp")).otherwise(F.col(payload)).alias(payload), outcome.alias("outcome"))


def tombstones(rows: DataFrame, deleted: DataFrame, key: str, clock: str) -> DataFrame:
    """Rows that no deletion (key, deleted_at) covers: a deletion wins over a row that isn't newer."""
    d = deleted.groupBy(key).agg(F.max("deleted_at").alias("deleted_at"))
    return rows.join(d, key, "left").where(F.col("deleted_at").isNull() | (F.col("deleted_at") < F.col(clock))).drop("deleted_at")


def hash_diff(a: DataFrame, b: DataFrame, key: str, digest: str = "hash") -> DataFrame:
    """new, modified, deleted or unchanged for each key of two inventories."""
    both = a.select(key, F.col(digest).alias("_a")).join(b.select(key, F.col(digest).alias("_b")), key, "full")
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "deleted").when(F.col("_a") != F.col("_b"), "modified").otherwise("unchanged")
    return both.select(key, state.alias("state"))


def remap(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """An array of ids rewritten by a map (old, new): unknown ids stay, order too. Columns of any name stay."""
    row, pos, was, old, new = free(rows, "_row", "_pos", "_old", "old", "new")
    each = rows.withColumn(row, F.monotonically_increasing_id()).select("*", F.posexplode_outer(column).alias(pos, was))
    known = ids.select(F.col("old").alias(old), F.col("new").alias(new))
    named = each.join(known, F.col(was) == F.col(old), "left").withColumn(new, F.coalesce(new, was))
    keep = [c for c in rows.columns if c != column]
    listed = F.transform(F.sort_array(F.collect_list(F.struct(pos, new))), lambda x: x[new])
    return named.groupBy(row, *keep).agg(listed.alias(column)).select(rows.columns)


def retained(rows: DataFrame, key: str, order: list[Column], keep: int, referenced: DataFrame, ident: str) -> DataFrame:
    """Rows that may go: not referenced, and older than the newest ``keep`` such rows of their key. Columns of any name stay."""
    (n,) = free(rows, "_n")
    there = rows.join(referenced.select(ident).distinct(), ident, "left_anti")
    return there.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(n) > keep).drop(n)


def health_score(errors: Column, warnings: Column, infos: Column, pages: Column) -> Column:
    points = F.floor(100 * (5 * errors + 2 * warnings + infos) / (10 * pages))
    return F.when(pages == 0, F.lit(100)).otherwise(F.greatest(F.lit(0), 100 - points)).cast("long")


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links (page, target) without a page (path): one page of that name is a suggestion and a warning, none or several an error."""
    base = F.substring_index("path", "/", -1)
    names = pages.select(base.alias("name"), "path").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("one"))
    lost = links.join(pages, links["target"] == pages["path"], "left_anti").withColumn("name", F.substring_index("target", "/", -1))
    hit = lost.join(names, "name", "left")
    only = F.coalesce(F.col("n"), F.lit(0)) == 1
    return hit.select("page", "target", F.when(F.trim("target") == "", "error").when(only, "warning").otherwise("error").alias("severity"), F.when(only, F.col("one")).alias("suggestion"))
