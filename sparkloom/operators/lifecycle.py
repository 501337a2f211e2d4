"""What happens to records over time: snapshots, cascades, merges, paths, links between pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.names import free


def snapshot_replace(stored: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """What replacing ``stored`` by ``wanted`` does with each key: inserted, updated, kept or deleted."""
    a, b = stored.select(key, F.col(value).alias("old"), F.lit(True).alias("in_old")), wanted.select(key, F.col(value).alias("new"), F.lit(True).alias("in_new"))
    action = F.when(F.col("in_new").isNull(), "deleted").when(F.col("in_old").isNull(), "inserted").when(F.col("old").eqNullSafe(F.col("new")), "kept").otherwise("updated")
    return a.join(b, key, "full").select(key, action.alias("action"))


def dealt(rows: DataFrame, key: str, parts: int | None) -> DataFrame:
    """Rows in so many partitions by their key, which adaptive execution leaves alone; as they are if no number is given."""
    return rows if parts is None else rows.repartition(parts, key)


def scrub(rows: DataFrame, key: str, ids: str, gone: DataFrame, gone_id: str, parts: int | None = None) -> DataFrame:
    """``rows`` (key, array of ids) without the ids that are gone, in their order; a row may be left with none."""
    each = rows.select(key, F.posexplode_outer(ids).alias("at", "id"))
    left = each.join(gone.select(F.col(gone_id).alias("id")).distinct(), "id", "left_anti").where("id is not null")
    kept = dealt(left, key, parts).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias(ids))
    return rows.select(key).join(kept, key, "left").select(key, F.coalesce(ids, F.array().cast(rows.schema[ids].dataType)).alias(ids))


def first_seen(rows: DataFrame, key: str, ids: str, of: DataFrame, of_id: str, value: str) -> DataFrame:
    """key and the different values that the ids of each row lead to, in the order in which they come first."""
    return first_values(rows.select(key, F.posexplode(ids).alias("at", of_id)), key, ["at"], of, of_id, value)


def first_values(rows: DataFrame, key: str, order: list[str], of: DataFrame, of_id: str, value: str, parts: int | None = None) -> DataFrame:
    """``first_seen`` for ids that stand in rows of their own, ordered by some columns (nulls last): no list of a key's ids is made.

    ``parts`` partitions bound what a task sorts; by itself adaptive execution
    makes them as large as 64 MB of compressed rows, many times that in memory.
    """
    each = dealt(rows.join(of.select(of_id, value).hint("shuffle_hash"), of_id).select(*dict.fromkeys([key, *order, value])), key, parts)
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.asc_nulls_last(c) for c in order], value))
    (at,) = free(each, "_at")
    first = each.select(key, value, place.alias(at)).groupBy(key, value).agg(F.min(at).alias(at))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda x: x[value]).alias(value))


def newest(rows: DataFrame, keys: list[str], clock: str, keep: list[str]) -> DataFrame:
    """One row for each of the keys: the newest by ``clock``; columns in ``keep`` stay as the oldest row has them."""
    by = [F.col(c) for c in keys]
    others = [c for c in rows.columns if c not in keys and c not in keep]
    return rows.groupBy(*by).agg(*[F.max_by(c, clock).alias(c) for c in others], *[F.min_by(c, clock).alias(c) for c in keep])


def rewritten(rows: DataFrame) -> DataFrame:
    """src, dst and state (retired or new) of relations that only ``old`` or only ``now`` rows hold; null ends are equal.

    One aggregation finds both: its flags are combined before they are shuffled, and no set of relations is built for a join.
    """
    seen = rows.where("old or now").groupBy("src", "dst").agg(F.bool_or("old").alias("old"), F.bool_or("now").alias("now"))
    return seen.where("old <> now").select("src", "dst", F.when(F.col("old"), "retired").otherwise("new").alias("state"))


def redirect(edges: DataFrame, merges: DataFrame, work_columns: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """Edges with their ends led to the survivors of accepted merges (origin, survivor), and what they were, so that a merge can be taken back."""
    src, dst = work_columns
    left, right = free(edges, "_s", "_d")
    a, b = merges.select(F.col("origin").alias(src), F.col("survivor").alias(left)), merges.select(F.col("origin").alias(dst), F.col("survivor").alias(right))
    out = edges.join(a, src, "left").join(b, dst, "left").withColumn("was", F.struct(F.col(src).alias("src"), F.col(dst).alias("dst")))
    return out.withColumn(src, F.coalesce(left, src)).withColumn(dst, F.coalesce(right, dst)).drop(left, right)


def restore(edges: DataFrame) -> DataFrame:
    """Edges as they were before ``redirect``."""
    return edges.withColumn("src", F.col("was.src")).withColumn("dst", F.col("was.dst")).drop("was")


def unique_by(pages: DataFrame, key: Column, name: str) -> DataFrame:
    """key and page of the pages that alone have their key."""
    return pages.select(key.alias(name), "page").groupBy(name).agg(F.count_distinct("page").alias("n"), F.min("page").alias("page")).where("n = 1").drop("n")


def resolve(links: DataFrame, pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """links (target) with the page that they mean and how it was found: by its path, else its name, else an alias.

    Case does not matter. Where a stage knows several pages the link is
    ambiguous and no later stage is asked; pages: page, path; aliases: page, alias.
    """
    want = F.lower(F.regexp_replace("target", r"(#.*|\.md)$", ""))
    stem = F.regexp_replace(F.lower("path"), r"\.md$", "")
    rows = links.withColumn("_want", want)
    stages = [("path", pages.select(stem.alias("_want"), "page")), ("name", pages.select(F.element_at(F.split(stem, "/"), -1).alias("_want"), "page")), ("alias", aliases.select(F.lower("alias").alias("_want"), "page"))]
    for name, known in stages:
        found = known.groupBy("_want").agg(F.count_distinct("page").alias(f"_n_{name}"), F.min("page").alias(f"_{name}"))
        rows = rows.join(found, "_want", "left")
    how = F.when(F.col("_n_path") > 0, "path").when(F.col("_n_name") > 0, "name").when(F.col("_n_alias") > 0, "alias")
    many = F.when(F.col("_n_path") > 0, F.col("_n_path") > 1).when(F.col("_n_name") > 0, F.col("_n_name") > 1).otherwise(F.col("_n_alias") > 1)
    page = F.when(how == "path", F.col("_path")).when(how == "name", F.col("_name")).when(how == "alias", F.col("_alias"))
    out = rows.withColumn("found_by", F.when(how.isNull(), "unresolved").when(many, "ambiguous").otherwise(how)).withColumn("page", F.when(~F.coalesce(many, F.lit(True)), page))
    return out.drop("_want", *[f"_{x}{n}" for n, _ in stages for x in ("", "n_")])


def portable(files: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """``files`` with a reference key:relative path by the longest of the roots (key, root) that the path lies under, or null."""
    inside = F.startswith(F.col(path), F.concat("root", F.lit("/"))) & (F.length(path) > F.length("root") + 1)
    each = files.join(F.broadcast(roots), inside, "left")  # roots are a setting, a handful of rows
    best = each.groupBy(*files.columns).agg(F.max_by(F.struct("key", "root"), F.length("root")).alias("r"))
    ref = F.when(F.col("r.key").isNotNull(), F.concat("r.key", F.lit(":"), F.substring(F.col(path), F.length("r.root") + 2, F.length(path))))
    return best.withColumn("ref", ref).drop("r")


def collisions(files: DataFrame, path: Column, file_id: str, content: str) -> DataFrame:
    """Files of one path: the smallest id survives, the others merge into it if their contents are equal and are refused if not."""
    w = Window.partitionBy("path")
    rows = files.select(F.col(file_id).alias("id"), path.alias("path"), F.col(content).alias("content"))
    rows = rows.select("id", F.min("id").over(w).alias("survivor"), F.count(F.lit(1)).over(w).alias("n"), (F.min("content").over(w) == F.max("content").over(w)).alias("same"))
    state = F.when(F.col("id") == F.col("survivor"), "survivor").when(F.col("same"), "merged").otherwise("refused")
    return rows.where("n > 1").select(F.col("id").alias(file_id), "survivor", state.alias("state"))


def locator(relpath: Column, file_type: Column, is_reference: Column, heading: Column, page: Column) -> Column:
    """Where a span is: the kind of its source, and how exactly it can be pointed to."""
    kind = F.when(file_type == "pdf", "vault_pdf").when(is_reference, "external_uri").when(F.startswith(F.ltrim(relpath), F.lit("02_Wiki/")), "promoted_wiki").otherwise("vault_markdown")
    exact = (heading.isNotNull() & (heading != "")) | page.isNotNull()
    status = F.when(F.coalesce(relpath, F.lit("")) == "", "fallback_source").when(exact, "exact").otherwise("fallback_file")
    return F.struct(kind.alias("kind"), status.alias("status"))


def expand(items: DataFrame, keys: list[str], order: list[str], cost: str, item: str, limit: int) -> DataFrame:
    """What a pack holds under its limit, and which of the omitted items fit into the whole of it afterwards.

    A quarter of the limit, 1,000 at most, is kept back for the first pass; the
    second goes on from what was used, against the full limit. Items come in
    their order and one that doesn't fit is passed over.
    """
    first = limit - min(1000, limit // 4)
    listed = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(cost).cast("long").alias("cost"), F.col(item).alias("item")))).alias("rows"))

    def fold(rows: Column, used: Column, most: int) -> Column:
        start = F.struct(used.cast("long").alias("used"), F.array().cast(rows_type).alias("in"), F.array().cast(rows_type).alias("out"))
        fits = lambda a, x: a["used"] + x["cost"] <= most
        return F.aggregate(
            rows, start, lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["cost"]).alias("used"), F.concat(a["in"], F.array(x)).alias("in"), a["out"].alias("out")))
            .otherwise(F.struct(a["used"].alias("used"), a["in"].alias("in"), F.concat(a["out"], F.array(x)).alias("out")))
        )

    rows_type = listed.schema["rows"].dataType
    packed = listed.withColumn("p", fold(F.col("rows"), F.lit(0), first)).withColumn("e", fold(F.col("p.out"), F.col("p.used"), limit))
    ids = lambda c: F.transform(c, lambda x: x["item"])
    return packed.select(*keys, ids(F.col("p.in")).alias("kept"), ids(F.col("e.in")).alias("expanded"), ids(F.col("e.out")).alias("refused"), F.col("e.used").alias("used"))
