"""Budgets and packs: ordered folds over the items of one request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens of a request where none is named, and what is kept back of them for the frame.
DEFAULT_LIMIT, MOST_RESERVED = 16_000, 1_000


def room(limit: int) -> int:
    """What is left of a limit after the reserve."""
    return limit - min(MOST_RESERVED, limit // 4)


def prefix_budget(items: DataFrame, keys: list[str], order: list[str], cost: Column, limit: int) -> DataFrame:
    """Items of each key up to the first that does not fit (it and all after it are left out): column ``kept``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return items.withColumn("kept", F.sum(cost).over(w) <= limit)


def first_fit_budget(items: DataFrame, keys: list[str], order: list[str], cost: str, ident: str, limit: int) -> DataFrame:
    """Items of each key that fit one after another (one that does not fit is skipped): keys and kept, an array of ids.

    The items of one request meet in one row; requests are many and small.
    """
    listed = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(cost).alias("_cost"), F.col(ident).alias("_id")))).alias("_items"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{dict(items.dtypes)[ident]}>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["_cost"] <= limit
        return F.struct(F.when(fits, acc["used"] + x["_cost"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["_id"]))).otherwise(acc["kept"]).alias("kept"))

    return listed.select(*keys, F.aggregate("_items", zero, step).alias("_a")).select(*keys, F.col("_a.kept").alias("kept"), F.col("_a.used").alias("used"))


def handle(kind: str, ident: Column) -> Column:
    """A stable handle of twelve hex digits."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(ident, 256), 1, 12))


def epoch(rows: DataFrame, *columns: str) -> DataFrame:
    """One hash over all rows in order, put together in three levels, so that a task holds a 65,536th of them at most."""
    row = rows.select(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256).alias("h"))
    total = lambda: F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256)
    small = row.groupBy(F.substring("h", 1, 4).alias("b")).agg(total().alias("h"))
    large = small.groupBy(F.substring("b", 1, 2).alias("b")).agg(total().alias("h"))
    return large.agg(F.concat(F.lit("SNAP-"), F.substring(total(), 1, 12)).alias("snapshot"))


def all_in_scope(items: DataFrame, spans: DataFrame, item: str = "item_id") -> DataFrame:
    """Items (item_id, span_id rows) of which every span is in scope (span_id): one outside drops the item."""
    known = spans.select("span_id", F.lit(True).alias("_in")).distinct()
    judged = items.join(known, "span_id", "left").groupBy(item).agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("ok"), F.count(F.lit(1)).alias("spans"))
    return judged.where("ok").select(item, "spans")


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * does not."""
    out, i = "^", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else ("\\" + c if c in r".+()[]{}^$|\\" else c)
            i += 1
    return out + "$"


def in_globs(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Excludes come first; no include takes everything else."""
    hit = lambda gs: F.lit(False) if not gs else F.greatest(*[path.rlike(glob_pattern(g)) for g in gs]) if len(gs) > 1 else path.rlike(glob_pattern(gs[0]))
    return ~hit(exclude) & (hit(include) if include else F.lit(True))


def batched(items: DataFrame, keys: list[str], order: list[str], cost: str, limit: int) -> DataFrame:
    """``items`` of each key in batches of at most ``limit``, in order: column batch, from 0.

    A batch is closed before an item that would take it over the limit; an item
    over the limit is a batch of its own. The items of one key meet in one row.
    """
    row = F.struct(*order, F.col(cost).cast("long").alias("_cost"), F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("_row"))
    listed = items.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("batch"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        over = (a["size"] > 0) & (a["used"] + F.coalesce(x["_cost"], F.lit(0)) > limit)
        batch = F.when(over, a["batch"] + 1).otherwise(a["batch"])
        used = F.when(over, F.lit(0).cast("long")).otherwise(a["used"]) + F.coalesce(x["_cost"], F.lit(0).cast("long"))
        return F.struct(used.alias("used"), F.when(over, 1).otherwise(a["size"] + 1).alias("size"), batch.alias("batch"), F.concat(a["out"], F.array(batch)).alias("out"))

    both = listed.select(F.explode(F.arrays_zip(F.transform("_items", lambda x: x["_row"]).alias("row"), F.aggregate("_items", start, step)["out"].alias("batch"))).alias("z"))
    return both.select("z.row.*", F.col("z.batch").alias("batch"))


#: The least room for a piece of a block, and what stands for what was cut or left out.
WORTH_CUTTING, CUT_HERE = 600, " truncated to fit this turn]"
LEFT_OUT = ("[Omitted to fit this turn, in order of least relevance to the selection: ", ". Answer from what is present; do not assume the omitted material contradicts it.]")


def fitted_turns(blocks: DataFrame, key: str, budget: int) -> DataFrame:
    """The key and parts, an array of what a turn carries of its blocks (key, place, label, text, priority, pinned) within ``budget`` characters.

    Blank blocks don't count. If all fit, all stay. Pinned blocks always stay;
    others by priority and place while they fit. The first that doesn't is cut if
    there is room of over WORTH_CUTTING, and fills it; the rest is left out and
    named at the end. Parts come in the blocks' order.
    """
    said = blocks.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    block = F.struct("place", "label", "text", F.coalesce("priority", F.lit(0)).alias("priority"), F.coalesce("pinned", F.lit(False)).alias("pinned"))
    rows = said.groupBy(key).agg(F.sort_array(F.collect_list(block)).alias("all"), F.sum(F.length("text")).alias("total"), F.sum(F.when(F.col("pinned"), F.length("text")).otherwise(0)).alias("fixed"))
    optional = F.array_sort(F.transform(F.filter("all", lambda b: ~b["pinned"]), lambda b: F.struct(b["priority"].alias("priority"), b["place"].alias("place"), b["label"].alias("label"), b["text"].alias("text"))))
    piece = lambda place, text: F.array(F.struct(place.alias("place"), text.alias("text")))
    pinned = F.transform(F.filter("all", lambda b: b["pinned"]), lambda b: F.struct(b["place"].alias("place"), b["text"].alias("text")))
    start = F.struct((F.lit(budget).cast("long") - F.col("fixed")).alias("room"), pinned.alias("kept"), F.array().cast("array<string>").alias("dropped"))

    def step(a: Column, b: Column) -> Column:
        fits, cut = F.length(b["text"]) <= a["room"], a["room"] > WORTH_CUTTING
        part = F.concat(b["text"].substr(F.lit(1), a["room"].cast("int")), F.lit("\n["), b["label"], F.lit(CUT_HERE))
        return F.struct(
            F.when(fits, a["room"] - F.length(b["text"])).when(cut, F.lit(0).cast("long")).otherwise(a["room"]).alias("room"),
            F.when(fits, F.concat(a["kept"], piece(b["place"], b["text"]))).when(cut, F.concat(a["kept"], piece(b["place"], part))).otherwise(a["kept"]).alias("kept"),
            F.when(fits | cut, a["dropped"]).otherwise(F.concat(a["dropped"], F.array(b["label"]))).alias("dropped"),
        )

    folded = F.aggregate(optional, start, step)
    parts = F.transform(F.array_sort(folded["kept"]), lambda x: x["text"])
    note = F.when(F.size(folded["dropped"]) > 0, F.array(F.concat(F.lit(LEFT_OUT[0]), F.array_join(folded["dropped"], ", "), F.lit(LEFT_OUT[1])))).otherwise(F.array().cast("array<string>"))
    whole = F.transform("all", lambda b: b["text"])
    return rows.select(key, F.when(F.col("total") <= budget, whole).otherwise(F.concat(parts, note)).alias("parts"))
