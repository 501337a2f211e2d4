"""Queries over notes and books: places of edits, windows of long notes, numbered objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import captions as C
from sparkloom.operators import edits as E
from sparkloom.operators import evidence as V
from sparkloom.operators import packs as P
from sparkloom.plans.tables import table
from sparkloom.registry import query


@query("edit_match", r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 8 = 1 THEN text || chr(10) || text ELSE text END AS text, string_split(text, chr(10)) AS own FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, CASE doc_id % 4 WHEN 0 THEN array_to_string(own[2:3], chr(10)) WHEN 1 THEN '  ' || array_to_string(own[2:4], chr(10) || '  ') WHEN 2 THEN own[1] || chr(10) || 'changed' || chr(10) || coalesce(own[3], '') ELSE 'nowhere to be found' END AS search FROM d),
f AS (SELECT *, strpos(text, search) - 1 AS place, list_transform(lines, lambda x: trim(x)) AS a, list_transform(string_split(search, chr(10)), lambda x: trim(x)) AS b FROM e),
g AS (SELECT *, list_filter(range(0, greatest(0, len(a) - len(b) + 1)), lambda i: a[i + 1:i + len(b)] = b) AS runs, list_filter(b, lambda x: x <> '') AS says FROM f),
h AS (SELECT *, CASE WHEN len(b) >= 3 AND len(says) >= 2 AND len(runs) = 0 THEN list_filter(range(0, len(a)), lambda i: a[i + 1] = says[1] AND coalesce(list_position(a[i + 2:len(a)], says[len(says)]), 0) > 0) ELSE [] END AS firsts FROM g),
k AS (SELECT *, list_position(a[firsts[1] + 2:len(a)], says[len(says)]) + 1 AS count FROM h),
s AS (SELECT *, CASE WHEN search = '' THEN 'none' WHEN place >= 0 THEN 'exact' WHEN len(runs) = 1 THEN 'line_trim' WHEN len(runs) > 1 THEN 'ambiguous' WHEN len(firsts) = 1 AND count <= 3 * len(b) THEN 'anchored' WHEN len(firsts) > 1 THEN 'ambiguous' ELSE 'none' END AS strategy FROM k),
p AS (SELECT *, CASE strategy WHEN 'line_trim' THEN runs[1] WHEN 'anchored' THEN firsts[1] END AS first, CASE strategy WHEN 'line_trim' THEN len(b) WHEN 'anchored' THEN count END AS n FROM s),
q AS (SELECT *, CASE WHEN strategy = 'exact' THEN place ELSE length(array_to_string(lines[1:first], chr(10))) + CASE WHEN first > 0 THEN 1 ELSE 0 END END AS start FROM p)
SELECT doc_id AS edit_id, strategy, CASE WHEN strategy IN ('exact', 'line_trim', 'anchored') THEN CAST(start AS BIGINT) END AS start, CASE WHEN strategy = 'exact' THEN CAST(start + length(search) AS BIGINT) WHEN strategy IN ('line_trim', 'anchored') THEN CAST(start + length(array_to_string(lines[first + 1:first + n], chr(10))) AS BIGINT) END AS "end" FROM q""")
def edit_match(spark: SparkSession, sf: str) -> DataFrame:
    """Where edits belong that quote their document as it is, indented, with a line changed, or not at all; some documents hold everything twice."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", F.split("text", "\n", -1).alias("own"))
    docs = d.select("doc_id", F.when(F.col("doc_id") % 8 == 1, F.concat_ws("\n", "text", "text")).otherwise(F.col("text")).alias("text"))
    search = (
        F.when(F.col("doc_id") % 4 == 0, F.array_join(F.slice("own", 2, 2), "\n")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("  "), F.array_join(F.slice("own", 2, 3), "\n  ")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.element_at("own", 1), F.lit("\nchanged\n"), F.coalesce(F.try_element_at("own", F.lit(3)), F.lit("")))).otherwise("nowhere to be found")
    )
    return E.edit_places(docs, d.select(F.col("doc_id").alias("edit_id"), "doc_id", search.alias("search")))


@query("note_windows")
def note_windows(spark: SparkSession, sf: str) -> DataFrame:
    """What of each document, its lines taken as sections, fits a reader who has marked its end and asks with its middle."""
    d = table(spark, sf, "documents").where("text is not null")
    note = F.regexp_replace("text", "\n", "\n## ")
    middle = F.col("text").substr((F.length("text") / 2).cast("int"), F.lit(60))
    window = E.note_window(note, middle, F.col("text").substr(F.greatest(F.length("text") - 50, F.lit(1)), F.lit(60)), 1200)
    return d.select("doc_id", window.alias("window"))


@query("caption_lookup", """WITH i AS (SELECT brand, item_id, any_value(kind) AS kind, any_value(size) AS size FROM items WHERE brand IS NOT NULL AND item_id IS NOT NULL AND kind IS NOT NULL AND size IS NOT NULL GROUP BY brand, item_id),
o AS (SELECT brand, item_id AS page, CAST(size % 5 AS VARCHAR) || '.' || (item_id % 3) AS number,
  max(CASE WHEN item_id % 7 = 0 THEN item_id END) OVER w AS p1, max(CASE WHEN item_id % 3 = 0 AND item_id % 7 <> 0 THEN item_id END) OVER w AS p2 FROM i WINDOW w AS (PARTITION BY brand ORDER BY item_id)),
named AS (SELECT o.brand, page, number, concat_ws('/', CASE WHEN p1 IS NOT NULL THEN 'part ' || p1 END, CASE WHEN p2 IS NOT NULL AND (p1 IS NULL OR p2 > p1) THEN 'piece ' || p2 END) AS sections FROM o),
m AS (SELECT brand, item_id, item_id AS page, CAST((size + 1) % 5 AS VARCHAR) || '.' || ((item_id + 1) % 3) AS number FROM i),
b AS (SELECT m.*, n.page AS back FROM m ASOF LEFT JOIN named n ON m.brand = n.brand AND m.number = n.number AND m.page > n.page),
f AS (SELECT b.*, n.page AS ahead FROM b ASOF LEFT JOIN named n ON b.brand = n.brand AND b.number = n.number AND b.page <= n.page),
x AS (SELECT *, CASE WHEN back IS NULL OR (ahead - page) * 1.15 < page - back THEN coalesce(ahead, back) ELSE back END AS found FROM f)
SELECT x.item_id, x.number, found AS found_page, n.sections FROM x LEFT JOIN named n ON n.brand = x.brand AND n.number = x.number AND n.page = found""")
def caption_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand is a book with a page for each item: the figures that pages mention, where they are defined, and in which sections."""
    i = table(spark, sf, "items").where("brand is not null and item_id is not null and kind is not null and size is not null").groupBy("brand", "item_id").agg(F.min("kind").alias("kind"), F.min("size").alias("size"))
    heading = F.when(F.col("item_id") % 7 == 0, F.concat(F.lit("# part "), "item_id")).when(F.col("item_id") % 3 == 0, F.concat(F.lit("## piece "), "item_id")).otherwise(F.col("kind"))
    text = F.concat_ws("\n", heading, F.concat(F.lit("Figure "), (F.col("size") % 5).cast("string"), F.lit("."), (F.col("item_id") % 3).cast("string"), F.lit(": what it looks like")), F.lit("see Figure 1.1 and Table 2"))
    pages = i.select(F.col("brand").alias("doc_id"), F.col("item_id").alias("page"), text.alias("text"))
    lines = C.lines_of(pages)
    figures = C.captions(lines).where("kind = 'figure'")
    number = F.concat(((F.col("size") + 1) % 5).cast("string"), F.lit("."), ((F.col("item_id") + 1) % 3).cast("string"))
    mentions = i.select(F.col("item_id").alias("mention_id"), F.col("brand").alias("doc_id"), F.lit("figure").alias("kind"), number.alias("number"), F.col("item_id").alias("page"))
    found = C.resolved(mentions, figures)
    around = C.enclosing(lines).select("doc_id", F.col("page").alias("found_page"), F.col("line").alias("found_line"), F.array_join("sections", "/").alias("sections"))
    return found.join(around, ["doc_id", "found_page", "found_line"], "left").select(F.col("mention_id").alias("item_id"), "number", "found_page", "sections")


_ROUTE = "CASE c_custkey % 4 WHEN 0 THEN 'source-section' WHEN 1 THEN 'global' WHEN 2 THEN 'explore' ELSE 'local' END"
_EXPECTED = "CASE WHEN c_custkey % 9 = 4 THEN 'S0' WHEN c_custkey % 2 = 0 THEN 'S1' END"


def _plan_sql() -> str:
    rows = [(route, kind, i, most, instead) for plan, instead in ((V.ROUTES, "false"), (V.INSTEAD, "true")) for route, kinds in plan.items() for i, (kind, most) in enumerate(kinds)]
    return ", ".join(f"('{r}', '{k}', {i}, {m or 'NULL'}, {x})" for r, k, i, m, x in rows)


@query("context_packs", f"""WITH RECURSIVE req AS (SELECT c_custkey AS query_id, c_nationkey, {_ROUTE} AS route, {_EXPECTED} AS expected FROM customer), plan(route, kind, step, most, instead) AS (VALUES {_plan_sql()}),
cand AS (SELECT o_custkey AS query_id, 'span' AS kind, o_orderkey AS item_id, 0.0::DOUBLE AS rank, [o_orderkey] AS spans, CAST(ceil(o_totalprice / 1000) AS BIGINT) AS cost FROM orders
  UNION ALL SELECT o_custkey, 'hit', o_orderkey, -o_totalprice, [o_orderkey], 5 + o_orderkey % 20 FROM orders
  UNION ALL SELECT o_custkey, 'entity', l_partkey, 0.0, [min(l_orderkey)], 10 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45 GROUP BY o_custkey, l_partkey
  UNION ALL SELECT query_id, 'synthesis', s_suppkey, -s_acctbal, [], 20 FROM req JOIN supplier ON s_nationkey = c_nationkey WHERE c_nationkey % 5 <> 0),
r0 AS (SELECT req.query_id, req.route, cand.kind, step, most, instead, rank, item_id, spans, cost, row_number() OVER (PARTITION BY req.query_id, cand.kind, instead ORDER BY rank, item_id) AS n FROM req JOIN plan USING (route) JOIN cand ON cand.query_id = req.query_id AND cand.kind = plan.kind WHERE coalesce(expected, 'S1') = 'S1'),
r1 AS (SELECT *, bool_or(NOT instead) OVER (PARTITION BY query_id) AS own FROM r0 WHERE most IS NULL OR n <= most),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step, rank, item_id) AS place, kind || ':' || item_id AS item FROM r1 WHERE NOT instead OR NOT own),
bad AS (SELECT DISTINCT query_id, place, TRUE AS bad FROM (SELECT query_id, place, unnest(spans) AS s FROM r2) JOIN orders ON o_orderkey = s AND o_orderstatus = 'F'), r3 AS (SELECT r2.*, bad IS NULL AS ok FROM r2 LEFT JOIN bad USING (query_id, place)),
fits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS k FROM r3 WHERE ok),
f AS (SELECT query_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS kept FROM fits WHERE k = 1
  UNION ALL SELECT f.query_id, fits.k, CASE WHEN used + cost <= 100 THEN used + cost ELSE used END, CASE WHEN used + cost <= 100 THEN list_append(kept, fits.k) ELSE kept END FROM f JOIN fits ON fits.query_id = f.query_id AND fits.k = f.k + 1),
e AS (SELECT query_id, arg_max(used, k) AS used, arg_max(kept, k) AS kept FROM f GROUP BY query_id),
held AS (SELECT fits.query_id, string_agg(item, ',' ORDER BY fits.k) AS items, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(spans)))), ',') AS span_ids FROM fits JOIN e ON e.query_id = fits.query_id AND list_contains(e.kept, fits.k) GROUP BY fits.query_id),
c AS (SELECT query_id, count(*) FILTER (ok) AS fit, count(*) FILTER (NOT ok) AS excluded, bool_or(instead) AS instead FROM r3 GROUP BY query_id)
SELECT req.query_id, req.route, CASE WHEN expected = 'S0' THEN 'conflict' WHEN held.n > 0 THEN 'ok' ELSE 'empty' END AS status, coalesce(items, '') AS kept, CAST(coalesce(used, 0) AS BIGINT) AS used, CAST(coalesce(fit, 0) - coalesce(held.n, 0) AS BIGINT) AS omitted,
  CAST(coalesce(excluded, 0) AS BIGINT) AS excluded, coalesce(span_ids, '') AS span_ids, CASE WHEN instead THEN 'no synthesis or report' END AS warning FROM req LEFT JOIN c USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN held USING (query_id)""")
def context_packs(spark: SparkSession, sf: str) -> DataFrame:
    """Packs for customers by four routes: orders as spans and hits, large lines as entities, suppliers as syntheses; finished orders are out of scope."""
    t = lambda name: table(spark, sf, name)
    requests = t("customer").select(F.col("c_custkey").alias("query_id"), "c_nationkey", F.expr(_ROUTE).alias("route"), F.expr(_EXPECTED).alias("expected"))
    orders = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), F.array("o_orderkey").alias("spans"), "o_totalprice", "o_orderkey")
    lines = t("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    # Requests of a nation have the same suppliers: each nation's are cut to what a route can take before they meet its requests.
    suppliers = V.shared_first(t("supplier").select("s_nationkey", F.col("s_suppkey").alias("item_id"), (-F.col("s_acctbal")).alias("rank")), "s_nationkey", "synthesis")
    pieces = {
        "span": orders.select("query_id", "item_id", F.lit(0.0).alias("rank"), "spans", F.ceil(F.col("o_totalprice") / 1000).alias("cost")),
        "hit": orders.select("query_id", "item_id", (-F.col("o_totalprice")).alias("rank"), "spans", (5 + F.col("item_id") % 20).alias("cost")),
        "entity": orders.join(lines, "o_orderkey").groupBy("query_id", F.col("l_partkey").alias("item_id")).agg(F.array(F.min("o_orderkey")).alias("spans")).select("query_id", "item_id", F.lit(0.0).alias("rank"), "spans", F.lit(10).alias("cost")),
        "synthesis": requests.where("c_nationkey % 5 <> 0").join(suppliers, F.col("c_nationkey") == F.col("s_nationkey")).select("query_id", "item_id", "rank", F.array().cast("array<long>").alias("spans"), F.lit(20).alias("cost")),
    }
    allowed = t("orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("span_id"))
    out = V.context_packs(requests.drop("c_nationkey"), V.assembled(pieces), allowed, "S1", 100)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("query_id", "route", "status", listed("kept"), "used", F.col("omitted").cast("long").alias("omitted"), "excluded", listed("span_ids"), "warning")


@query("span_batches", """WITH RECURSIVE o AS (SELECT conv_id, turn, length(coalesce(text, '')) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, n, turn, cost AS used, 0 AS batch FROM o WHERE n = 1 UNION ALL SELECT o.conv_id, o.n, o.turn, CASE WHEN used + cost > 1000 THEN cost ELSE used + cost END, CASE WHEN used + cost > 1000 THEN batch + 1 ELSE batch END FROM f JOIN o ON o.conv_id = f.conv_id AND o.n = f.n + 1)
SELECT conv_id, turn, CAST(batch AS BIGINT) AS batch FROM f""")
def span_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The turns of each conversation in batches of a thousand characters."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("cost"))
    return P.batched(turns, ["conv_id"], ["turn"], "cost", 1000).select("conv_id", "turn", "batch")


@query("turn_parts", f"""WITH RECURSIVE b AS (SELECT conv_id, turn, role || turn AS label, text, length(text) % 5 AS priority, turn = 0 AS pinned FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
t AS (SELECT conv_id, sum(length(text)) AS total, coalesce(sum(length(text)) FILTER (pinned), 0) AS fixed, list(text ORDER BY turn) AS whole, list({{'place': turn, 'text': text}} ORDER BY turn) FILTER (pinned) AS pinned FROM b GROUP BY conv_id),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY priority, turn) AS n FROM b WHERE NOT pinned),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, CAST(1500 - fixed AS BIGINT) AS room, coalesce(pinned, []) AS kept, CAST([] AS VARCHAR[]) AS dropped FROM t WHERE total > 1500
  UNION ALL SELECT f.conv_id, o.n, CASE WHEN length(text) <= room THEN room - length(text) WHEN room > 600 THEN 0 ELSE room END,
    CASE WHEN length(text) <= room THEN list_append(kept, {{'place': turn, 'text': text}}) WHEN room > 600 THEN list_append(kept, {{'place': turn, 'text': substr(text, 1, room) || chr(10) || '[' || label || '{P.CUT_HERE}'}}) ELSE kept END,
    CASE WHEN length(text) <= room OR room > 600 THEN dropped ELSE list_append(dropped, label) END FROM f JOIN o ON o.conv_id = f.conv_id AND o.n = f.n + 1),
e AS (SELECT conv_id, arg_max(kept, n) AS kept, arg_max(dropped, n) AS dropped FROM f GROUP BY conv_id)
SELECT t.conv_id, sha256(array_to_string(CASE WHEN e.conv_id IS NULL THEN whole ELSE list_concat(list_transform(list_sort(kept), lambda x: x.text), CASE WHEN len(dropped) > 0 THEN ['{P.LEFT_OUT[0]}' || array_to_string(dropped, ', ') || '{P.LEFT_OUT[1]}'] ELSE [] END) END, chr(10))) AS parts_sha256, e.conv_id IS NOT NULL AS cut FROM t LEFT JOIN e USING (conv_id)""")
def turn_parts(spark: SparkSession, sf: str) -> DataFrame:
    """What fits 1,500 characters of each conversation's turns: the first always, others by a priority."""
    c = table(spark, sf, "conversations").where("text is not null")
    blocks = c.select("conv_id", F.col("turn").alias("place"), F.concat("role", F.col("turn").cast("string")).alias("label"), "text", (F.length("text") % 5).alias("priority"), (F.col("turn") == 0).alias("pinned"))
    total = blocks.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").groupBy("conv_id").agg((F.sum(F.length("text")) > 1500).alias("cut"))
    return P.fitted_turns(blocks, "conv_id", 1500).join(total, "conv_id").select("conv_id", F.sha2(F.array_join("parts", "\n"), 256).alias("parts_sha256"), "cut")
