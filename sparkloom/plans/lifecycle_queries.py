"""Queries over records as they change: cascades, merges, revisions, locators, sections, links, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import questions as Q
from sparkloom.functions import text as T
from sparkloom.operators import lifecycle as L
from sparkloom.plans.knowledge_queries import EDGES, PART, relations
from sparkloom.plans.store_queries import ITEMS, items
from sparkloom.plans.tables import table
from sparkloom.registry import query
from sparkloom.storage import partitions


def joined(column: str | Column) -> Column:
    return F.array_join(F.col(column).cast("array<string>") if isinstance(column, str) else column, ",")


#: Lines of a partition: what a task sorts and groups stays in some tens of MB.
LINES_EACH = 500_000
ORDER_PARTS = "rows_ AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY l_orderkey)"


def order_parts(lines: DataFrame, parts: int) -> DataFrame:
    rows = L.dealt(lines.select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey"), "k", parts).groupBy("k")
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))


@query("span_cascade", f"""WITH {ORDER_PARTS}, gone AS (SELECT coalesce(list(p_partkey), []) AS g FROM part WHERE p_size = 9)
SELECT k, array_to_string(list_filter(ids, lambda i: NOT list_contains(g, i)), ',') AS ids FROM rows_, gone""")
def span_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' arrays of parts without the parts of one size, which are deleted."""
    gone = table(spark, sf, "part").where("p_size = 9")
    lines = table(spark, sf, "lineitem")
    parts = partitions(lines, LINES_EACH)
    return L.scrub(order_parts(lines, parts), "k", "ids", gone, "p_partkey", parts).select("k", joined("ids").alias("ids"))


@query("first_seen_sources", f"""WITH {ORDER_PARTS}, e AS (SELECT k, unnest(ids) AS p, generate_subscripts(ids, 1) AS pos FROM rows_), f AS (SELECT k, p_brand, min(pos) AS pos FROM e JOIN part ON p = p_partkey GROUP BY k, p_brand)
SELECT k, string_agg(p_brand, ',' ORDER BY pos) AS brands FROM f GROUP BY k""")
def first_seen_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The sources (brands) of an order's spans (parts) in the order in which they come first."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey")
    out = L.first_values(lines, "k", ["l_linenumber", "l_partkey"], parts, "l_partkey", "p_brand", partitions(lines, LINES_EACH))
    return out.select("k", F.when(F.size(F.array_compact("p_brand")) > 0, F.array_join("p_brand", ",")).alias("brands"))


@query("snapshot_replace", """
WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 4 = 0 THEN '.' ELSE '' END) AS h FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.doc_id IS NULL THEN 'inserted' WHEN a.h = b.h THEN 'kept' ELSE 'updated' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def snapshot_replace(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    later = F.concat("text", F.when(F.col("doc_id") % 4 == 0, ".").otherwise(""))
    return L.snapshot_replace(d.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("h")), d.where("doc_id % 5 <> 0").select("doc_id", F.sha2(later, 256).alias("h")), "doc_id", "h")


@query("index_eligibility", """
WITH live AS (SELECT p_partkey FROM part WHERE p_size > 3), r AS (SELECT l_orderkey AS id, count(*) AS spans, count(DISTINCT l_partkey) AS kinds, count(p_partkey) AS held FROM lineitem LEFT JOIN live ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT id, 'report' AS family FROM r WHERE held = spans UNION ALL SELECT id, 'entity' FROM r WHERE held > 0 AND kinds > 1
UNION ALL SELECT doc_id, 'unit' FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0""")
def index_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """What each family puts into the index: reports whose spans all live, entities with a living span, units that are verified."""
    live = table(spark, sf, "part").where("p_size > 3").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("live"))
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(live, "l_partkey", "left").groupBy(F.col("l_orderkey").alias("id"))
    r = r.agg(F.count(F.lit(1)).alias("spans"), F.count_distinct("l_partkey").alias("kinds"), F.count("live").alias("held"))
    units = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").where("quality = 1 and toxic = 0"), "doc_id")
    family = lambda df, key, name: df.select(F.col(key).alias("id"), F.lit(name).alias("family"))
    return family(r.where("held = spans"), "id", "report").unionByName(family(r.where("held > 0 and kinds > 1"), "id", "entity")).unionByName(family(units, "doc_id", "unit"))


@query("source_lookup", """
WITH asked(q) AS (VALUES ('17'), ('src3/en/33.md'), ('/src3/en/33.md '), ('x'), ('00017')), d AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents)
SELECT q, min(doc_id) AS doc_id FROM asked LEFT JOIN d ON CASE WHEN regexp_matches(q, '^[0-9]+$') THEN doc_id = CAST(CASE WHEN regexp_matches(q, '^[0-9]+$') THEN q END AS BIGINT) ELSE path = ltrim(trim(q), '/') END GROUP BY q""")
def source_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by their number or by their path, whichever a handle looks like."""
    asked = spark.createDataFrame([("17",), ("src3/en/33.md",), ("/src3/en/33.md ",), ("x",), ("00017",)], "q string")
    number = F.col("q").rlike("^[0-9]+$")
    asked = asked.select("q", F.when(number, F.col("q").try_cast("bigint").cast("string")).otherwise(F.regexp_replace(F.trim("q"), "^/+", "")).alias("key"))
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))
    keys = d.select(F.col("doc_id").cast("string").alias("key"), "doc_id").unionByName(d.select(F.col("path").alias("key"), "doc_id"))
    return asked.join(keys, "key", "left").groupBy("q").agg(F.min("doc_id").alias("doc_id"))


#: Names of sections that are headings without a number.
SECTION_NAMES = ["abstract", "introduction", "background", "related work", "motivation", "methodology", "methods", "method", "approach", "experiment", "experiments", "evaluation", "results",
                 "discussion", "conclusion", "conclusions", "future work", "acknowledgment", "acknowledgments", "acknowledgements", "references", "bibliography", "appendix"]
_LINES = """pages_ AS (SELECT conv_id AS doc, turn AS page, CASE turn % 4 WHEN 0 THEN (turn + 1) || '. Section of page' WHEN 1 THEN 'RESULTS AND ' || upper(role) WHEN 2 THEN 'Conclusion' ELSE 'plain ' || role END || chr(10) || text AS text FROM conversations),
lines AS (SELECT doc, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM pages_),
heads AS (SELECT doc, page, n, trim(line) AS title, CASE WHEN regexp_matches(trim(line), '^([0-9]+\\.)+\\s+[A-Z]') THEN greatest(1, length(split_part(trim(line), ' ', 1)) - length(replace(split_part(trim(line), ' ', 1), '.', ''))) ELSE 1 END AS level FROM lines
  WHERE length(trim(line)) BETWEEN 1 AND 80 AND (regexp_matches(trim(line), '^([0-9]+\\.)+\\s+[A-Z]') OR regexp_matches(trim(line), '^[A-Z][A-Z\\s\\-/]{2,49}$') OR (length(trim(line)) <= 40 AND list_contains(NAMES, rtrim(lower(trim(line)), '.:')))))""".replace("NAMES", "[" + ", ".join(f"'{n}'" for n in SECTION_NAMES) + "]")


def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as pages of their conversation, each with a first line that may be a heading."""
    turn = F.col("turn")
    first = F.when(turn % 4 == 0, F.concat((turn + 1).cast("string"), F.lit(". Section of page"))).when(turn % 4 == 1, F.concat(F.lit("RESULTS AND "), F.upper("role"))).when(turn % 4 == 2, "Conclusion").otherwise(F.concat(F.lit("plain "), "role"))
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), turn.alias("page"), F.concat(first, F.lit("\n"), "text").alias("text"))
    return pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def headings(lines: DataFrame) -> DataFrame:
    """Lines (line) that look like headings, with title and level: numbered, in capitals, or with a known name."""
    t = F.trim("line")
    numbered, first = t.rlike(r"^([0-9]+\.)+\s+[A-Z]"), F.split_part(t, F.lit(" "), F.lit(1))
    known = (F.length(t) <= 40) & F.regexp_replace(F.lower(t), "[.:]+$", "").isin(SECTION_NAMES)
    found = lines.where((F.length(t) >= 1) & (F.length(t) <= 80) & (numbered | t.rlike(r"^[A-Z][A-Z\s\-/]{2,49}$") | known))
    level = F.when(numbered, F.greatest(F.lit(1), F.length(first) - F.length(F.replace(first, F.lit("."), F.lit(""))))).otherwise(1)
    return found.select(*[c for c in lines.columns if c != "line"], t.alias("title"), level.cast("long").alias("level"))


@query("heading_lines", f"WITH {_LINES} SELECT doc, page, CAST(n AS BIGINT) AS n, title, CAST(level AS BIGINT) AS level FROM heads")
def heading_lines(spark: SparkSession, sf: str) -> DataFrame:
    return headings(page_lines(spark, sf)).withColumn("n", F.col("n").cast("long"))


@query("layout_sections", f"""WITH {_LINES}, h AS (SELECT doc, page, min(title) AS title FROM heads GROUP BY doc, page), r AS (SELECT *, lead(page) OVER (PARTITION BY doc ORDER BY page) AS next, count(*) OVER (PARTITION BY doc) AS k FROM h)
SELECT r.doc, r.page, r.title, CAST(count(*) AS BIGINT) AS pages, CAST(sum(length(p.text)) AS BIGINT) AS chars FROM r JOIN pages_ p ON p.doc = r.doc AND p.page >= r.page AND (r.next IS NULL OR p.page < r.next) WHERE k >= 2 GROUP BY r.doc, r.page, r.title""")
def layout_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections from a page with a heading to the next one: an ordered fill-forward in place of a range join; two headings at least."""
    lines = page_lines(spark, sf)
    heads = headings(lines).groupBy("doc", "page").agg(F.min("title").alias("title"))
    sizes = lines.groupBy("doc", "page").agg((F.sum(F.length("line")) + F.count(F.lit(1)) - 1).alias("chars"))
    w = Window.partitionBy("doc").orderBy("page")
    rows = sizes.join(heads, ["doc", "page"], "left").withColumn("start", F.last(F.when(F.col("title").isNotNull(), F.struct("page", "title")), True).over(w)).withColumn("k", F.count("title").over(Window.partitionBy("doc")))
    out = rows.where("k >= 2 and start is not null").groupBy("doc", F.col("start.page").alias("page"), F.col("start.title").alias("title"))
    return out.agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"))


@query("atom_names", """
WITH n AS (SELECT p_partkey, p_name, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' (no. ' || p_size || ')'), '\\([^)]*\\)', '', 'g'), '[^a-z0-9가-힣]+', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM part)
SELECT key, min(p_partkey) AS first_id, CAST(count(*) AS BIGINT) AS candidates FROM n GROUP BY key""")
def atom_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names without what stands in brackets and without signs; the first candidate of each stays."""
    named = F.lower(F.concat("p_name", F.lit(" (no. "), F.col("p_size").cast("string"), F.lit(")")))
    key = F.trim(F.regexp_replace(F.regexp_replace(named, r"\([^)]*\)", ""), "[^a-z0-9가-힣]+", " "))
    return table(spark, sf, "part").groupBy(key.alias("key")).agg(F.min("p_partkey").alias("first_id"), F.count(F.lit(1)).alias("candidates"))


@query("many_authoritative", """SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey HAVING count(*) > 1""")
def many_authoritative(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with more than one authoritative generation."""
    rows = table(spark, sf, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    return rows.where(F.size("ids") > 1).select("o_custkey", joined("ids").alias("ids"))


@query("latest_revision", """SELECT CAST(max(t) AS VARCHAR) AS revision FROM (SELECT max(o_orderdate) AS t FROM orders UNION ALL SELECT max(l_shipdate) FROM lineitem UNION ALL SELECT max(ts) FROM events)""")
def latest_revision(spark: SparkSession, sf: str) -> DataFrame:
    """The newest clock of all tables."""
    clocks = [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]
    each = [table(spark, sf, t).agg(F.max(c).alias("t")) for t, c in clocks]
    return each[0].unionByName(each[1]).unionByName(each[2]).agg(F.max("t").cast("string").alias("revision"))


@query("row_revisions", """SELECT l_orderkey, l_linenumber, CAST(greatest(l_shipdate, o_orderdate + INTERVAL 30 DAY) AS VARCHAR) AS revision FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def row_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """The clock of a row whose own is frozen: the later of its own and its parent's."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("o_orderdate + make_dt_interval(30)").alias("parent"))
    return table(spark, sf, "lineitem").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", F.greatest("l_shipdate", "parent").cast("string").alias("revision"))


@query("two_index_merge", """
WITH a AS (SELECT doc_id, -round(length(text) / 7.0, 4) AS score FROM documents WHERE contains(text, 'tion') ORDER BY score, doc_id LIMIT 60), b AS (SELECT doc_id, -round(length(text) / 5.0, 4) AS score FROM documents WHERE contains(text, 'the') ORDER BY score, doc_id LIMIT 60),
m AS (SELECT doc_id, min(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id)
SELECT m.doc_id, m.score FROM m JOIN documents USING (doc_id) WHERE lang <> 'fr' ORDER BY m.score, m.doc_id LIMIT 30""")
def two_index_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of two indexes, each with twice the limit: the better score of each document, then the families, then the limit."""
    d = table(spark, sf, "documents")
    hits = lambda word, by: d.where(F.contains("text", F.lit(word))).select("doc_id", "lang", (-F.round(F.length("text") / by, 4)).alias("score")).orderBy("score", "doc_id").limit(60)
    best = hits("tion", 7.0).unionByName(hits("the", 5.0)).groupBy("doc_id", "lang").agg(F.min("score").alias("score"))
    return best.where("lang <> 'fr'").orderBy("score", "doc_id").limit(30).select("doc_id", "score")


@query("broken_target_counts", """
WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS target FROM pages), known AS (SELECT DISTINCT '/' || regexp_extract(html, '<h1>([A-Za-z]+)', 1) AS target FROM pages)
SELECT target, CAST(count(*) AS BIGINT) AS pages FROM l WHERE target NOT IN (SELECT target FROM known) GROUP BY target HAVING count(*) >= 3""")
def broken_target_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Targets that three pages or more link to and that are not there."""
    p = table(spark, sf, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), 1)).alias("target")).distinct()
    known = p.select(F.concat(F.lit("/"), F.regexp_extract("html", "<h1>([A-Za-z]+)", 1)).alias("target")).distinct()
    return links.join(known, "target", "left_anti").groupBy("target").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 3")


@query("session_retention", """SELECT user_id, CAST(count(*) AS BIGINT) AS dropped FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY user_id""")
def session_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Rows older than ten days before the newest."""
    e = table(spark, sf, "events")
    newest = e.agg(F.expr("max(ts) - make_dt_interval(10)").alias("since"))
    return e.crossJoin(F.broadcast(newest)).where("ts < since").groupBy("user_id").agg(F.count(F.lit(1)).alias("dropped"))


@query("top_syntheses", """SELECT p_partkey, p_retailprice FROM part WHERE p_size > 20 ORDER BY p_retailprice DESC, p_partkey LIMIT 6""")
def top_syntheses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_size > 20").orderBy(F.desc("p_retailprice"), "p_partkey").limit(6).select("p_partkey", "p_retailprice")


@query("oldest_queued", """SELECT event_type, min(event_id) AS event_id FROM events WHERE event_id % 7 <> 0 GROUP BY event_type""")
def oldest_queued(spark: SparkSession, sf: str) -> DataFrame:
    """The job that is next in each queue."""
    return table(spark, sf, "events").where("event_id % 7 <> 0").groupBy("event_type").agg(F.min("event_id").alias("event_id"))


@query("listed_order", """
WITH ids AS (SELECT [40, 3, 7, 99, 3, 12] AS wanted) SELECT doc_id, CAST(list_position(wanted, doc_id) AS BIGINT) AS place FROM documents, ids WHERE list_contains(wanted, doc_id)""")
def listed_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the order of a list of ids."""
    wanted = F.array(*[F.lit(i).cast("long") for i in (40, 3, 7, 99, 3, 12)])
    return table(spark, sf, "documents").where(F.array_contains(wanted, F.col("doc_id"))).select("doc_id", F.array_position(wanted, F.col("doc_id")).alias("place"))


@query("search_doc_fields", """
SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]') THEN 'ko' ELSE '' END AS language,
  CASE WHEN doc_id % 3 = 0 THEN '01_Contexts/' || source || '.md' WHEN doc_id % 3 = 1 THEN '02_Atoms/ATM-' || doc_id || '.md' ELSE '' END AS projection,
  'CHK-' || doc_id || '-0-' || substr(sha256(sha256(text)), 1, 8) AS chunk_id, sha256(text) AS input_hash FROM documents""")
def search_doc_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Language tag, projection path and chunk identity of indexed records."""
    of = F.col("doc_id") % 3
    path = F.when(of == 0, F.concat(F.lit("01_Contexts/"), "source", F.lit(".md"))).when(of == 1, F.concat(F.lit("02_Atoms/ATM-"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise("")
    digest = F.sha2("text", 256)
    chunk = F.concat(F.lit("CHK-"), F.col("doc_id").cast("string"), F.lit("-0-"), F.substring(F.sha2(digest, 256), 1, 8))
    return table(spark, sf, "documents").select("doc_id", F.when(Q.east_asian(F.col("text")), "ko").otherwise("").alias("language"), path.alias("projection"), chunk.alias("chunk_id"), digest.alias("input_hash"))


@query("fallback_terms", """
SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '[^\\p{L}\\p{N}_./+-]+', ' ', 'g'), '\\s+'), lambda w: length(w) > 1), ' ') AS terms FROM benchmark""")
def fallback_terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", Q.fallback_terms(F.col("text")).alias("terms"))


@query("span_locators", """
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 5 = 0 THEN '02_Wiki/' || doc_id ELSE source || '/' || doc_id END AS relpath, CASE doc_id % 4 WHEN 0 THEN 'pdf' ELSE 'md' END AS file_type, doc_id % 11 = 0 AS is_reference, CASE WHEN doc_id % 3 = 0 THEN lang END AS heading, CASE WHEN doc_id % 13 = 0 THEN doc_id END AS page FROM documents)
SELECT doc_id, CASE WHEN file_type = 'pdf' THEN 'vault_pdf' WHEN is_reference THEN 'external_uri' WHEN starts_with(relpath, '02_Wiki/') THEN 'promoted_wiki' ELSE 'vault_markdown' END AS kind, CASE WHEN relpath = '' THEN 'fallback_source' WHEN heading IS NOT NULL OR page IS NOT NULL THEN 'exact' ELSE 'fallback_file' END AS status FROM s""")
def span_locators(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    path = F.when(d % 7 == 0, "").when(d % 5 == 0, F.concat(F.lit("02_Wiki/"), d.cast("string"))).otherwise(F.concat_ws("/", "source", d.cast("string")))
    where = L.locator(path, F.when(d % 4 == 0, "pdf").otherwise("md"), d % 11 == 0, F.when(d % 3 == 0, F.col("lang")), F.when(d % 13 == 0, d))
    return table(spark, sf, "documents").select("doc_id", where.alias("w")).select("doc_id", "w.kind", "w.status")


@query("expand_omitted", f"""WITH RECURSIVE {ITEMS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM items),
f AS (SELECT conv_id, 0 AS n, CAST(0 AS BIGINT) AS used, '' AS kept, '' AS "left" FROM o WHERE n = 1
  UNION ALL SELECT o.conv_id, o.n, CASE WHEN used + cost <= 150 THEN used + cost ELSE used END, CASE WHEN used + cost <= 150 THEN kept || o.turn || ',' ELSE kept END, CASE WHEN used + cost <= 150 THEN "left" ELSE "left" || o.turn || ',' END FROM f JOIN o ON o.conv_id = f.conv_id AND o.n = f.n + 1),
p AS (SELECT conv_id, arg_max(used, n) AS used, arg_max(kept, n) AS kept, arg_max("left", n) AS "left" FROM f GROUP BY conv_id),
q AS (SELECT p.conv_id, row_number() OVER (PARTITION BY p.conv_id ORDER BY turn) AS n, turn, cost FROM p JOIN items ON items.conv_id = p.conv_id AND list_contains(string_split("left", ','), CAST(turn AS VARCHAR))),
g AS (SELECT conv_id, 0 AS n, used, '' AS extra, '' AS refused FROM p
  UNION ALL SELECT q.conv_id, q.n, CASE WHEN used + cost <= 200 THEN used + cost ELSE used END, CASE WHEN used + cost <= 200 THEN extra || q.turn || ',' ELSE extra END, CASE WHEN used + cost <= 200 THEN refused ELSE refused || q.turn || ',' END FROM g JOIN q ON q.conv_id = g.conv_id AND q.n = g.n + 1)
SELECT p.conv_id, rtrim(kept, ',') AS kept, rtrim(arg_max(extra, n), ',') AS expanded, rtrim(arg_max(refused, n), ',') AS refused, CAST(arg_max(g.used, n) AS BIGINT) AS used FROM p JOIN g USING (conv_id) GROUP BY p.conv_id, kept""")
def expand_omitted(spark: SparkSession, sf: str) -> DataFrame:
    """Packs under three quarters of 200 tokens, then the omitted items against all of them."""
    out = L.expand(items(spark, sf), ["conv_id"], ["turn"], "cost", "turn", 200)
    return out.select("conv_id", joined("kept").alias("kept"), joined("expanded").alias("expanded"), joined("refused").alias("refused"), "used")


@query("page_window", """
WITH c AS (SELECT conv_id, turn, length(text) - length(replace(text, 'e', '')) AS score, text FROM conversations), w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS n FROM c WHERE turn BETWEEN 2 - 2 AND 2 + 2)
SELECT conv_id, turn, CAST(score AS BIGINT) AS score FROM w WHERE n <= 3""")
def page_window(spark: SparkSession, sf: str) -> DataFrame:
    """Of the pages around the one that is open, the three that fit a question best."""
    score = F.length("text") - F.length(F.replace("text", F.lit("e"), F.lit("")))
    near = table(spark, sf, "conversations").where("turn between 0 and 4").select("conv_id", "turn", score.cast("long").alias("score"))
    return near.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn"))).where("n <= 3").drop("n")


@query("extraction_resume", """
WITH now AS (SELECT doc_id, sha256('extract v2|' || text) AS prompt FROM documents), old AS (SELECT DISTINCT sha256(CASE WHEN doc_id % 6 = 0 THEN 'extract v1|' ELSE 'extract v2|' END || text) AS prompt FROM documents WHERE doc_id % 4 <> 1)
SELECT doc_id, prompt FROM now WHERE prompt NOT IN (SELECT prompt FROM old)""")
def extraction_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Batches whose prompt has no stored answer: the others are taken from there."""
    d = table(spark, sf, "documents")
    prompt = lambda version: F.sha2(F.concat(version, F.lit("|"), "text"), 256).alias("prompt")
    old = d.where("doc_id % 4 <> 1").select(prompt(F.when(F.col("doc_id") % 6 == 0, "extract v1").otherwise("extract v2"))).distinct()
    return d.select("doc_id", prompt(F.lit("extract v2"))).join(old, "prompt", "left_anti").select("doc_id", "prompt")


@query("formula_invalidation", """
WITH r AS (SELECT doc_id, sha256(text) AS page_hash, CASE doc_id % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'reviewed' ELSE 'rejected' END AS status FROM documents), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' ' ELSE text END) AS page_hash FROM documents WHERE doc_id % 17 <> 0)
SELECT doc_id, CASE WHEN r.status IN ('candidate', 'reviewed') AND (n.page_hash IS NULL OR n.page_hash <> r.page_hash) THEN 'rejected: stale_page_hash' ELSE r.status END AS status, coalesce(r.status = 'reviewed' AND (n.page_hash IS NULL OR n.page_hash <> r.page_hash), false) AS unit_stale FROM r LEFT JOIN n USING (doc_id)""")
def formula_invalidation(spark: SparkSession, sf: str) -> DataFrame:
    """Recovered formulas whose page has changed or gone are rejected, and what rests on a reviewed one goes stale."""
    d, k = table(spark, sf, "documents"), F.col("doc_id") % 3
    r = d.select("doc_id", F.sha2("text", 256).alias("was"), F.when(k == 0, "candidate").when(k == 1, "reviewed").otherwise("rejected").alias("status"))
    now = d.where("doc_id % 17 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("now"))
    changed = ~F.col("was").eqNullSafe(F.col("now"))
    status = F.when(F.col("status").isin("candidate", "reviewed") & changed, "rejected: stale_page_hash").otherwise(F.col("status"))
    return r.join(now, "doc_id", "left").select("doc_id", status.alias("status"), ((F.col("status") == "reviewed") & changed).alias("unit_stale"))


@query("relation_upsert", """
SELECT l_suppkey AS src, l_partkey AS dst, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS content, arg_min(l_linestatus, (l_shipdate, l_orderkey, l_linenumber)) AS lifecycle FROM lineitem GROUP BY l_suppkey, l_partkey""")
def relation_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The newest content of a relation; its life cycle stays what it was at first."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("content"), F.col("l_linestatus").alias("lifecycle"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("clock"))
    return L.newest(rows, ["src", "dst"], "clock", ["lifecycle"]).select("src", "dst", "content", "lifecycle")


MERGES = f"merges AS (SELECT p_partkey + {PART} AS origin, min(p_partkey) OVER (PARTITION BY p_name, p_brand) + {PART} AS survivor FROM part)"


@query("merge_redirect", f"""WITH {EDGES}, {MERGES}, m AS (SELECT * FROM merges WHERE origin <> survivor)
SELECT edge_id, src, coalesce(survivor, dst) AS dst, dst AS was FROM e LEFT JOIN m ON dst = origin""")
def merge_redirect(spark: SparkSession, sf: str) -> DataFrame:
    """Relations led to the survivors of merged entities, with what they were."""
    least = F.min("p_partkey").over(Window.partitionBy("p_name", "p_brand"))
    merges = table(spark, sf, "part").select((F.col("p_partkey") + PART).alias("origin"), (least + PART).alias("survivor")).where("origin <> survivor")
    return L.redirect(relations(spark, sf).select("edge_id", "src", "dst"), merges).select("edge_id", "src", "dst", F.col("was.dst").alias("was"))


PAGES = """pg AS (SELECT page_id AS page, CASE page_id % 3 WHEN 0 THEN 'notes/' WHEN 1 THEN 'other/' ELSE '' END || regexp_extract(html, '<h1>([A-Za-z]+)', 1) || '.md' AS path FROM pages),
al AS (SELECT page_id AS page, a AS alias FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS a FROM pages WHERE page_id % 10 = 0)),
li AS (SELECT page_id, a AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS a FROM pages) UNION ALL SELECT page_id, 'Notes/' || regexp_extract(html, '<h1>([A-Za-z]+)', 1) || '.md' FROM pages)"""


@query("link_resolution", f"""WITH {PAGES}, l AS (SELECT page_id, target, lower(regexp_replace(target, '(#.*|\\.md)$', '')) AS want FROM li), k AS (SELECT page, regexp_replace(lower(path), '\\.md$', '') AS stem FROM pg),
s1 AS (SELECT stem AS want, count(DISTINCT page) AS n, min(page) AS page FROM k GROUP BY stem), s2 AS (SELECT string_split(stem, '/')[-1] AS want, count(DISTINCT page) AS n, min(page) AS page FROM k GROUP BY string_split(stem, '/')[-1]), s3 AS (SELECT lower(alias) AS want, count(DISTINCT page) AS n, min(page) AS page FROM al GROUP BY lower(alias))
SELECT page_id, target, CASE WHEN coalesce(s1.n, s2.n, s3.n) IS NULL THEN 'unresolved' WHEN coalesce(s1.n, s2.n, s3.n) > 1 THEN 'ambiguous' WHEN s1.n > 0 THEN 'path' WHEN s2.n > 0 THEN 'name' ELSE 'alias' END AS found_by, CASE WHEN coalesce(s1.n, s2.n, s3.n) = 1 THEN coalesce(s1.page, s2.page, s3.page) END AS page
FROM l LEFT JOIN s1 USING (want) LEFT JOIN s2 USING (want) LEFT JOIN s3 USING (want)""")
def link_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Authored links by path, name and alias."""
    p = table(spark, sf, "pages")
    head = F.regexp_extract("html", "<h1>([A-Za-z]+)", 1)
    folder = F.when(F.col("page_id") % 3 == 0, "notes/").when(F.col("page_id") % 3 == 1, "other/").otherwise("")
    words = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), 1)).alias("target"))
    links = words.unionByName(p.select("page_id", F.concat(F.lit("Notes/"), head, F.lit(".md")).alias("target")))
    aliases = words.where("page_id % 10 = 0").select(F.col("page_id").alias("page"), F.col("target").alias("alias"))
    return L.resolve(links, p.select(F.col("page_id").alias("page"), F.concat(folder, head, F.lit(".md")).alias("path")), aliases).select("page_id", "target", "found_by", "page")


@query("authored_retired", """
WITH old AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % 2 = 0), now AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey % 3 = 0)
SELECT src, dst, 'retired' AS state FROM (SELECT * FROM old EXCEPT SELECT * FROM now) UNION ALL SELECT src, dst, 'new' FROM (SELECT * FROM now EXCEPT SELECT * FROM old)""")
def authored_retired(spark: SparkSession, sf: str) -> DataFrame:
    """Authored relations that are no longer written down, and those that are new."""
    written = lambda n: F.expr(f"coalesce(l_orderkey % {n} = 0, false)")
    l = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), written(2).alias("old"), written(3).alias("now"))  # noqa: E741
    return L.rewritten(l)


@query("evidence_traces", """
SELECT c_custkey AS synthesis, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS reports, CAST(count(DISTINCT l_partkey) AS BIGINT) AS units, CAST(count(DISTINCT l_partkey) FILTER (p_partkey IS NULL) AS BIGINT) AS broken
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <> 7) p ON l_partkey = p_partkey GROUP BY c_custkey""")
def evidence_traces(spark: SparkSession, sf: str) -> DataFrame:
    """From the top layer down to what it rests on, and which of that is gone."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")  # noqa: E741
    p = table(spark, sf, "part").where("p_size <> 7").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("there"))
    rows = table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey").join(l, "o_orderkey").join(p, "l_partkey", "left").groupBy(F.col("c_custkey").alias("synthesis"))
    return rows.agg(F.count_distinct("o_orderkey").alias("reports"), F.count_distinct("l_partkey").alias("units"), F.count_distinct(F.when(F.col("there").isNull(), F.col("l_partkey"))).alias("broken"))


@query("audit_bundle", """
WITH b AS (SELECT o_custkey, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS reports, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(reports, '') AS reports, sha256(coalesce(reports, '')) AS bundle_hash, CAST(coalesce(n, 0) AS BIGINT) AS n FROM customer LEFT JOIN b ON c_custkey = o_custkey""")
def audit_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """What an artifact rests on, listed under it, with a hash of the list."""
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("r"))
    listed = F.coalesce(F.array_join(F.transform("r", lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(":"), x["o_orderstatus"])), ","), F.lit(""))
    out = table(spark, sf, "customer").select("c_custkey").join(rows, "c_custkey", "left")
    return out.select("c_custkey", listed.alias("reports"), F.sha2(listed, 256).alias("bundle_hash"), F.coalesce(F.size("r"), F.lit(0)).cast("long").alias("n")).withColumn("n", F.greatest("n", F.lit(0)))


@query("corpus_currency", """
WITH h AS (SELECT substr(sha256(doc_id || '|' || sha256(text)), 1, 4) AS b, sha256(doc_id || '|' || sha256(text)) AS h FROM documents), g AS (SELECT b, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY b), k AS (SELECT substr(b, 1, 2) AS b, sha256(string_agg(h, '' ORDER BY b)) AS h, sum(n) AS n FROM g GROUP BY substr(b, 1, 2))
SELECT sha256(string_agg(h, '' ORDER BY b)) || '#' || sum(n) AS currency FROM k""")
def corpus_currency(spark: SparkSession, sf: str) -> DataFrame:
    """A hash of all contents and their number, put together in three levels so that no group is large."""
    digest = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.sha2("text", 256)), 256)
    rows = table(spark, sf, "documents").select(F.substring(digest, 1, 4).alias("b"), digest.alias("h"), F.lit(1).cast("long").alias("n"))
    total = lambda by: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, "h"))), lambda x: x["h"]), ""), 256).alias("h")
    g = rows.groupBy("b").agg(total("b"), F.sum("n").alias("n"))
    k = g.groupBy(F.substring("b", 1, 2).alias("k")).agg(total("b"), F.sum("n").alias("n")).withColumnRenamed("k", "b")
    return k.agg(total("b"), F.sum("n").alias("n")).select(F.concat("h", F.lit("#"), F.col("n").cast("string")).alias("currency"))


@query("source_merge", """
WITH loc AS (SELECT doc_id AS id, sha256(source || '/' || doc_id) AS sync_key FROM documents WHERE doc_id % 2 = 0), peer AS (SELECT doc_id + 1000000 AS id, sha256(source || '/' || doc_id) AS sync_key, n_chars FROM documents WHERE doc_id % 3 = 0)
SELECT peer.id AS peer_id, coalesce(loc.id, peer.id) AS local_id, loc.id IS NULL AS inserted FROM peer LEFT JOIN loc USING (sync_key)""")
def source_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A peer's sources under the ids that they have here, by their portable key."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws("/", "source", F.col("doc_id").cast("string")), 256).alias("sync_key"))
    local = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "sync_key")
    peer = d.where("doc_id % 3 = 0").select((F.col("doc_id") + 1_000_000).alias("peer_id"), "sync_key")
    return peer.join(local, "sync_key", "left").select("peer_id", F.coalesce("id", "peer_id").alias("local_id"), F.col("id").isNull().alias("inserted"))


@query("composite_tombstones", """
WITH t AS (SELECT '{"order":' || l_orderkey || ',"line":' || l_linenumber || '}' AS key, l_shipdate AS deleted_at FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT '{"order":' || l_orderkey || ',"line":' || l_linenumber || '}' AS key, l_shipdate + INTERVAL (CAST(l_linenumber AS INT) - 3) DAY AS revision FROM lineitem)
SELECT key, CASE WHEN deleted_at IS NULL THEN 'live' WHEN deleted_at >= revision THEN 'blocked' ELSE 'resurrected' END AS state FROM r LEFT JOIN t USING (key)""")
def composite_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    """Tombstones of rows with keys of several columns: as old as the row or newer they block it, older ones are overcome."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    key = F.to_json(F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"))).alias("key")
    t = l.where("l_returnflag = 'R'").select(key, F.col("l_shipdate").alias("deleted_at"))
    r = l.select(key, F.expr("l_shipdate + make_dt_interval(cast(l_linenumber as int) - 3)").alias("revision"))
    state = F.when(F.col("deleted_at").isNull(), "live").when(F.col("deleted_at") >= F.col("revision"), "blocked").otherwise("resurrected")
    return r.join(t, "key", "left").select("key", state.alias("state"))


@query("source_delete_cascade", """
WITH gone AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 5)
SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS key FROM gone UNION ALL SELECT 'line', l_orderkey || ':' || l_linenumber FROM lineitem JOIN gone ON l_orderkey = o_orderkey
UNION ALL SELECT 'part', CAST(l_partkey AS VARCHAR) FROM lineitem LEFT JOIN gone ON l_orderkey = o_orderkey GROUP BY l_partkey HAVING count(*) = count(o_orderkey)""")
def source_delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Tombstones of a source (the customers of a nation) and of all that hangs on it; a part goes when its last line does."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").where("c_nationkey = 5").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(o.withColumn("gone", F.lit(True)), "l_orderkey", "left")  # noqa: E741
    tomb = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), key.alias("key"))
    lines = l.where("gone").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("k"))
    parts = l.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count("gone").alias("g")).where("n = g")
    return tomb(o, "order", F.col("l_orderkey").cast("string")).unionByName(tomb(lines, "line", F.col("k"))).unionByName(tomb(parts, "part", F.col("l_partkey").cast("string")))


@query("path_collisions", """
WITH f AS (SELECT doc_id, lower(source || '/' || lang || '/' || (doc_id % 50)) AS path, sha256(lang || CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END) AS h FROM documents),
w AS (SELECT *, min(doc_id) OVER p AS survivor, count(*) OVER p AS n, min(h) OVER p = max(h) OVER p AS same FROM f WINDOW p AS (PARTITION BY path))
SELECT doc_id, survivor, CASE WHEN doc_id = survivor THEN 'survivor' WHEN same THEN 'merged' ELSE 'refused' END AS state FROM w WHERE n > 1""")
def path_collisions(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.sha2(F.concat("lang", F.when(F.col("doc_id") % 4 == 0, F.col("doc_id").cast("string")).otherwise("")), 256).alias("h"))
    return L.collisions(d, F.lower(F.concat_ws("/", "source", "lang", (F.col("doc_id") % 50).cast("string"))), "doc_id", "h")


@query("portable_paths", """
WITH f AS (SELECT doc_id, '/vault/' || source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents), roots(key, root) AS (VALUES ('vault', '/vault'), ('first', '/vault/src1'), ('english', '/vault/src1/en'), ('none', '/elsewhere')),
m AS (SELECT doc_id, path, key, root, row_number() OVER (PARTITION BY doc_id, path ORDER BY length(root) DESC) AS n FROM f JOIN roots ON starts_with(path, root || '/'))
SELECT doc_id, key || ':' || substr(path, length(root) + 2) AS ref FROM m WHERE n = 1""")
def portable_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths as references under the longest root that they lie in."""
    path = F.concat(F.lit("/vault/"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".md"))
    roots = spark.createDataFrame([("vault", "/vault"), ("first", "/vault/src1"), ("english", "/vault/src1/en"), ("none", "/elsewhere")], "key string, root string")
    return L.portable(table(spark, sf, "documents").select("doc_id", path.alias("path")), "path", roots).select("doc_id", "ref")


@query("dead_cache", """
WITH c AS (SELECT sha256(html) AS h, page_id FROM pages), live AS (SELECT DISTINCT sha256(html) AS h FROM pages WHERE page_id % 4 <> 0)
SELECT page_id FROM c WHERE page_id % 2 = 0 AND h NOT IN (SELECT h FROM live)""")
def dead_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Cached contents that no live page has."""
    c = table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("h"))
    return c.where("page_id % 2 = 0").join(c.where("page_id % 4 <> 0").select("h").distinct(), "h", "left_anti").select("page_id")


@query("page_lint", """
WITH p AS (SELECT page_id, html FROM pages)
SELECT page_id, 'missing_title' AS code FROM p WHERE trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) = '' UNION ALL SELECT page_id, 'malformed_link' FROM p WHERE regexp_matches(html, 'href="[^"]*[,;.]"')
UNION ALL SELECT page_id, 'noise' FROM p WHERE length(html) - length(replace(replace(replace(replace(html, '*', ''), '#', ''), '&', ''), '$', '')) > 300 UNION ALL SELECT page_id, 'no_language' FROM p WHERE NOT regexp_matches(html, '<html lang="[a-z]{2}"') UNION ALL SELECT page_id, 'bad_path' FROM p WHERE url IS NULL OR NOT regexp_matches(url, '^https?://')""".replace("SELECT page_id, html FROM pages", "SELECT page_id, html, url FROM pages"))
def page_lint(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of single pages: no title, malformed links, noise, no language, a path that is none."""
    p = table(spark, sf, "pages")
    found = lambda condition, code: p.where(condition).select("page_id", F.lit(code).alias("code"))
    noise = F.length("html") - F.length(F.regexp_replace("html", "[*#&$]", "")) > 300
    checks = [(F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)) == "", "missing_title"), (F.col("html").rlike('href="[^"]*[,;.]"'), "malformed_link"), (noise, "noise"),
              (~F.col("html").rlike('<html lang="[a-z]{2}"'), "no_language"), (F.col("url").isNull() | ~F.col("url").rlike("^https?://"), "bad_path")]
    out = found(*checks[0])
    for c in checks[1:]:
        out = out.unionByName(found(*c))
    return out


#: The field of a layer's pages that points to the layer below, and where that must lead.
LAYER_RULES = [("02_Atoms", "parent_source", "01_Contexts/", "CTX-"), ("04_Synthesis", "concept_ids", "03_Concepts/", "CON-")]
_REFS = """refs AS (SELECT o_orderkey AS page, CASE o_orderkey % 2 WHEN 0 THEN '02_Atoms' ELSE '04_Synthesis' END AS layer, CASE o_orderkey % 2 WHEN 0 THEN 'parent_source' ELSE 'concept_ids' END AS field,
  CASE o_custkey % 4 WHEN 0 THEN '01_Contexts/CTX-' WHEN 1 THEN '03_Concepts/CON-' WHEN 2 THEN '01_Contexts/ATM-' ELSE '03_Concepts/sub/CON-' END || o_custkey AS target FROM orders)"""


@query("cross_layer_links", f"""WITH {_REFS}, rules(layer, field, prefix, id) AS (VALUES ('02_Atoms', 'parent_source', '01_Contexts/', 'CTX-'), ('04_Synthesis', 'concept_ids', '03_Concepts/', 'CON-'))
SELECT page, field, target FROM refs JOIN rules USING (layer, field) WHERE NOT (starts_with(target, prefix) AND starts_with(string_split(target, '/')[-1], id))""")
def cross_layer_links(spark: SparkSession, sf: str) -> DataFrame:
    """References that lead to a wrong layer."""
    k, c = F.col("o_orderkey") % 2, F.col("o_custkey") % 4
    stem = F.when(c == 0, "01_Contexts/CTX-").when(c == 1, "03_Concepts/CON-").when(c == 2, "01_Contexts/ATM-").otherwise("03_Concepts/sub/CON-")
    refs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), F.when(k == 0, "02_Atoms").otherwise("04_Synthesis").alias("layer"), F.when(k == 0, "parent_source").otherwise("concept_ids").alias("field"), F.concat(stem, F.col("o_custkey").cast("string")).alias("target"))
    rules = spark.createDataFrame(LAYER_RULES, "layer string, field string, prefix string, id string")
    right = F.startswith("target", "prefix") & F.startswith(F.element_at(F.split("target", "/"), -1), F.col("id"))
    return refs.join(F.broadcast(rules), ["layer", "field"]).where(~right).select("page", "field", "target")


@query("section_previews", """
SELECT doc_id, trim(regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '(?s)\\$\\$.*?\\$\\$', ' ', 'g'), '\\s+', ' ', 'g'), 1, 260), ' [^ ]*$', '')) AS preview FROM documents WHERE length(text) > 300""")
def section_previews(spark: SparkSession, sf: str) -> DataFrame:
    """The beginning of a section without its code and formulas, cut between words."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "(?s)```.*?```", " "), r"(?s)\$\$.*?\$\$", " "), r"\s+", " ")
    return table(spark, sf, "documents").where(F.length("text") > 300).select("doc_id", F.trim(F.regexp_replace(F.substring(t, 1, 260), " [^ ]*$", "")).alias("preview"))


@query("passage_choice", """
WITH v AS (SELECT vec_id AS doc_id, min(label) AS chunk FROM embeddings WHERE vec_id % 3 = 0 GROUP BY vec_id), c AS (SELECT conv_id AS doc_id, arg_min(text, turn) AS first_chunk FROM conversations GROUP BY conv_id)
SELECT doc_id, CASE WHEN chunk IS NOT NULL THEN 'vector' WHEN first_chunk IS NOT NULL THEN 'first' ELSE 'body' END AS passage, CAST(length(coalesce(CASE WHEN chunk IS NOT NULL THEN substr(text, CAST(chunk AS INT) + 1, 200) END, first_chunk, text)) AS BIGINT) AS chars FROM documents LEFT JOIN v USING (doc_id) LEFT JOIN c USING (doc_id)""")
def passage_choice(spark: SparkSession, sf: str) -> DataFrame:
    """What a reranker reads of a record: the chunk that its vector found, else its first chunk, else its body."""
    v = table(spark, sf, "embeddings").where("vec_id % 3 = 0").groupBy(F.col("vec_id").alias("doc_id")).agg(F.min("label").alias("chunk"))
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min_by("text", "turn").alias("first_chunk"))
    rows = table(spark, sf, "documents").select("doc_id", "text").join(v, "doc_id", "left").join(c, "doc_id", "left")
    found = F.when(F.col("chunk").isNotNull(), F.substring("text", F.col("chunk") + 1, F.lit(200)))
    kind = F.when(F.col("chunk").isNotNull(), "vector").when(F.col("first_chunk").isNotNull(), "first").otherwise("body")
    return rows.select("doc_id", kind.alias("passage"), F.length(F.coalesce(found, "first_chunk", "text")).cast("long").alias("chars"))


@query("manifest_counts", """SELECT 'documents' AS family, CAST(count(*) AS BIGINT) AS n FROM documents UNION ALL SELECT 'claims', count(*) FROM benchmark UNION ALL SELECT 'relations', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'entities', count(*) FROM part UNION ALL SELECT 'feedback', count(*) FROM events WHERE event_type IN ('click', 'view')""")
def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How much there is of each family."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("family"), "n")
    parts = [count(table(spark, sf, "documents"), "documents"), count(table(spark, sf, "benchmark"), "claims"), count(table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct(), "relations"),
             count(table(spark, sf, "part"), "entities"), count(table(spark, sf, "events").where("event_type in ('click', 'view')"), "feedback")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("loss_notes", """
WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN ' ==> picture [' || (doc_id % 700) || ' x 40] intentionally omitted <==' WHEN doc_id % 7 = 0 THEN ' picture intentionally omitted' ELSE '' END AS t FROM documents)
SELECT doc_id, '[unreadable region] ' || CASE WHEN regexp_extract(t, '(?i)picture \\[(\\d+) ?x ?(\\d+)\\] intentionally omitted', 1) <> '' THEN regexp_extract(t, '(?i)picture \\[(\\d+) ?x ?(\\d+)\\] intentionally omitted', 1) || 'x' || regexp_extract(t, '(?i)picture \\[(\\d+) ?x ?(\\d+)\\] intentionally omitted', 2) || ' ' ELSE '' END || 'image' AS note
FROM d WHERE regexp_matches(t, '(?i)picture(?: \\[\\d+ ?x ?\\d+\\])? intentionally omitted')""")
def loss_notes(spark: SparkSession, sf: str) -> DataFrame:
    """What a reader is told of pictures that were left out; some documents are given one."""
    d = F.col("doc_id")
    mark = F.when(d % 5 == 0, F.concat(F.lit(" ==> picture ["), (d % 700).cast("string"), F.lit(" x 40] intentionally omitted <=="))).when(d % 7 == 0, " picture intentionally omitted").otherwise("")
    rows = table(spark, sf, "documents").select("doc_id", T.lost_picture(F.concat("text", mark)).alias("p")).where("p is not null")
    size = F.coalesce(F.concat(F.col("p.width").cast("string"), F.lit("x"), F.col("p.height").cast("string"), F.lit(" ")), F.lit(""))
    return rows.select("doc_id", F.concat(F.lit("[unreadable region] "), size, F.lit("image")).alias("note"))
