"""Queries over packs, replicas, jobs, retention, lint and bibliography."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import packs as P
from sparkloom.operators import sync as Y
from sparkloom.operators.graph import latest
from sparkloom.plans.tables import table
from sparkloom.registry import query

ITEMS = """items AS (SELECT conv_id, turn, CAST(greatest(1, ceil(length(text) / 4), ceil(strlen(text) / 3)) AS BIGINT) AS cost FROM conversations)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", T.budget_tokens(F.col("text")).alias("cost"))


@query("evidence_prefix_budget", f"""WITH {ITEMS}
SELECT conv_id, turn, cost, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) <= 200 AS kept FROM items""")
def evidence_prefix_budget(spark: SparkSession, sf: str) -> DataFrame:
    return P.prefix_budget(items(spark, sf), ["conv_id"], ["turn"], F.col("cost"), 200)


@query("first_fit_budget", f"""WITH RECURSIVE {ITEMS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM items),
f AS (SELECT conv_id, n, CASE WHEN cost <= 200 THEN cost ELSE 0 END AS used, CASE WHEN cost <= 200 THEN CAST(turn AS VARCHAR) ELSE '' END AS kept FROM o WHERE n = 1
  UNION ALL SELECT o.conv_id, o.n, CASE WHEN used + cost <= 200 THEN used + cost ELSE used END, CASE WHEN used + cost <= 200 THEN kept || CASE WHEN kept = '' THEN '' ELSE ',' END || o.turn ELSE kept END FROM f JOIN o ON o.conv_id = f.conv_id AND o.n = f.n + 1)
SELECT conv_id, CAST(arg_max(used, n) AS BIGINT) AS used, arg_max(kept, n) AS kept FROM f GROUP BY conv_id""")
def first_fit_budget(spark: SparkSession, sf: str) -> DataFrame:
    out = P.first_fit_budget(items(spark, sf), ["conv_id"], ["turn"], "cost", "turn", 200)
    return out.select("conv_id", "used", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@query("snapshot_epoch", """
WITH r AS (SELECT sha256(doc_id || '|' || source || '|' || n_chars) AS h FROM documents), s AS (SELECT substr(h, 1, 4) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM r GROUP BY substr(h, 1, 4)), b AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h FROM s GROUP BY substr(b, 1, 2))
SELECT 'SNAP-' || substr(sha256(string_agg(h, '' ORDER BY h)), 1, 12) AS snapshot FROM b""")
def snapshot_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return P.epoch(table(spark, sf, "documents"), "doc_id", "source", "n_chars")


@query("policy_scope_all_spans", """
WITH i AS (SELECT l_orderkey AS item_id, l_partkey AS span_id FROM lineitem), s AS (SELECT p_partkey AS span_id FROM part WHERE p_size > 10)
SELECT item_id, CAST(count(*) AS BIGINT) AS spans FROM i LEFT JOIN s ON i.span_id = s.span_id GROUP BY item_id HAVING bool_and(s.span_id IS NOT NULL)""")
def policy_scope_all_spans(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("span_id"))
    return P.all_in_scope(i, table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("span_id")))


@query("glob_scope", """
SELECT doc_id FROM documents WHERE NOT regexp_matches(source || '/' || lang || '/' || doc_id || '.md', '^src1/.*$') AND (regexp_matches(source || '/' || lang || '/' || doc_id || '.md', '^src1[^/]*/en/[^/]*\\.md$') OR regexp_matches(source || '/' || lang || '/' || doc_id || '.md', '^.*/de/.*$'))""")
def glob_scope(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return docs.where(P.in_globs(path, ["src1*/en/*.md", "**/de/**"], ["src1/**"])).select("doc_id")


@query("stable_handles", """SELECT doc_id, 'EXP-' || substr(sha256('expand:' || doc_id), 1, 12) AS expand, 'VER-' || substr(sha256('verify:' || doc_id), 1, 12) AS verify FROM documents""")
def stable_handles(spark: SparkSession, sf: str) -> DataFrame:
    ident = lambda k: F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", P.handle("EXP", ident("expand")).alias("expand"), P.handle("VER", ident("verify")).alias("verify"))


@query("entity_lookup", """
WITH t AS (SELECT unnest(['ring', 'RED', 'w_dget']) AS term), m AS (SELECT term, p_partkey, p_name, row_number() OVER (PARTITION BY term ORDER BY p_name, p_partkey) AS n FROM t JOIN part ON contains(lower(p_name), lower(term)))
SELECT term, p_partkey, p_name FROM m WHERE n <= 5""")
def entity_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """At most five entities for each term, whatever its case."""
    terms = spark.createDataFrame([("ring",), ("RED",), ("w_dget",)], "term string")
    m = table(spark, sf, "part").join(F.broadcast(terms), F.lower("p_name").contains(F.lower("term")))
    return m.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("p_name", "p_partkey"))).where("n <= 5").select("term", "p_partkey", "p_name")


@query("report_overlap_topk", """
WITH q AS (SELECT ['small', 'red', 'ring', 'blue'] AS terms), r AS (SELECT p_partkey, p_size, string_split(p_name, ' ') AS words FROM part)
SELECT p_partkey, round(len(list_intersect(terms, words)) / len(terms) + 0.01 * p_size, 6) AS score FROM r, q ORDER BY score DESC, p_partkey LIMIT 10""")
def report_overlap_topk(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.array(*[F.lit(t) for t in ("small", "red", "ring", "blue")])
    score = F.size(F.array_intersect(terms, F.split("p_name", " "))) / F.size(terms) + 0.01 * F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(10)


REPLICAS = """l AS (SELECT o_orderkey AS k, o_orderdate AS ts, o_totalprice AS v FROM orders WHERE o_orderkey % 4 <> 0),
p AS (SELECT o_orderkey AS k, o_orderdate + INTERVAL (CAST(o_orderkey % 3 AS INT) - 1) DAY AS ts, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 5 <> 0)"""


def replicas(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders")
    local = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"))
    later = F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 3 as int) - 1)")
    return local, o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), later.alias("ts"), (F.col("o_totalprice") + 1).alias("v"))


@query("lww_merge", f"""WITH {REPLICAS}, f AS (SELECT coalesce(l.k, p.k) AS k, l.ts AS lt, p.ts AS pt, l.v AS lv, p.v AS pv FROM l FULL JOIN p ON l.k = p.k)
SELECT k, CASE WHEN pt IS NULL THEN 'local' WHEN lt IS NULL THEN 'inserted' WHEN pt > lt THEN 'updated' ELSE 'skipped' END AS outcome, round(CASE WHEN pt IS NOT NULL AND (lt IS NULL OR pt > lt) THEN pv ELSE lv END, 2) AS v FROM f""")
def lww_merge(spark: SparkSession, sf: str) -> DataFrame:
    local, peer = replicas(spark, sf)
    return Y.last_write_wins(local, peer, "k", "ts", "v").select("k", "outcome", F.round("v", 2).alias("v"))


@query("tombstone_block", f"""WITH {REPLICAS}, d AS (SELECT o_custkey AS c, max(o_orderdate) AS deleted_at FROM orders WHERE o_orderkey % 6 = 0 GROUP BY o_custkey)
SELECT o_orderkey AS k FROM orders LEFT JOIN d ON o_custkey = d.c WHERE deleted_at IS NULL OR deleted_at < o_orderdate""")
def tombstone_block(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    deleted = o.where("o_orderkey % 6 = 0").select("o_custkey", F.col("o_orderdate").alias("deleted_at"))
    return Y.tombstones(o.select("o_custkey", "o_orderkey", "o_orderdate"), deleted, "o_custkey", "o_orderdate").select(F.col("o_orderkey").alias("k"))


@query("hash_diff", """
WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 9 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 8 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' ELSE 'unchanged' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def hash_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return Y.hash_diff(d.where("doc_id % 9 <> 0").select("doc_id", F.sha2("text", 256).alias("hash")), d.where("doc_id % 8 <> 0").select("doc_id", F.sha2(text, 256).alias("hash")), "doc_id")


@query("id_remap", """
WITH m AS (SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS new FROM part), r AS (SELECT l_orderkey, l_linenumber, coalesce(new, l_partkey) AS id FROM lineitem LEFT JOIN m ON l_partkey = old)
SELECT l_orderkey, string_agg(CAST(id AS VARCHAR), ',' ORDER BY l_linenumber, id) AS ids FROM r GROUP BY l_orderkey""")
def id_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays of ids rewritten to the smallest id of naturally equal rows."""
    least = F.min("p_partkey").over(Window.partitionBy("p_name", "p_brand"))
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("old"), least.alias("new"))
    lines = table(spark, sf, "lineitem").join(ids, F.col("l_partkey") == F.col("old"), "left").select("l_orderkey", "l_linenumber", F.coalesce("new", "l_partkey").alias("id"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "id"))), lambda x: x["id"].cast("string"))
    return lines.groupBy("l_orderkey").agg(F.array_join(listed, ",").alias("ids"))


@query("authoritative_winner", """
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, o_totalprice DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def authoritative_winner(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("match", F.col("o_orderstatus") == "F")
    return latest(o, ["o_custkey"], ["match", "o_orderdate", "o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("job_latest_state", """
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def job_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("job_event_seq", """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events""")
def job_event_seq(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"))


@query("jobs_done_by_day", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS cost FROM events GROUP BY CAST(ts AS DATE), event_type""")
def jobs_done_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("cost"))


@query("enqueue_idempotent", """
WITH busy AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'view') AND event_id % 2 = 0)
SELECT DISTINCT user_id, event_type FROM events e WHERE event_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM busy b WHERE b.user_id = e.user_id AND b.event_type = e.event_type)""")
def enqueue_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    busy = e.where("event_type in ('click', 'view') and event_id % 2 = 0").select("user_id", "event_type")
    return e.where("event_id % 2 = 1").select("user_id", "event_type").distinct().join(busy, ["user_id", "event_type"], "left_anti")


@query("json_props_extract", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90""")
def json_props_extract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select("event_id", k.alias("k")).where("k >= 90")


@query("retention_topn", """
WITH free AS (SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45))
SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM free) WHERE n > 3""")
def retention_topn(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return Y.retained(table(spark, sf, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, used, "o_orderkey").select("o_orderkey")


LINKS = """links AS (SELECT DISTINCT page_id, 'notes' || href AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS href FROM pages)),
paths AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN 'notes/' ELSE 'other/' END || w AS path FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS w FROM pages WHERE page_id % 2 = 0))"""


def links_and_paths(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "pages")
    href = F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), 1))
    links = p.select("page_id", href.alias("h")).select(F.col("page_id").alias("page"), F.concat(F.lit("notes"), "h").alias("target")).distinct()
    word = F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), 1))
    folder = F.when(F.col("page_id") % 3 == 0, "notes/").otherwise("other/")
    return links, p.where("page_id % 2 = 0").select("page_id", word.alias("w")).select(F.concat(folder, "w").alias("path")).distinct()


@query("broken_links", f"""WITH {LINKS}, names AS (SELECT split_part(path, '/', 2) AS name, count(*) AS n, min(path) AS one FROM paths GROUP BY split_part(path, '/', 2)),
lost AS (SELECT page_id AS page, target, split_part(target, '/', 2) AS name FROM links WHERE target NOT IN (SELECT path FROM paths))
SELECT page, target, CASE WHEN trim(target) = '' THEN 'error' WHEN coalesce(n, 0) = 1 THEN 'warning' ELSE 'error' END AS severity, CASE WHEN n = 1 THEN one END AS suggestion FROM lost LEFT JOIN names USING (name)""")
def broken_links(spark: SparkSession, sf: str) -> DataFrame:
    return Y.broken_links(*links_and_paths(spark, sf))


@query("orphan_pages", f"""WITH {LINKS} SELECT path FROM paths WHERE path NOT IN (SELECT target FROM links WHERE page_id % 4 <> 0)""")
def orphan_pages(spark: SparkSession, sf: str) -> DataFrame:
    links, paths = links_and_paths(spark, sf)
    return paths.join(links.where("page % 4 <> 0").select(F.col("target").alias("path")), "path", "left_anti")


@query("lint_health", f"""WITH {LINKS}, names AS (SELECT split_part(path, '/', 2) AS name, count(*) AS n FROM paths GROUP BY split_part(path, '/', 2)),
lost AS (SELECT coalesce(n, 0) = 1 AS warn FROM (SELECT DISTINCT page_id, target, split_part(target, '/', 2) AS name FROM links WHERE target NOT IN (SELECT path FROM paths)) LEFT JOIN names USING (name)),
c AS (SELECT count(*) FILTER (NOT warn) AS e, count(*) FILTER (warn) AS w FROM lost)
SELECT CAST(e AS BIGINT) AS errors, CAST(w AS BIGINT) AS warnings, CAST(greatest(0, 100 - floor(100 * (5 * e + 2 * w) / (10 * (SELECT count(*) FROM pages)))) AS BIGINT) AS health FROM c""")
def lint_health(spark: SparkSession, sf: str) -> DataFrame:
    found = Y.broken_links(*links_and_paths(spark, sf)).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    n = table(spark, sf, "pages").agg(F.count(F.lit(1)).alias("pages"))
    return found.crossJoin(F.broadcast(n)).select("errors", "warnings", Y.health_score(F.col("errors"), F.col("warnings"), F.lit(0), F.col("pages")).alias("health"))


@query("layer_status_counts", """
SELECT source, lang, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS verified, CAST(count(*) FILTER (quality = 0) AS BIGINT) AS unchecked, CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS failed, CAST(count(*) FILTER (quality IS NULL) AS BIGINT) AS unlabelled
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang""")
def layer_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    count = lambda c, name: F.count_if(c).alias(name)
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("total"), count(F.col("quality") == 1, "verified"), count(F.col("quality") == 0, "unchecked"), count(F.col("toxic") == 1, "failed"), count(F.col("quality").isNull(), "unlabelled"))


@query("serving_units", """
SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) JOIN (SELECT source, max(doc_id) AS newest FROM documents GROUP BY source) s USING (source) WHERE quality = 1 AND toxic = 0 AND d.doc_id >= newest / 2""")
def serving_units(spark: SparkSession, sf: str) -> DataFrame:
    """Verified units that are not retired, of the current generation of their source."""
    d = table(spark, sf, "documents").select("doc_id", "source")
    current = d.groupBy("source").agg((F.max("doc_id") / 2).alias("since"))
    return d.join(table(spark, sf, "labels").where("quality = 1 and toxic = 0"), "doc_id").join(current, "source").where("doc_id >= since").select("doc_id")


@query("stats_unindexed", """
SELECT (SELECT CAST(count(*) AS BIGINT) FROM documents) AS documents, (SELECT CAST(count(*) AS BIGINT) FROM labels WHERE quality = 1) AS live, (SELECT CAST(count(*) AS BIGINT) FROM labels l WHERE quality = 1 AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = l.doc_id)) AS unindexed""")
def stats_unindexed(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("documents"))
    live = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    lost = live.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("unindexed"))
    return n.crossJoin(live.agg(F.count(F.lit(1)).alias("live"))).crossJoin(lost)


@query("token_cost_sums", """SELECT event_type, round(sum(coalesce(value, 0)), 2) AS cost, CAST(sum(length(props)) AS BIGINT) AS chars FROM events GROUP BY event_type""")
def token_cost_sums(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum(F.coalesce("value", F.lit(0.0))), 2).alias("cost"), F.sum(F.length("props")).alias("chars"))


@query("bibliography_search", """
WITH hits AS (SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') UNION SELECT l_partkey FROM lineitem WHERE l_quantity >= 49),
out_ AS (SELECT p_partkey, p_name, p_brand FROM part JOIN hits USING (p_partkey) WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'))
SELECT p_partkey, p_name, p_brand FROM out_ ORDER BY p_partkey DESC LIMIT 100""")
def bibliography_search(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    hits = p.where(F.lower("p_name").contains("ring")).select("p_partkey").union(table(spark, sf, "lineitem").where("l_quantity >= 49").select("l_partkey")).distinct()
    gone = p.where("p_type = 'ECONOMY'").select("p_partkey")
    return p.join(hits, "p_partkey").join(gone, "p_partkey", "left_anti").select("p_partkey", "p_name", "p_brand").orderBy(F.desc("p_partkey")).limit(100)


@query("bibliography_pivot", """
SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS line1, max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS line2, max(CASE WHEN l_linenumber = 3 THEN l_partkey END) AS line3 FROM lineitem GROUP BY l_orderkey""")
def bibliography_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Field rows of an item as columns."""
    wide = table(spark, sf, "lineitem").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3]).agg(F.max("l_partkey"))
    return wide.select("l_orderkey", F.col("1").alias("line1"), F.col("2").alias("line2"), F.col("3").alias("line3"))


@query("annotation_colours", """
WITH c AS (SELECT p_partkey, (p_partkey * 2654435 % 16777216) AS v FROM part), x AS (SELECT p_partkey, v // 65536 AS r, (v // 256) % 256 AS g, v % 256 AS b FROM c)
SELECT p_partkey, CASE WHEN r >= g AND r >= b THEN 'red' WHEN g >= b THEN 'green' ELSE 'blue' END AS colour FROM x""")
def annotation_colours(spark: SparkSession, sf: str) -> DataFrame:
    """A colour's family from its six hex digits."""
    digits = F.lpad(F.hex(F.col("p_partkey") * 2654435 % 16777216), 6, "0")
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("int")
    r, g, b = part(1), part(3), part(5)
    return table(spark, sf, "part").select("p_partkey", F.when((r >= g) & (r >= b), "red").when(g >= b, "green").otherwise("blue").alias("colour"))


@query("citation_resolve", """
WITH refs AS (SELECT o_orderkey AS doc, unnest(range(1, CAST(2 + o_orderkey % 4 AS BIGINT))) AS n FROM orders), r AS (SELECT doc, n, row_number() OVER (PARTITION BY doc ORDER BY n) AS pos FROM refs)
SELECT doc, l_linenumber AS number, l_partkey AS entry, min(pos) AS first_pos FROM r JOIN lineitem ON doc = l_orderkey AND n = l_linenumber GROUP BY doc, l_linenumber, l_partkey""")
def citation_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of a citation range joined with the entries of the same document; unknown numbers drop out."""
    refs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.posexplode(F.expr("sequence(1, cast(1 + o_orderkey % 4 as int))")).alias("pos", "n"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("entry"))
    return refs.join(lines, ["doc", "n"]).groupBy("doc", F.col("n").alias("number"), "entry").agg(F.min(F.col("pos") + 1).cast("long").alias("first_pos"))


@query("page_offset_mode", """
WITH d AS (SELECT l_returnflag AS doc, l_linenumber - CAST(l_quantity AS INT) % 3 AS delta FROM lineitem), c AS (SELECT doc, delta, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc) AS total FROM d GROUP BY doc, delta)
SELECT doc, CAST(delta AS BIGINT) AS page_offset, CAST(n AS BIGINT) AS votes, n * 2 > total AS sure FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, delta) AS k FROM c) WHERE k = 1""")
def page_offset_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent difference between printed and counted pages, and whether most agree."""
    d = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("doc"), (F.col("l_linenumber") - F.col("l_quantity").cast("int") % 3).alias("delta"))
    c = d.groupBy("doc", "delta").agg(F.count(F.lit(1)).alias("votes")).withColumn("total", F.sum("votes").over(Window.partitionBy("doc")))
    first = c.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("votes"), "delta"))).where("k = 1")
    return first.select("doc", F.col("delta").cast("long").alias("page_offset"), "votes", (F.col("votes") * 2 > F.col("total")).alias("sure"))


@query("outline_ranges", """
WITH t AS (SELECT DISTINCT l_orderkey AS doc, CAST(l_quantity AS BIGINT) AS page FROM lineitem)
SELECT doc, page, lead(page) OVER (PARTITION BY doc ORDER BY page) AS next_page FROM t""")
def outline_ranges(spark: SparkSession, sf: str) -> DataFrame:
    from sparkloom.operators.spans import next_page_ranges

    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").cast("long").alias("page")).distinct()
    return next_page_ranges(t, "doc", "page")


@query("asof_outline", """
WITH o AS (SELECT DISTINCT o_custkey AS c, o_orderdate AS d, max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) AS k FROM orders), q AS (SELECT c_custkey AS c, TIMESTAMP '1996-06-01' + INTERVAL (CAST(c_custkey % 365 AS INT)) DAY AS at FROM customer)
SELECT q.c AS custkey, o.k AS last_order FROM q ASOF LEFT JOIN o ON q.c = o.c AND q.at >= o.d""")
def asof_outline(spark: SparkSession, sf: str) -> DataFrame:
    """The last entry at or before a place: a union of both sides and a window, without a range join."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("t")).agg(F.max("o_orderkey").alias("k")).select("c", "t", "k", F.lit(0).alias("side"))
    at = F.expr("timestamp_ntz'1996-06-01' + make_dt_interval(cast(c_custkey % 365 as int))")
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("c"), at.alias("t"), F.lit(None).cast("long").alias("k"), F.lit(1).alias("side"))
    seen = F.last("k", True).over(Window.partitionBy("c").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0))
    return o.unionByName(q).withColumn("last", seen).where("side = 1").select(F.col("c").alias("custkey"), F.col("last").alias("last_order"))


@query("consecutive_dedup", """
SELECT conv_id, turn FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS DISTINCT FROM role""")
def consecutive_dedup(spark: SparkSession, sf: str) -> DataFrame:
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("role"))).select("conv_id", "turn")


@query("array_union_refs", """
SELECT o_custkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS refs FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def array_union_refs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey")
    return rows.agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")).cast("array<string>"), ",").alias("refs"))


@query("symmetric_pairs", """
WITH p AS (SELECT DISTINCT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b FROM lineitem WHERE l_suppkey <> l_partkey % 100)
SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = a AND s_nationkey % 2 = 0)""")
def symmetric_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whichever way round, without those that were dismissed."""
    x, y = F.col("l_suppkey"), F.col("l_partkey") % 100
    p = table(spark, sf, "lineitem").where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    return p.join(table(spark, sf, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("a")), "a", "left_anti")
