"""Queries over pages that are written, citations and cross references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.plans.tables import table
from sparkloom.registry import query
from sparkloom.sources.export import page


@query("concept_pages", """
SELECT p_partkey, '---' || chr(10) || 'type: ' || p_type || chr(10) || 'size: ' || p_size || chr(10) || '---' || chr(10) || '# ' || p_name || chr(10) || chr(10) || p_brand
  || CASE WHEN p_size > 25 THEN chr(10) || chr(10) || '## Relations' || chr(10) || '- [[' || p_brand || ']]' || chr(10) || '- [[' || p_type || ']]' ELSE '' END AS content FROM part""")
def concept_pages(spark: SparkSession, sf: str) -> DataFrame:
    link = lambda c: F.concat(F.lit("[["), F.col(c), F.lit("]]"))
    rel = F.when(F.col("p_size") > 25, F.array(link("p_brand"), link("p_type"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "part").withColumn("rel", rel).select("p_partkey", page("p_name", "p_brand", {"type": "p_type", "size": "p_size"}, "rel").alias("content"))


@query("canvas_nodes", """
SELECT id, layer, CAST((row_number() OVER (PARTITION BY layer ORDER BY id) - 1) * 120 AS BIGINT) AS y, CAST(layer * 400 AS BIGINT) AS x FROM (
  SELECT 'r' || r_regionkey AS id, CAST(0 AS BIGINT) AS layer FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 's' || s_suppkey, 2 FROM supplier)""")
def canvas_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of a layered drawing, one column for each layer."""
    part = lambda name, p, key, layer: table(spark, sf, name).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), F.lit(layer).cast("long").alias("layer"))
    nodes = part("region", "r", "r_regionkey", 0).unionByName(part("nation", "n", "n_nationkey", 1)).unionByName(part("supplier", "s", "s_suppkey", 2))
    row = F.row_number().over(Window.partitionBy("layer").orderBy("id")) - 1
    return nodes.select("id", "layer", (row * 120).cast("long").alias("y"), (F.col("layer") * 400).alias("x"))


@query("source_ledger", """
SELECT source, CAST(count(*) AS BIGINT) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(min(doc_id) AS BIGINT) AS first_doc, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY source""")
def source_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_doc"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


#: Small texts with citations, which the tables lack.
#: Documents with citations, ranges, footnotes, code and indexed names after their words.
_CITED = "SELECT doc_id AS doc, concat(text, ' As shown [', doc_id % 40 + 1, ', 3-', doc_id % 50, '] and `x [4]` or a[0], [^2] (b)[5], [', doc_id % 900, '], [7–12,1—30, 2]') AS text FROM {}"


@query("citation_numbers", f"""
WITH c AS ({_CITED.format('documents')}), g AS (SELECT doc, unnest(gs) AS grp, generate_subscripts(gs, 1) AS gi FROM (SELECT doc, regexp_extract_all(regexp_replace(regexp_replace(text, '(?s)```.*?```|`[^`]*`', ' ', 'g'), '[A-Za-z0-9_)\\]^]\\[[^\\]]*\\]', '', 'g'), '\\[(\\d{{1,3}}(?:\\s*[,–—-]\\s*\\d{{1,3}})*)\\]', 1) AS gs FROM c)),
p AS (SELECT doc, gi, unnest(ps) AS part, generate_subscripts(ps, 1) AS pi FROM (SELECT doc, gi, string_split(grp, ',') AS ps FROM g)),
r AS (SELECT doc, gi, pi, CAST(regexp_extract(trim(part), '^(\\d+)', 1) AS BIGINT) AS a, CAST(regexp_extract(trim(part), '(\\d+)$', 1) AS BIGINT) AS b FROM p),
n AS (SELECT doc, gi, pi, unnest(range(a, b + 1)) AS number FROM r WHERE b >= a), k AS (SELECT *, row_number() OVER (PARTITION BY doc, gi ORDER BY pi, number) AS place FROM n)
SELECT DISTINCT doc, number FROM k WHERE place <= 24""")
def citation_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in square brackets, ranges expanded, 24 for each pair of brackets at most; code, footnotes and indexed names are none."""
    docs = spark.sql(_CITED.format("{d}"), d=table(spark, sf, "documents"))
    plain = F.regexp_replace(F.regexp_replace("text", r"(?s)```.*?```|`[^`]*`", " "), r"[A-Za-z0-9_)\]^]\[[^\]]*\]", "")
    groups = docs.select("doc", F.posexplode(F.regexp_extract_all(plain, F.lit(r"\[(\d{1,3}(?:\s*[,–—-]\s*\d{1,3})*)\]"), 1)).alias("gi", "g"))
    parts = groups.select("doc", "gi", F.posexplode(F.split("g", ",")).alias("pi", "part"))
    ends = parts.select("doc", "gi", "pi", F.regexp_extract(F.trim("part"), r"^(\d+)", 1).cast("long").alias("a"), F.regexp_extract(F.trim("part"), r"(\d+)$", 1).cast("long").alias("b")).where("b >= a")
    numbers = ends.select("doc", "gi", "pi", F.explode(F.sequence("a", "b")).alias("number"))
    place = F.row_number().over(Window.partitionBy("doc", "gi").orderBy("pi", "number"))
    return numbers.withColumn("place", place).where("place <= 24").select("doc", "number").distinct()


#: How a question asks for the list of references, how "references" is a verb, and other scripts.
ASKS = r"\b(references|bibliograph(?:y|ic)|works\s*cited|citations|cited\s+(?:work|paper)s?)\b"
VERB = r"\breferences\s+(the|this|that|these|those|a|an|his|her|their|its|our|your|my)\b"
NUMBERED = r"\b(reference|citation|ref)\s*\.?\s*(?:no\.?\s*)?\[?\s*\d"
OTHER_SCRIPTS = r"참\s*고\s*문\s*헌|참\s*고\s*자\s*료|레퍼런스|인\s*용\s*문\s*헌|参\s*考\s*文\s*献|引\s*用\s*文\s*献"


@query("bibliography_question", f"""
SELECT conv_id, turn, (regexp_matches(t, '{ASKS}') AND NOT regexp_matches(t, '{VERB}')) OR regexp_matches(t, '{NUMBERED}') OR regexp_matches(t, '{OTHER_SCRIPTS}') AS asks
FROM (SELECT conv_id, turn, lower(text) || CASE WHEN turn % 5 = 0 THEN ' which references ' ELSE ' ' END || CASE WHEN turn % 3 = 0 THEN 'the ref. [' || turn ELSE 'frame' END AS t FROM conversations WHERE role = 'user')""")
def bibliography_question(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a question asks for the list of references; the turns are given words that do and don't."""
    t = F.concat(F.lower("text"), F.when(F.col("turn") % 5 == 0, " which references ").otherwise(" "), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("the ref. ["), F.col("turn").cast("string"))).otherwise("frame"))
    asks = t.rlike(ASKS) & ~t.rlike(VERB) | t.rlike(NUMBERED) | t.rlike(OTHER_SCRIPTS)
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", asks.alias("asks"))


#: Letters of scripts that generated text should not be in, places that must not be changed, and how much is too much.
FOREIGN, READ_ONLY, TOO_MUCH = r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7A3}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{0400}-\x{04FF}]", r"(?:edit|write|overwrite|modify|rewrite|delete)\b[^\n]{0,40}?(03_notes|04_resources|06_archives)", 0.3


@query("output_validators", f"""
WITH u AS (SELECT doc_id, text || CASE WHEN doc_id % 41 = 0 THEN ' please delete 03_Notes' ELSE '' END || CASE WHEN doc_id % 43 = 0 THEN repeat('잔차 학습 ', 400) ELSE '' END || CASE WHEN doc_id % 47 = 0 THEN ' [[Missing]] [[page ' || (doc_id % 100) || ']]' ELSE '' END AS text, coalesce(quality, 0) + CASE WHEN doc_id % 53 = 0 THEN 0.5 ELSE 0 END AS confidence FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, 'unknown_span' AS error FROM u WHERE doc_id % 37 = 0 AND doc_id + 100000 NOT IN (SELECT doc_id FROM u)
UNION ALL SELECT doc_id, 'no_span' FROM u WHERE length(trim(text)) < 10
UNION ALL SELECT doc_id, 'mutates_source' FROM u WHERE regexp_matches(lower(text), '{READ_ONLY}')
UNION ALL SELECT doc_id, 'confidence_range' FROM u WHERE confidence < 0 OR confidence > 1
UNION ALL SELECT DISTINCT doc_id, 'unknown_link' FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, '\\[\\[([^\\]|#]+)', 1))) AS target FROM u) WHERE target NOT IN (SELECT 'page ' || page_id FROM pages)
UNION ALL SELECT doc_id, 'relation_endpoint' FROM u WHERE doc_id % 59 = 0 AND doc_id * 2 NOT IN (SELECT doc_id FROM u)
UNION ALL SELECT doc_id, 'not_english' FROM (SELECT doc_id, length(text) - length(regexp_replace(text, '{FOREIGN}', '', 'g')) AS f, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS l FROM u) WHERE f > 0 AND f / (f + l) > {TOO_MUCH}""")
def output_validators(spark: SparkSession, sf: str) -> DataFrame:
    """Rows for what is wrong with generated units; some documents are given faults."""
    every = lambda n, text: F.when(F.col("doc_id") % n == 0, text).otherwise("")
    faults = [every(41, " please delete 03_Notes"), every(43, F.repeat(F.lit("잔차 학습 "), 400)), every(47, F.concat(F.lit(" [[Missing]] [[page "), (F.col("doc_id") % 100).cast("string"), F.lit("]]")))]
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    u = table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    u = u.select("doc_id", F.concat("text", *faults).alias("text"), (F.coalesce("quality", F.lit(0)) + F.when(F.col("doc_id") % 53 == 0, 0.5).otherwise(0.0)).alias("confidence"))
    known = u.select(F.col("doc_id").alias("span"))
    error = lambda df, name: df.select("doc_id", F.lit(name).alias("error"))
    n = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    links = u.select("doc_id", F.explode(T.wikilinks(F.col("text"))).alias("target"))
    pages = table(spark, sf, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("target"))
    found = [
        error(u.where("doc_id % 37 = 0").withColumn("span", F.col("doc_id") + 100000).join(known, "span", "left_anti"), "unknown_span"),
        error(u.where(F.length(F.trim("text")) < 10), "no_span"),
        error(u.where(F.lower("text").rlike(READ_ONLY)), "mutates_source"),
        error(u.where("confidence < 0 or confidence > 1"), "confidence_range"),
        error(links.join(pages, "target", "left_anti").select("doc_id").distinct(), "unknown_link"),
        error(u.where("doc_id % 59 = 0").withColumn("span", F.col("doc_id") * 2).join(known, "span", "left_anti"), "relation_endpoint"),
        error(u.where((n(FOREIGN) > 0) & (n(FOREIGN) / (n(FOREIGN) + n("[A-Za-z]")) > TOO_MUCH)), "not_english"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("broad_fallback", """
WITH c AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_suppkey))) AS cited FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey), u AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_suppkey))) AS up FROM lineitem GROUP BY l_orderkey)
SELECT k FROM c JOIN u USING (k) WHERE cited = up AND len(up) > 1""")
def broad_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Units that cite all spans of what they come from."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"))
    out = rows.agg(F.array_sort(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_suppkey")))).alias("cited"), F.array_sort(F.collect_set("l_suppkey")).alias("up"))
    return out.where((F.size("cited") > 0) & (F.size("up") > 1) & (F.col("cited") == F.col("up"))).select("k")


@query("moved_files", """
WITH a AS (SELECT doc_id AS old_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS new_id, sha256(text) AS h FROM documents WHERE doc_id % 2 = 1)
SELECT old_id, min(new_id) AS new_id FROM a JOIN b USING (h) GROUP BY old_id""")
def moved_files(spark: SparkSession, sf: str) -> DataFrame:
    """For a file that is gone, the first one with the same content."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.where("doc_id % 2 = 1").groupBy("h").agg(F.min("doc_id").alias("new_id"))
    return d.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "old_id").join(first, "h").select("old_id", "new_id")
