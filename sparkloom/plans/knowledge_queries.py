"""Queries over claims and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import claims as C
from sparkloom.operators import graph as G
from sparkloom.operators import index as X
from sparkloom.plans.search_queries import the_index
from sparkloom.plans.tables import table
from sparkloom.registry import query
from sparkloom.storage import Workspace

_STOP = "[" + ", ".join(f"'{w}'" for w in C.STOP) + "]"


def terms_sql(text: str) -> str:
    """Distinct content terms; order is not kept. The tables hold no backslash that could take a dollar sign back."""
    plain = f"regexp_replace({text}, '(?s)\\$\\$.+?\\$\\$|\\$.+?\\$', ' ', 'g')"
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({plain}, '[a-zA-Z][a-zA-Z0-9]{{2,}}'), lambda w: lower(w)), lambda w: NOT list_contains({_STOP}, w)))"


def claims(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), "text")


def declared(spark: SparkSession, sf: str) -> DataFrame:
    """Every claim declares three documents; where a document holds the claim, that too."""
    c = table(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    fixed = c.select("claim_id", F.posexplode(F.array(F.col("claim_id"), F.col("claim_id") + 40, F.col("claim_id") * 3 + 80)).alias("pos", "span_id"))
    passages = c.select(F.col("claim_id").alias("query_id"), F.col("text").alias("passage"))
    holds = X.holders(the_index(spark, sf), table(spark, sf, "documents").select("doc_id", "text"), passages).select(F.col("query_id").alias("claim_id"), F.col("doc_id").alias("span_id"))
    return fixed.select("claim_id", F.col("span_id"), F.col("pos").cast("long").alias("pos")).unionByName(holds.select("claim_id", "span_id", (F.col("span_id") + 3).alias("pos")))


CLAIMS = f"""c AS (SELECT item_id AS claim_id, text, {terms_sql('text')} AS terms FROM benchmark),
d AS (SELECT claim_id, claim_id AS span_id, 0 AS pos FROM c UNION ALL SELECT claim_id, claim_id + 40, 1 FROM c UNION ALL SELECT claim_id, claim_id * 3 + 80, 2 FROM c
  UNION ALL SELECT claim_id, doc_id, doc_id + 3 FROM c JOIN documents x ON contains(x.text, c.text)),
j AS (SELECT d.claim_id, d.span_id, d.pos, round(CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, {terms_sql('x.text')})) / len(terms) END, 6) AS cov FROM d JOIN documents x ON x.doc_id = d.span_id JOIN c USING (claim_id))"""


@query("claim_term_coverage", f"WITH {CLAIMS} SELECT claim_id, span_id, CAST(pos AS BIGINT) AS pos, cov FROM j")
def claim_term_coverage(spark: SparkSession, sf: str) -> DataFrame:
    c = claims(spark, sf).select("claim_id", C.content_terms(F.col("text")).alias("terms"))
    s = table(spark, sf, "documents").select(F.col("doc_id").alias("span_id"), C.content_terms(F.col("text")).alias("span_terms"))
    return declared(spark, sf).join(s, "span_id").join(c, "claim_id").select("claim_id", "span_id", "pos", F.round(C.coverage(F.col("terms"), F.col("span_terms")), 6).alias("cov"))


VERDICT = f"""{CLAIMS}, b AS (SELECT claim_id, max(cov) AS cov, arg_min(span_id, pos) FILTER (cov = m) AS span_id, count(*) AS n FROM (SELECT *, max(cov) OVER (PARTITION BY claim_id) AS m FROM j) GROUP BY claim_id),
v AS (SELECT c.claim_id, c.terms, CASE WHEN n IS NULL OR len(terms) = 0 OR cov < 0.25 THEN 'failed' WHEN cov >= 0.5 THEN 'verified' ELSE 'uncertain' END AS status,
  CASE WHEN n IS NULL THEN 'no_span' WHEN len(terms) = 0 THEN 'no_terms' WHEN cov < 0.25 THEN 'low_coverage' WHEN cov >= 0.5 THEN 'covered' ELSE 'partial' END AS reason,
  coalesce(cov, CAST(0 AS DOUBLE)) AS coverage, span_id AS primary_span FROM c LEFT JOIN b USING (claim_id))"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    spans = table(spark, sf, "documents").select(F.col("doc_id").alias("span_id"), "text")
    return C.verdicts(claims(spark, sf), declared(spark, sf), spans)


@query("claim_verdict", f"WITH {VERDICT} SELECT claim_id, status, reason, coverage, primary_span FROM v")
def claim_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf)


@query("claim_semantic_hash", f"SELECT item_id AS claim_id, substr(sha256('terms:' || array_to_string(list_sort({terms_sql('text')}), ' ') || '|formulas:'), 1, 16) AS semantic_hash FROM benchmark")
def claim_semantic_hash(spark: SparkSession, sf: str) -> DataFrame:
    return claims(spark, sf).select("claim_id", C.semantic_hash(F.col("text")).alias("semantic_hash"))


SUPPORTS = """sup AS (SELECT doc_id AS claim_id, doc_id AS span_id, sha256(text) AS span_hash, CASE WHEN doc_id % 5 = 0 THEN 'unchecked' ELSE 'verified' END AS status FROM documents),
cur AS (SELECT doc_id AS span_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '.' ELSE text END) AS hash FROM documents WHERE doc_id % 13 <> 0)"""


@query("support_freshness", f"""WITH {SUPPORTS}
SELECT claim_id, span_id, CASE WHEN status = 'verified' AND (hash IS NULL OR hash <> span_hash) THEN 'stale' ELSE status END AS status FROM sup LEFT JOIN cur USING (span_id)""")
def support_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Supports against a later state in which some spans have changed and some are gone."""
    docs = table(spark, sf, "documents")
    sup = docs.select(F.col("doc_id").alias("claim_id"), F.col("doc_id").alias("span_id"), F.sha2("text", 256).alias("span_hash"), F.when(F.col("doc_id") % 5 == 0, "unchecked").otherwise("verified").alias("status"))
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    now = docs.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("span_id"), F.sha2(text, 256).alias("hash"))
    return C.freshness(sup, now).select("claim_id", "span_id", "status")


@query("duplicate_claims", """
SELECT sha256(text) AS claim_hash, CAST(count(*) AS BIGINT) AS copies, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents GROUP BY sha256(text) HAVING count(*) > 1""")
def duplicate_claims(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("claim_hash"))
    out = rows.agg(F.count(F.lit(1)).alias("copies"), F.sort_array(F.collect_list("doc_id")).alias("ids")).where("copies > 1")
    return out.select("claim_hash", "copies", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("compiler_audit", f"""WITH {VERDICT}, {SUPPORTS}
SELECT code, CAST(count(*) AS BIGINT) AS findings FROM (
  SELECT 'failed' AS code FROM v WHERE status = 'failed'
  UNION ALL SELECT 'unsupported' FROM v WHERE reason = 'no_span'
  UNION ALL SELECT 'stale' FROM sup JOIN cur USING (span_id) WHERE status = 'verified' AND hash <> span_hash
  UNION ALL SELECT 'dangling' FROM sup ANTI JOIN cur USING (span_id)
  UNION ALL SELECT 'duplicate' FROM (SELECT 1 FROM documents GROUP BY sha256(text) HAVING count(*) > 1)) GROUP BY code""")
def compiler_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    v = judged(spark, sf)
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    now = docs.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("span_id"), F.sha2(text, 256).alias("hash"))
    sup = docs.select(F.col("doc_id").alias("span_id"), F.sha2("text", 256).alias("span_hash"), (F.col("doc_id") % 5 != 0).alias("verified"))
    codes = [
        v.where("status = 'failed'").select(F.lit("failed").alias("code")),
        v.where("reason = 'no_span'").select(F.lit("unsupported").alias("code")),
        sup.where("verified").join(now, "span_id").where("hash <> span_hash").select(F.lit("stale").alias("code")),
        sup.join(now, "span_id", "left_anti").select(F.lit("dangling").alias("code")),
        docs.groupBy(F.sha2("text", 256)).count().where("count > 1").select(F.lit("duplicate").alias("code")),
    ]
    out = codes[0]
    for c in codes[1:]:
        out = out.unionByName(c)
    return out.groupBy("code").agg(F.count(F.lit(1)).alias("findings"))


@query("reconcile_claims", """
WITH t AS (SELECT doc_id AS claim_id, regexp_replace(trim(text), '\\s+', ' ', 'g') AS statement, sha256(text) AS basis FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY statement, basis ORDER BY claim_id) AS nth FROM t WHERE claim_id % 3 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY statement, basis ORDER BY claim_id) AS nth FROM t WHERE claim_id % 3 <> 1),
f AS (SELECT o.claim_id AS old_id, n.claim_id AS new_id, coalesce(o.basis, n.basis) AS basis FROM o FULL JOIN n ON o.statement = n.statement AND o.basis = n.basis AND o.nth = n.nth)
SELECT coalesce(old_id, new_id) AS claim_id, CASE WHEN old_id IS NULL THEN 'new' WHEN new_id IS NOT NULL THEN 'kept' WHEN basis IN (SELECT basis FROM n) THEN 'carried' ELSE 'retired' END AS state FROM f""")
def reconcile_claims(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("claim_id"), F.regexp_replace(F.trim("text"), r"\s+", " ").alias("statement"), F.sha2("text", 256).alias("basis"))
    return C.reconcile(t.where("claim_id % 3 <> 0"), t.where("claim_id % 3 <> 1"))


# The graph: suppliers and parts, related by what was ordered.
PART = 1_000_000
EDGES = f"""e AS (SELECT l_suppkey * 10000000000 + l_partkey + {PART} AS edge_id, l_suppkey AS src, l_partkey + {PART} AS dst, CAST(count(*) AS BIGINT) AS supports,
  CAST(count(DISTINCT l_orderkey) AS BIGINT) AS lineage, round(avg(l_discount) * 10, 6) AS confidence, bool_or(l_returnflag = 'A') AS has_span, bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R') AS disputed
  FROM lineitem GROUP BY l_suppkey, l_partkey)"""


def relations(spark: SparkSession, sf: str) -> DataFrame:
    """edge_id, src, dst, supports, lineage, confidence, has_span, disputed."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART).alias("dst"))
    out = rows.agg(F.count(F.lit(1)).alias("supports"), F.countDistinct("l_orderkey").alias("lineage"), F.round(F.avg("l_discount") * 10, 6).alias("confidence"), F.bool_or(F.col("l_returnflag") == "A").alias("has_span"), (F.bool_or(F.col("l_returnflag") == "A") & F.bool_or(F.col("l_returnflag") == "R")).alias("disputed"))
    return out.withColumn("edge_id", F.expr("src * 10000000000L + dst"))


@query("relation_supports", f"WITH {EDGES} SELECT edge_id, src, dst, supports, lineage, confidence, has_span FROM e")
def relation_supports(spark: SparkSession, sf: str) -> DataFrame:
    return relations(spark, sf).select("edge_id", "src", "dst", "supports", "lineage", "confidence", "has_span")


@query("neighborhood", f"WITH {EDGES} SELECT edge_id, src, dst FROM e WHERE src < 5 OR dst IN ({PART} + 10, {PART} + 20, {PART} + 30)")
def neighborhood(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([(i,) for i in [*range(5), PART + 10, PART + 20, PART + 30]], "node long")
    return G.neighbourhood(relations(spark, sf).select("edge_id", "src", "dst"), F.broadcast(seeds))


STRONG = "s AS (SELECT edge_id, src, dst FROM e WHERE confidence >= 0.7)"
NODES = f"nodes AS (SELECT s_suppkey AS node FROM supplier UNION ALL SELECT p_partkey + {PART} FROM part)"
#: Least labels go round until nothing moves; twelve rounds of doubling reach any path of 4,096 edges.
_SPREAD = "l{1} AS MATERIALIZED (SELECT l.node, least(l.label, coalesce(m.label, l.label), coalesce(j.label, l.label)) AS label FROM l{0} l LEFT JOIN (SELECT b AS node, min(label) AS label FROM both_ JOIN l{0} ON node = a GROUP BY b) m ON m.node = l.node LEFT JOIN l{0} j ON j.node = l.label)"
PARTS = f"""{EDGES}, {STRONG}, {NODES}, both_ AS MATERIALIZED (SELECT src AS a, dst AS b FROM s UNION SELECT dst, src FROM s), l0 AS MATERIALIZED (SELECT node, node AS label FROM nodes),
{', '.join(_SPREAD.format(i, i + 1) for i in range(16))}, parts AS (SELECT node, label AS component FROM l16)"""


def graph_parts(spark: SparkSession, sf: str, work: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = relations(spark, sf)
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")).unionByName(table(spark, sf, "part").select((F.col("p_partkey") + PART).alias("node")))
    return nodes, edges, G.communities(nodes, edges.where("confidence >= 0.7"), work)


@query("connected_components", f"WITH {PARTS} SELECT node, component FROM parts")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components over confident relations, single nodes too."""
    return graph_parts(spark, sf, Workspace(spark, "components"))[2]


@query("community_rebuild", f"""WITH {PARTS}
SELECT 'comm-' || substr(sha256(component || ':' || count(*) || ':' || sum(node) || ':' || sum(node * node % 1000003)), 1, 12) AS community, CAST(count(*) AS BIGINT) AS members FROM parts GROUP BY component HAVING count(*) >= 2""")
def community_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Communities under a key of their members: sums of hashes, which need no list of them in one place."""
    parts = graph_parts(spark, sf, Workspace(spark, "community"))[2]
    sums = parts.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("node").alias("s"), F.sum(F.expr("node * node % 1000003")).alias("q")).where("members >= 2")
    key = F.substring(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("component", "members", "s", "q")]), 256), 1, 12)
    return sums.select(F.concat(F.lit("comm-"), key).alias("community"), "members")


@query("giant_component_ratio", f"""WITH {PARTS}, sizes AS (SELECT component, count(*) AS n FROM parts GROUP BY component HAVING count(*) > 1)
SELECT round(max(n) / sum(n), 6) AS giant_ratio, CAST(count(*) AS BIGINT) AS components FROM sizes""")
def giant_component_ratio(spark: SparkSession, sf: str) -> DataFrame:
    parts = graph_parts(spark, sf, Workspace(spark, "giant"))[2]
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sizes.agg(F.round(F.max("n") / F.sum("n"), 6).alias("giant_ratio"), F.count(F.lit(1)).alias("components"))


@query("bridge_edges")
def bridge_edges(spark: SparkSession, sf: str) -> DataFrame:
    work = Workspace(spark, "bridges")
    _, edges, parts = graph_parts(spark, sf, work)
    return G.bridges(edges.where("confidence >= 0.7").select("edge_id", "src", "dst"), work.put(parts, "parts"), work)


@query("relation_lifecycle", f"""WITH {EDGES}
SELECT edge_id, CASE WHEN src = dst THEN 'self_loop' WHEN dst - {PART} NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7) THEN 'endpoint_unresolved' WHEN supports >= 10 THEN 'active' WHEN disputed AND confidence < 0.4 THEN 'contradiction' WHEN lineage < 2 THEN 'unsupported' ELSE 'active' END AS state FROM e""")
def relation_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """States of relations: parts of one size are unknown, many supports prove a relation, disputed ones of little confidence contradict themselves."""
    edges = relations(spark, sf)
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")).unionByName(table(spark, sf, "part").where("p_size <> 7").select((F.col("p_partkey") + PART).alias("node")))
    none = edges.limit(0).select("edge_id")
    return G.lifecycle(edges.withColumn("supports", F.col("lineage")), nodes, edges.where("supports >= 10").select("edge_id"), edges.where("disputed and confidence < 0.4").select("edge_id"), none, 2)


@query("memory_paths_2hop", f"""WITH {EDGES}, bo AS (SELECT edge_id, src AS a, dst AS b, confidence, has_span FROM e UNION ALL SELECT edge_id, dst, src, confidence, has_span FROM e),
dom AS (SELECT p_partkey + {PART} AS node FROM part WHERE contains(lower(p_name), 'red') UNION ALL SELECT s_suppkey FROM supplier WHERE s_nationkey = 3),
one AS (SELECT a AS node, edge_id AS e1, b AS via, confidence, has_span FROM bo WHERE a < 10),
f AS (SELECT node, e1, CAST(NULL AS BIGINT) AS e2, via, CAST(NULL AS BIGINT) AS "end", confidence AS mean, has_span, 1 AS hops FROM one
  UNION ALL SELECT node, e1, bo.edge_id, via, bo.b, (one.confidence + bo.confidence) / 2, one.has_span OR bo.has_span, 2 FROM one JOIN bo ON one.via = bo.a WHERE bo.b <> node AND bo.b <> via),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY e1, e2 NULLS FIRST, via, "end") AS n FROM f)
SELECT node, via, "end", round((0.35 + 0.25 * mean + CASE WHEN has_span THEN 0.2 ELSE 0 END + CASE WHEN coalesce("end", via) IN (SELECT node FROM dom) THEN 0.1 ELSE 0 END) / hops, 6) AS score FROM k WHERE n <= 20""")
def memory_paths_2hop(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.range(10).withColumnRenamed("id", "node")
    domain = table(spark, sf, "part").where(F.lower("p_name").contains("red")).select((F.col("p_partkey") + PART).alias("node")).unionByName(table(spark, sf, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("node")))
    return G.paths(relations(spark, sf), F.broadcast(seeds), domain)


@query("entity_merge", """
SELECT p_name AS name, p_type AS type, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS spans, arg_max(p_brand, p_partkey) AS description, CAST(count(*) AS BIGINT) AS merged FROM part GROUP BY p_name, p_type""")
def entity_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.array("p_size").alias("spans"), F.col("p_brand").alias("description"), F.col("p_partkey").alias("ts"))
    return G.merge_entities(rows).select("name", "type", F.array_join(F.col("spans").cast("array<string>"), ",").alias("spans"), "description", "merged")


@query("merge_guards", """
WITH c AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_type = b.p_type AS same_type FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey AND a.p_brand = b.p_brand),
s AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
o AS (SELECT DISTINCT a, b FROM c JOIN s x ON x.p = c.a JOIN s y ON y.p = c.b AND y.s = x.s)
SELECT c.a, c.b, CASE WHEN NOT same_type THEN 'rejected' WHEN o.a IS NOT NULL THEN 'accept' ELSE 'ambiguous_candidate' END AS decision FROM c LEFT JOIN o ON c.a = o.a AND c.b = o.b""")
def merge_guards(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of one name and brand: accepted if the types match and a supplier is shared."""
    # A part's suppliers stand in its row, so that pairs are decided where they are made and are never shuffled.
    suppliers = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set("l_suppkey").alias("suppliers"))
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type").join(suppliers, "p_partkey", "left")
    a = p.select(F.col("p_partkey").alias("a"), "p_name", "p_brand", F.col("p_type").alias("type_a"), F.col("suppliers").alias("of_a"))
    b = p.select(F.col("p_partkey").alias("b"), "p_name", "p_brand", F.col("p_type").alias("type_b"), F.col("suppliers").alias("of_b"))
    # Null types are not different ones.
    decision = F.when(F.col("type_a") != F.col("type_b"), "rejected").when(F.coalesce(F.arrays_overlap("of_a", "of_b"), F.lit(False)), "accept").otherwise("ambiguous_candidate")
    return a.join(b, ["p_name", "p_brand"]).where("a < b").select("a", "b", decision.alias("decision"))


@query("graph_audit", f"""WITH {EDGES}, f AS (
  SELECT 'unsupported_active' AS code, edge_id AS id FROM e WHERE lineage < 1 UNION ALL SELECT 'dangling_endpoint', edge_id FROM e WHERE dst - {PART} NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)
  UNION ALL SELECT 'self_loop', edge_id FROM e WHERE src = dst UNION ALL SELECT 'low_confidence', edge_id FROM e WHERE confidence < 0.05)
SELECT code, id FROM f""")
def graph_audit(spark: SparkSession, sf: str) -> DataFrame:
    e = relations(spark, sf)
    known = table(spark, sf, "part").where("p_size <> 7").select((F.col("p_partkey") + PART).alias("dst"))
    found = lambda df, code: df.select(F.lit(code).alias("code"), F.col("edge_id").alias("id"))
    return found(e.where("lineage < 1"), "unsupported_active").unionByName(found(e.join(known, "dst", "left_anti"), "dangling_endpoint")).unionByName(found(e.where("src = dst"), "self_loop")).unionByName(found(e.where("confidence < 0.05"), "low_confidence"))


DAG = """dag AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def dag(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = table(spark, sf, "nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    b = table(spark, sf, "customer").select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"))
    return a.unionByName(b).unionByName(table(spark, sf, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")))


@query("dag_closure", f"""WITH RECURSIVE {DAG}, w(node, depth) AS (SELECT 'r1', 0 UNION ALL SELECT dst, depth + 1 FROM w JOIN dag ON w.node = dag.src)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY node""")
def dag_closure(spark: SparkSession, sf: str) -> DataFrame:
    return G.closure(dag(spark, sf), spark.createDataFrame([("r1",)], "node string"), Workspace(spark, "closure"))


@query("dependency_staleness", """
WITH cur AS (SELECT o_custkey AS artifact, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS hash FROM orders GROUP BY o_custkey),
old AS (SELECT o_custkey AS artifact, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey)) AS hash FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY o_custkey)
SELECT cur.artifact, old.hash IS NULL OR old.hash <> cur.hash AS stale FROM cur LEFT JOIN old USING (artifact)""")
def dependency_staleness(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("artifact"), "o_orderkey")
    hashed = lambda df: df.groupBy("artifact").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), ","), 256).alias("hash"))
    old = hashed(orders.where("o_orderkey % 50 <> 0")).withColumnRenamed("hash", "old")
    return hashed(orders).join(old, "artifact", "left").select("artifact", (F.col("old").isNull() | (F.col("old") != F.col("hash"))).alias("stale"))


_STEP = "r{1} AS MATERIALIZED (SELECT coalesce(m.node, b.node) AS node, coalesce(m.m, 0) + 0.15 * coalesce(b.s, 0) AS r FROM (SELECT st.dst AS node, 0.85 * sum(st.p * r{0}.r) AS m FROM st JOIN r{0} ON st.src = r{0}.node GROUP BY st.dst) m FULL JOIN base b ON m.node = b.node)"


@query("pagerank_personalised", f"""WITH {EDGES}, bo AS (SELECT src, dst, CAST(supports AS DOUBLE) AS weight FROM e UNION ALL SELECT dst, src, supports FROM e), tot AS (SELECT src, sum(weight) AS total FROM bo GROUP BY src),
st AS MATERIALIZED (SELECT bo.src, dst, weight / total AS p FROM bo JOIN tot USING (src)), base AS (SELECT CAST(range AS BIGINT) AS node, CAST(0.1 AS DOUBLE) AS s FROM range(10)), r0 AS (SELECT node, s AS r FROM base),
{', '.join(_STEP.format(i, i + 1) for i in range(30))}
SELECT node, round(r, 6) AS rank FROM r30""")
def pagerank_personalised(spark: SparkSession, sf: str) -> DataFrame:
    edges = relations(spark, sf).select("src", "dst", F.col("supports").cast("double").alias("weight"))
    r = G.pagerank(edges, spark.range(10).withColumnRenamed("id", "node"), Workspace(spark, "pagerank"), rounds=30)
    return r.select("node", F.round("r", 6).alias("rank"))
