"""Queries over tables that change: a refreshed index, substrings, the closure of removals, published generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import vault
from sparkloom.functions.json_text import tolerant_json
from sparkloom.operators import grams
from sparkloom.operators.changes import LiveGraph
from sparkloom.operators.expansion import expanded
from sparkloom.operators.merges import merged
from sparkloom.operators.peers import Replica, Table
from sparkloom.operators.publishing import Publisher
from sparkloom.operators.segments import SegmentedIndex
from sparkloom.plans.knowledge_queries import EDGES, PART, relations
from sparkloom.plans.tables import table
from sparkloom.registry import query
from sparkloom.storage import Workspace

#: The day up to which the first state of a feed goes.
FIRST = "2024-03-01"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; it goes when the driver ends."""
    return Workspace(spark, name).root


def clients_at(changes: DataFrame, before: str | None) -> DataFrame:
    """client_id and text of the clients that a feed of changes leaves: of each the last change, if it isn't a deletion."""
    rows = changes.where("valid_at is not null" if before is None else F.col("valid_at") < F.lit(before).cast("timestamp_ntz"))
    last = rows.groupBy("client_id").agg(F.max_by(F.struct("op", F.concat_ws(" ", "segment", "city", "source").alias("text")), F.struct("seq", "change_id")).alias("c"))
    return last.where("c.op <> 'D'").select("client_id", "c.text")


_AT = "SELECT client_id, concat_ws(' ', segment, city, source) AS text FROM (SELECT * FROM client_changes WHERE {0} QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY seq DESC, change_id DESC) = 1) WHERE op <> 'D'"
STATES = f"a AS ({_AT.format(f'''valid_at < TIMESTAMP '{FIRST}' ''')}), b AS ({_AT.format('valid_at IS NOT NULL')})"


@query("index_refresh", f"""WITH {STATES}, words AS (SELECT client_id, unnest(string_split(strip_accents(lower(text)), ' ')) AS term FROM b),
steps AS (SELECT CASE WHEN a.client_id IS NULL THEN 'inserted' WHEN b.client_id IS NULL THEN 'deleted' WHEN a.text = b.text THEN 'kept' ELSE 'updated' END AS step FROM a FULL JOIN b ON a.client_id = b.client_id)
SELECT 'term' AS kind, term AS name, CAST(count(DISTINCT client_id) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS places FROM words GROUP BY term
UNION ALL SELECT 'step', step, CAST(count(*) AS BIGINT), 0 FROM steps GROUP BY step""")
def index_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary of an index of clients after a refresh from one day's state to the last, counted from its live postings, and what the refresh did."""
    changes = table(spark, sf, "client_changes")
    index = SegmentedIndex(spark, folder(spark, "client-index"))
    index.refresh(clients_at(changes, FIRST), "client_id")
    did = index.refresh(clients_at(changes, None), "client_id")
    steps = [("step", k, n, 0) for k in ("inserted", "updated", "deleted", "kept") if (n := getattr(did, k))]
    terms = index.open().postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("places"))
    return terms.select(F.lit("term").alias("kind"), F.col("term").alias("name"), "n", "places").unionByName(spark.createDataFrame(steps, "kind string, name string, n long, places long"))


@query("gram_search", """WITH p AS (SELECT item_id AS query_id, substr(text, 4, 12 + CAST(item_id % 12 AS INTEGER)) AS phrase FROM benchmark)
SELECT query_id, doc_id, CAST(strpos(lower(text), lower(phrase)) - 1 AS BIGINT) AS first FROM p JOIN documents ON contains(lower(text), lower(phrase))""")
def gram_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a piece of a test item, cut without regard to words, and its first place there."""
    work = Workspace(spark, "grams")
    phrases = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.expr("substring(text, 4, 12 + int(item_id % 12))").alias("phrase"))
    return grams.holding(grams.build_grams(table(spark, sf, "documents"), work), phrases).select("query_id", "doc_id", "first")


_SPREAD = "{0}{2} AS MATERIALIZED (SELECT l.node, least(l.label, coalesce(m.label, l.label), coalesce(j.label, l.label)) AS label FROM {0}{1} l LEFT JOIN (SELECT b AS node, min(label) AS label FROM {0}_both JOIN {0}{1} ON node = a GROUP BY b) m ON m.node = l.node LEFT JOIN {0}{1} j ON j.node = l.label)"


def _components(n: str, edges: str) -> str:
    both = f"{n}_both AS MATERIALIZED (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}), {n}0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS label FROM {n}_both)"
    return ", ".join([both, *(_SPREAD.format(n, i, i + 1) for i in range(16))])


def _sums(value: str, names: str) -> str:
    return ", ".join(f"CAST(sum(CAST('0x' || substr(md5(CAST({value} AS VARCHAR)), {k}, 8) AS BIGINT)) AS BIGINT) AS {names}{i}" for i, k in ((1, 1), (2, 9)))


def _reports(n: str, edges: str, supports: str) -> str:
    return f"""{n}_e AS (SELECT e.*, label AS component FROM {edges} e JOIN {n}16 ON node = src),
{n}_m AS (SELECT component, CAST(count(*) AS BIGINT) AS members, {_sums('node', 'm')} FROM (SELECT DISTINCT component, unnest([src, dst]) AS node FROM {n}_e) GROUP BY component),
{n}_r AS (SELECT component, CAST(count(*) AS BIGINT) AS relations FROM {n}_e GROUP BY component),
{n}_a AS (SELECT component, {_sums('edge_id', 'a')} FROM {n}_e WHERE authored GROUP BY component),
{n}_s AS (SELECT component, {_sums("edge_id || ':' || support", 's')} FROM {n}_e JOIN {supports} USING (edge_id) WHERE NOT authored GROUP BY component),
{n}_reports AS (SELECT 'comm-' || substr(sha256(concat_ws('|', m1, m2, s1, s2, coalesce(a1, 0), coalesce(a2, 0), 'v1')), 1, 12) AS community, members, relations FROM {n}_m JOIN {n}_r USING (component) JOIN {n}_s USING (component) LEFT JOIN {n}_a USING (component))"""


CLOSURE_SQL = f"""WITH lines AS (SELECT l_suppkey AS src, l_partkey + {PART} AS dst, l_suppkey * 10000000000 + l_partkey + {PART} AS edge_id, l_orderkey AS support FROM lineitem WHERE l_discount = 0.1 AND l_quantity > 48),
edges AS (SELECT DISTINCT edge_id, src, dst, p_size <= 5 AS authored FROM lines JOIN part ON p_partkey + {PART} = dst), sups AS (SELECT DISTINCT edge_id, support FROM lines),
sups1 AS (SELECT * FROM sups WHERE support NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')),
edges1 AS (SELECT * FROM edges WHERE authored OR edge_id IN (SELECT edge_id FROM sups1)),
{_components('x', 'edges')}, {_reports('x', 'edges', 'sups')}, {_components('y', 'edges1')}, {_reports('y', 'edges1', 'sups1')}
SELECT coalesce(x.community, y.community) AS community, coalesce(y.members, x.members) AS members, coalesce(y.relations, x.relations) AS relations, CASE WHEN y.community IS NULL THEN 'retired' WHEN x.community IS NULL THEN 'built' ELSE 'kept' END AS action FROM x_reports x FULL JOIN y_reports y ON x.community = y.community"""


@query("change_closure", CLOSURE_SQL)
def change_closure(spark: SparkSession, sf: str) -> DataFrame:
    """What a removal of spans (urgent orders) does to the communities of suppliers and parts that large discounted lines relate."""
    lines = table(spark, sf, "lineitem").where("l_discount = 0.1 and l_quantity > 48").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART).alias("dst"), F.expr(f"l_suppkey * 10000000000L + l_partkey + {PART}").alias("edge_id"), F.col("l_orderkey").alias("support"))
    size = table(spark, sf, "part").select((F.col("p_partkey") + PART).alias("dst"), (F.col("p_size") <= 5).alias("authored"))
    relations = lines.select("edge_id", "src", "dst").distinct().join(size, "dst").select("edge_id", "src", "dst", "authored")
    supports = lines.select("edge_id", "support", F.col("support").alias("lineage"), F.col("support").alias("span")).distinct()
    live = LiveGraph(spark, folder(spark, "live-graph"), "v1")
    live.build(relations, supports)
    before = live.reports().select("community", "members", "relations")
    live.remove(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("span")))
    after = live.reports().select("community", F.col("members").alias("m"), F.col("relations").alias("r"))
    action = F.when(F.col("m").isNull(), "retired").when(F.col("members").isNull(), "built").otherwise("kept")
    return before.join(after, "community", "full").select("community", F.coalesce("m", "members").alias("members"), F.coalesce("r", "relations").alias("relations"), action.alias("action"))


def feed_gate(units: DataFrame) -> DataFrame:
    """Clients with an undated change, or with different changes under one number."""
    undated = units.where("valid_at is null").select("client_id", F.lit("undated").alias("code"))
    clash = units.groupBy("client_id", "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("client_id", F.lit("clash").alias("code"))
    return undated.unionByName(clash)


@query("publish_generations", f"""WITH d AS (SELECT DISTINCT * FROM client_changes WHERE client_id IS NOT NULL), clash AS (SELECT client_id, seq, max(valid_at) AS late FROM d GROUP BY client_id, seq HAVING count(*) > 1),
clash1 AS (SELECT client_id FROM d WHERE valid_at < TIMESTAMP '{FIRST}' GROUP BY client_id, seq HAVING count(*) > 1),
one AS (SELECT client_id, count(*) AS n, client_id NOT IN (SELECT client_id FROM clash1) AS ok FROM d WHERE valid_at < TIMESTAMP '{FIRST}' GROUP BY client_id),
two AS (SELECT client_id, count(*) AS n, count(valid_at) = count(*) AND client_id NOT IN (SELECT client_id FROM clash) AS ok FROM d GROUP BY client_id)
SELECT client_id, CASE WHEN one.ok AND one.n = two.n THEN 'unchanged' WHEN two.ok THEN 'published' ELSE 'refused' END AS status, CAST(CASE WHEN one.ok AND one.n = two.n THEN 1 WHEN two.ok THEN 2 WHEN one.ok THEN 1 END AS BIGINT) AS generation,
CAST(CASE WHEN one.ok AND one.n = two.n THEN one.n WHEN two.ok THEN two.n WHEN one.ok THEN one.n ELSE 0 END AS BIGINT) AS units FROM two LEFT JOIN one USING (client_id)""")
def publish_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of a feed: the second publishes the clients that have changed and pass the gate, the others keep what they had."""
    changes = table(spark, sf, "client_changes")
    published = Publisher(spark, folder(spark, "generations"), "client_id", "v1")
    published.publish(changes.where(F.col("valid_at") < F.lit(FIRST).cast("timestamp_ntz")), feed_gate)
    status = published.publish(changes, feed_gate)
    held = published.units().groupBy("client_id").agg(F.count(F.lit(1)).alias("units"))
    return status.join(held, "client_id", "left").select("client_id", "status", "generation", F.coalesce("units", F.lit(0).cast("long")).alias("units"))


# A note around each document: a head, code, comments, links of each kind, the text, and one more link, which a comment left open in the text hides.
_NOTE = """concat('---\ntags: [', lang, ', 2024]\nup: "[[', source, '#top|up]]"\n---\n`[[code]]` [[', source, '|s]] ![[', lang, '.png]] [t](', source, '/', {id}, '.md#x "T") \\\\[[no]] [out](https://example.org/', {id}, ') #', lang, '/a #12 <!-- [[hidden]] -->\n```\n[[fenced]]\n```\n', coalesce(text, ''), '\n[[', source, '-end]]')"""
_LAST = r"regexp_replace(concat(coalesce(text, ''), chr(10), '[[', source, '-end]]'), '(?s)%%.*?(%%|\z)', '', 'g')"


@query("authored_links", f"""WITH d AS (SELECT * FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), tags AS (SELECT doc_id, unnest(regexp_extract_all({_LAST}, '(?:^|[^\\p{{L}}\\p{{N}}_/#&])#([\\p{{L}}\\p{{N}}_/-]+)', 1)) AS tag FROM d)
SELECT doc_id, 'tag' AS kind, lang AS target FROM d UNION ALL SELECT doc_id, 'property', source FROM d UNION ALL SELECT doc_id, 'wikilink', source FROM d UNION ALL SELECT doc_id, 'embed', lang || '.png' FROM d
UNION ALL SELECT doc_id, 'link', source || '/' || doc_id || '.md' FROM d UNION ALL SELECT doc_id, 'external', 'https://example.org/' || doc_id FROM d UNION ALL SELECT doc_id, 'tag', lang || '/a' FROM d
UNION ALL SELECT doc_id, 'wikilink', source || '-end' FROM d WHERE contains({_LAST}, '-end]]') UNION ALL SELECT doc_id, 'tag', lower(tag) FROM tags WHERE regexp_matches(replace(tag, '/', ''), '[^0-9]')""")
def authored_links(spark: SparkSession, sf: str) -> DataFrame:
    """What is linked in a note around each document: code and comments, those in the text too, hide links."""
    d = table(spark, sf, "documents").where("source is not null and lang is not null")
    note = F.expr(_NOTE.format(id="cast(doc_id as string)"))
    return vault.authored_links(d.select("doc_id", note.alias("note")), "doc_id", "note").select("doc_id", "kind", "target")


PEERS = ["crm", "partner", "store", "web"]
PEER_TABLES = [
    Table("clients", "client_id long, master_id long, source string, updated_at timestamp_ntz", "client_id", ["master_id"], "updated_at"),
    Table("sales", "sale_id long, client_id long, sold_at timestamp_ntz", "sale_id", ["sale_id"], "sold_at", {"client_id": "clients"}),
    Table("lines", "line string, sale_id long, line_no long, shipped_at timestamp_ntz", "line", ["sale_id", "line_no"], "shipped_at", {"sale_id": "sales"}),
]


@query("peer_import", """WITH winner AS (SELECT * FROM clients WHERE master_id IS NOT NULL AND client_id IS NOT NULL AND source IN ('crm', 'partner', 'store', 'web') QUALIFY row_number() OVER (PARTITION BY master_id ORDER BY updated_at DESC NULLS LAST, source DESC, CAST(client_id AS VARCHAR) DESC) = 1),
own AS (SELECT client_id, source, min(master_id) AS master_id FROM clients WHERE master_id IS NOT NULL AND source IN ('crm', 'partner', 'store', 'web') GROUP BY client_id, source),
gone AS (SELECT master_id, max(valid_at) AS deleted_at FROM client_changes x JOIN own USING (client_id, source) WHERE op = 'D' AND valid_at IS NOT NULL GROUP BY master_id),
live AS (SELECT w.master_id, w.source FROM winner w LEFT JOIN gone g ON g.master_id = w.master_id WHERE g.master_id IS NULL OR w.updated_at > g.deleted_at),
s AS (SELECT sale_id, arg_max(master_id, (sold_at, source)) AS master_id FROM sales JOIN own USING (client_id) WHERE sale_id IS NOT NULL GROUP BY sale_id),
l AS (SELECT DISTINCT sale_id, line_no FROM sale_lines WHERE sale_id IN (SELECT sale_id FROM s) AND line_no IS NOT NULL)
SELECT live.master_id, live.source, CAST(count(DISTINCT s.sale_id) AS BIGINT) AS sales, CAST(count(l.line_no) AS BIGINT) AS lines FROM live LEFT JOIN s ON s.master_id = live.master_id LEFT JOIN l ON l.sale_id = s.sale_id GROUP BY live.master_id, live.source""")
def peer_import(spark: SparkSession, sf: str) -> DataFrame:
    """What a replica holds after the exports of four sources, one of them twice, children before parents: living clients with their sales and lines."""
    clients, sales, lines = (table(spark, sf, t) for t in ("clients", "sales", "sale_lines"))
    # Joined and dealt to their peers once; each pull reads its own folders.
    work = Workspace(spark, "exports")
    owner = clients.select("client_id", F.col("source").alias("peer")).where(F.col("peer").isin(PEERS))
    sold = work.put(sales.join(owner, "client_id").select("peer", "sale_id", "client_id", "sold_at"), "sold", by="peer")
    shipped = lines.join(sold.select("peer", "sale_id"), "sale_id").select("peer", F.concat_ws("-", "sale_id", "line_no", "item_id", "vendor_id").alias("line"), "sale_id", F.col("line_no").cast("long").alias("line_no"), "shipped_at")
    shipped = work.put(shipped, "shipped", by="peer")
    gone = table(spark, sf, "client_changes").where("op = 'D'").select(F.col("source").alias("peer"), F.col("client_id").alias("local"), F.col("valid_at").alias("deleted_at"))
    replica = Replica(spark, folder(spark, "replica"), PEER_TABLES)
    own = lambda df, peer: df.where(F.col("peer") == peer).drop("peer")
    for peer in PEERS:
        children, parents = {"sales": own(sold, peer), "lines": own(shipped, peer)}, {"clients": clients.where(F.col("source") == peer)}
        if peer == PEERS[0]:
            replica.pull(peer, "children", children, {})
            replica.pull(peer, "parents", parents, {"clients": own(gone, peer)})
            replica.pull(peer, "children", children, {})
        else:
            replica.pull(peer, "all", children | parents, {"clients": own(gone, peer)})
    held = replica.table("sales").select(F.col("client_id").alias("id"), F.col("id").alias("sale"))
    of_sale = replica.table("lines").groupBy(F.col("sale_id").alias("sale")).agg(F.count(F.lit(1)).alias("lines"))
    sums = held.join(of_sale, "sale", "left").groupBy("id").agg(F.count(F.lit(1)).alias("sales"), F.sum("lines").alias("lines"))
    zero = F.lit(0).cast("long")
    return replica.table("clients").join(sums, "id", "left").select("master_id", "source", F.coalesce("sales", zero).alias("sales"), F.coalesce("lines", zero).alias("lines"))


BUDGET = 8
_LEVEL = """looks{1} AS MATERIALIZED (SELECT query, "to", kind, path, t FROM (SELECT f.query, w."to", w.kind, f.path, row_number() OVER (PARTITION BY f.query ORDER BY f.step, w.way) + u.used AS t FROM level{0} f JOIN ways w ON w.node = f.node JOIN used{0} u ON u.query = f.query) WHERE t <= {2}),
level{1} AS MATERIALIZED (SELECT query, "to" AS node, min(t) AS step, arg_min(path, t) || ',' || "to" AS path FROM looks{1} WHERE (query, "to") NOT IN (SELECT (query, node) FROM seen{0}) GROUP BY query, "to"),
seen{1} AS MATERIALIZED (SELECT query, node FROM seen{0} UNION ALL SELECT query, node FROM level{1}), used{1} AS MATERIALIZED (SELECT query, max(t) AS used FROM looks{1} GROUP BY query)"""


@query("bounded_expansion", f"""WITH {EDGES}, b AS (SELECT src AS node, dst AS "to", edge_id AS kind, confidence FROM e WHERE confidence >= 0.7 UNION ALL SELECT dst, src, edge_id, confidence FROM e WHERE confidence >= 0.7),
ways AS MATERIALIZED (SELECT node, "to", kind, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, "to", kind) AS way FROM b QUALIFY way <= {BUDGET}),
level0 AS MATERIALIZED (SELECT s_nationkey AS query, s_suppkey AS node, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS step, CAST(s_suppkey AS VARCHAR) AS path FROM supplier UNION ALL SELECT 1000 + s_suppkey, s_suppkey, 1, CAST(s_suppkey AS VARCHAR) FROM supplier),
seen0 AS (SELECT query, node FROM level0), used0 AS (SELECT DISTINCT query, 0 AS used FROM level0), {', '.join(_LEVEL.format(i, i + 1, BUDGET) for i in range(BUDGET))}
{' UNION ALL '.join(f'SELECT query, node, CAST(step AS BIGINT) AS step, path FROM level{i + 1}' for i in range(BUDGET))}""")
def bounded_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """What each nation's suppliers together, and each supplier alone, lead to over eight confident relations, with the path."""
    edges = relations(spark, sf).select("src", "dst", F.col("edge_id").alias("kind"), "confidence")
    s = table(spark, sf, "supplier")
    seeds = s.select(F.col("s_nationkey").cast("long").alias("query"), F.col("s_suppkey").alias("node")).unionByName(s.select((1000 + F.col("s_suppkey")).alias("query"), F.col("s_suppkey").alias("node")))
    return expanded(edges, seeds, Workspace(spark, "expansion"), BUDGET, 0.7).select("query", "node", "step", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("tolerant_json", """WITH p AS (SELECT click_id, CASE WHEN json_valid(props) THEN props ELSE props || '}' END AS j FROM clicks WHERE props IS NOT NULL)
SELECT click_id, CAST(j ->> '$.k' AS BIGINT) AS k, j ->> '$.device.os' AS os, CAST(json_array_length(j, '$.items') AS BIGINT) AS items FROM p""")
def tolerant_json_query(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of clicks, some cut off, in turn as they are, fenced in prose, and with commas too many and a comment."""
    c = table(spark, sf, "clicks").where("props is not null")
    raw = F.when(F.col("click_id") % 3 == 0, F.col("props")).when(F.col("click_id") % 3 == 1, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n``` and that is all")))
    raw = raw.otherwise(F.concat(F.regexp_replace("props", r"([}\]])", ",$1"), F.lit(" // the end")))
    v = c.select("click_id", tolerant_json(raw).alias("v"))
    get = lambda path, kind: F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    return v.select("click_id", get("k", "long").alias("k"), get("device.os", "string").alias("os"), F.size(get("items", "array<variant>")).cast("long").alias("items"))


@query("merge_decisions", f"""WITH {EDGES} SELECT edge_id, CASE WHEN src % 20 = 3 THEN src WHEN src % 10 = 3 THEN src + 2 WHEN src % 10 = 4 THEN src + 1 ELSE src END AS src, dst,
  CAST(CASE WHEN src % 10 = 3 THEN 2 WHEN src % 10 = 4 THEN 1 ELSE 0 END AS BIGINT) AS moves FROM e""")
def merge_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Relations after merges of suppliers, in two steps, of which every second story is taken back at its first step; and how often each end was moved."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("s")).where("s % 10 in (3, 4)")
    event = lambda df, action, place: df.select(F.col("s").alias("decision"), place.cast("long").alias("place"), F.lit(action).alias("action"), F.col("s").alias("origin"), (F.col("s") + 1).alias("survivor"))
    events = event(s, "propose", F.lit(-1)).unionByName(event(s, "accept", F.col("s"))).unionByName(event(s.where("s % 20 = 3"), "reverse", F.col("s") + 1_000_000_000))
    edges, lineage = merged(relations(spark, sf).select("edge_id", "src", "dst"), events, Workspace(spark, "merge-decisions"))
    moves = lineage.groupBy("edge_id").agg(F.count(F.lit(1)).alias("moves"))
    return edges.join(moves, "edge_id", "left").select("edge_id", "src", "dst", F.coalesce("moves", F.lit(0).cast("long")).alias("moves"))
