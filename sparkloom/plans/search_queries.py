"""Queries over the search index: lexical, vector, fused and reranked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import questions as Q
from sparkloom.functions import text as T
from sparkloom.operators import index as X
from sparkloom.operators import search as S
from sparkloom.operators.segments import shared_index
from sparkloom.plans.tables import table
from sparkloom.plans.text_queries import _PARAGRAPHS, QUALITY, document_spans
from sparkloom.registry import query
from sparkloom.storage import Workspace

FOLD_SQL = f"translate(lower({{}}), '{T.ACCENTED}', '{T.FOLDED}')"


def tokens_sql(text: str) -> str:
    return "regexp_extract_all(" + FOLD_SQL.format(text) + ", '[\\p{L}\\p{N}_.\\-]+')"


def the_index(spark: SparkSession, sf: str) -> X.Index:
    """The index of the documents: built once in an application, read by all queries, refreshed when the table has changed."""
    return shared_index(table(spark, sf, "documents"), sf)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """A question for each test item: the first six different tokens of more than three letters."""
    terms = F.slice(F.array_distinct(F.filter(T.index_tokens(F.col("text")), lambda t: F.length(t) > 3)), 1, 6)
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms"))


QUESTIONS = f"""questions AS (SELECT item_id AS query_id, list_filter(t, lambda x, i: list_position(t, x) = i)[1:6] AS terms
  FROM (SELECT item_id, list_filter({tokens_sql('text')}, lambda t: length(t) > 3) AS t FROM benchmark))"""

CORPUS = f"""rows_ AS (SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents),
stats AS (SELECT count(*) AS n_docs, sum(len(tokens)) / count(*) AS avgdl FROM rows_),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM rows_) GROUP BY doc_id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
BM25 = f"""{QUESTIONS}, wanted AS (SELECT query_id, unnest(terms) AS term FROM questions), {CORPUS},
lex AS (SELECT query_id, doc_id, round(sum((CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END)
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN df USING (term) JOIN wanted USING (term), stats GROUP BY query_id, doc_id)"""


def lexical(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents that hold a term of a question."""
    return X.scored_terms(the_index(spark, sf), questions(spark, sf))


@query("bm25_topk", f"""WITH {BM25}
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex) WHERE rank <= 10""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return X.ranked(lexical(spark, sf), 10)


@query("postings_stats", f"""WITH {CORPUS} SELECT term, CAST(df AS BIGINT) AS df, CAST(cf AS BIGINT) AS cf FROM df JOIN (SELECT term, sum(tf) AS cf FROM tf GROUP BY term) USING (term)""")
def postings_stats(spark: SparkSession, sf: str) -> DataFrame:
    return the_index(spark, sf).vocabulary.select("term", "df", "cf")


#: Words that the page index leaves out.
PAGE_STOP = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "their", "this", "to", "was", "were", "with"]
_STOPPED = "[" + ", ".join(f"'{w}'" for w in PAGE_STOP) + "]"
PAGE_TOKENS = "list_filter(regexp_extract_all(" + FOLD_SQL.format("text") + f", '[\\p{{L}}\\p{{N}}]{{2,}}'), lambda w: NOT list_contains({_STOPPED}, w))"
PAGE_QUESTION = ["der", "die", "und", "nation", "thing"]


def page_tokens(text: F.Column) -> F.Column:
    return F.filter(F.regexp_extract_all(T.fold(text), F.lit(r"([\p{L}\p{N}]{2,})"), 1), lambda w: ~w.isin(PAGE_STOP))


@query("bm25_page_topk", f"""
WITH {_PARAGRAPHS}, rows_ AS (SELECT source_id, pos, text, {PAGE_TOKENS} AS tokens, {QUALITY.format('text')} AS quality FROM spans),
stats AS (SELECT count(*) AS n, sum(len(tokens)) / count(*) AS avgdl FROM rows_),
tf AS (SELECT source_id, pos, len(tokens) AS dl, term, count(*) AS tf FROM (SELECT source_id, pos, tokens, unnest(tokens) AS term FROM rows_) GROUP BY source_id, pos, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT source_id, pos, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / greatest(1, avgdl)))) AS score
  FROM tf JOIN df USING (term), stats WHERE list_contains({PAGE_QUESTION}, term) GROUP BY source_id, pos)
SELECT source_id, pos, round(score * (0.6 + 0.4 * quality), 4) AS score, CASE WHEN length(text) > 360 THEN substr(text, 1, 357) || '...' ELSE text END AS snippet
FROM sc JOIN rows_ USING (source_id, pos) ORDER BY score DESC, source_id, pos LIMIT 20""")
def bm25_page_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best pages (paragraphs) by the page formula, better text counting for more, and the best line of each (here the one it has)."""
    tokens = document_spans(spark, sf).select("source_id", "pos", "text", page_tokens(F.col("text")).alias("tokens"))
    rows = tokens.select("source_id", "pos", F.size("tokens").alias("dl"), F.filter("tokens", lambda t: t.isin(PAGE_QUESTION)).alias("wanted"), "text")
    # Pages are made and read once; only those that hold a word of the question keep their text.
    pages = Workspace(spark, "pages").put(rows.withColumn("text", F.when(F.size("wanted") > 0, F.col("text"))), "pages")
    stats = pages.agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))
    found = pages.where(F.size("wanted") > 0)
    df = found.select(F.explode(F.array_distinct("wanted")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # One row of numbers, with one entry for each word of the question.
    numbers = stats.crossJoin(df.agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("dfs")))

    def part(t: F.Column) -> F.Column:
        tf, df = F.size(F.filter("wanted", lambda x: x == t)), F.element_at("dfs", t)
        return F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("dl") / F.greatest(F.lit(1.0), F.col("avgdl"))))

    total = F.aggregate(F.transform(F.array_distinct("wanted"), part), F.lit(0.0), lambda a, x: a + x)
    scored = found.crossJoin(F.broadcast(numbers)).select("source_id", "pos", "text", total.alias("sum"), T.text_quality(F.col("text")).alias("quality"))
    line = F.when(F.length("text") > 360, F.concat(F.substring("text", 1, 357), F.lit("..."))).otherwise(F.col("text"))
    best = scored.select("source_id", "pos", F.round(F.col("sum") * (0.6 + 0.4 * F.col("quality")), 4).alias("score"), line.alias("snippet"))
    return best.orderBy(F.desc("score"), "source_id", "pos").limit(20)


@query("lexical_score_pages", """
WITH s AS (SELECT page_id, lower(html) AS t, html FROM pages),
c AS (SELECT page_id, CAST(5 * (length(t) - length(replace(t, 'der die', ''))) / 7 + (length(t) - length(replace(t, 'der', ''))) / 3 + (length(t) - length(replace(t, 'die', ''))) / 3 AS BIGINT) AS score FROM s)
SELECT page_id, score FROM c WHERE score > 0 ORDER BY score DESC, page_id LIMIT 50""")
def lexical_score_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", S.lexical_score(F.col("html"), "der die", ["der", "die"]).alias("score"))
    return pages.where("score > 0").orderBy(F.desc("score"), "page_id").limit(50)


@query("snippet_window", """
WITH a AS (SELECT doc_id, text, greatest(strpos(lower(text), ' und ') - 1 - 106, 0) AS p FROM documents WHERE strpos(lower(text), ' und ') > 0)
SELECT doc_id, CASE WHEN p > 0 THEN '…' ELSE '' END || substr(text, CAST(p + 1 AS INT), 320) || CASE WHEN p + 320 < length(text) THEN '…' ELSE '' END AS snippet FROM a""")
def snippet_window(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.instr(F.lower("text"), " und ") > 0).select("doc_id", S.snippet(F.col("text"), " und ").alias("snippet"))


@query("like_fallback", """
WITH hits AS (SELECT doc_id FROM documents WHERE text LIKE '%검색%' OR text LIKE '%検索%'), n AS (SELECT count(*) AS n FROM hits)
SELECT doc_id, CAST(0 AS DOUBLE) AS score FROM documents, n WHERE n.n = 0 AND (contains(text, 'und ') OR contains(text, 'the '))""")
def like_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Where the first search finds nothing, plain containment with score 0."""
    docs = table(spark, sf, "documents")
    n = docs.where(F.col("text").contains("검색") | F.col("text").contains("検索")).agg(F.count(F.lit(1)).alias("n"))
    return docs.crossJoin(F.broadcast(n)).where((F.col("n") == 0) & (F.col("text").contains("und ") | F.col("text").contains("the "))).select("doc_id", F.lit(0.0).alias("score"))


@query("trigram_search", """
WITH g AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, CAST((length(t) - length(replace(t, 'tion', ''))) / 4 AS BIGINT) AS tf FROM g WHERE contains(t, 'tion') ORDER BY tf DESC, doc_id LIMIT 30""")
def trigram_search(spark: SparkSession, sf: str) -> DataFrame:
    """Substring search with the number of places as the score."""
    t = F.lower("text")
    tf = ((F.length(t) - F.length(F.replace(t, F.lit("tion"), F.lit("")))) / 4).cast("long")
    return table(spark, sf, "documents").where(t.contains("tion")).select("doc_id", tf.alias("tf")).orderBy(F.desc("tf"), "doc_id").limit(30)


_UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))))"
KNN = f"""u AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), q AS (SELECT vec_id AS query_id, v AS qv FROM u WHERE vec_id % 100 = 0),
sims AS (SELECT query_id, vec_id, label, round(list_sum(list_transform(list_zip(v, qv), lambda p: p[1] * p[2])), 6) AS score FROM u, q)"""


def vectors_and_queries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    return e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v")


@query("vector_knn", f"""WITH {KNN}
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims) WHERE rank <= 10""")
def vector_knn(spark: SparkSession, sf: str) -> DataFrame:
    e, q = vectors_and_queries(spark, sf)
    return S.cosine_topk(e, q, 10)


@query("vector_best_chunk", f"""WITH {KNN}
SELECT query_id, CAST(label AS BIGINT) AS record, max(score) AS score, arg_min(vec_id, (-score, vec_id)) AS chunk_id FROM sims GROUP BY query_id, label""")
def vector_best_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """The best chunk of each record (label) for each query."""
    e, q = vectors_and_queries(spark, sf)
    return S.best_chunks(e.withColumnRenamed("label", "record"), q).select("query_id", F.col("record").cast("long").alias("record"), "score", F.col("vec_id").alias("chunk_id"))


@query("vector_validation", """
SELECT vec_id, len(embedding) = 64 AS right_dims, list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS finite,
  round(sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))), 6) AS norm FROM embeddings""")
def vector_validation(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table(spark, sf, "embeddings").select("vec_id", (F.size(v) == 64).alias("right_dims"), finite.alias("finite"), F.round(F.sqrt(S.dot(v, v)), 6).alias("norm"))


#: Two lists for each question: BM25, and the vectors nearest to that of the item's number.
LISTS = f"""{BM25}, u AS (SELECT vec_id, {_UNIT} AS v FROM embeddings), qv AS (SELECT item_id AS query_id, v AS qv FROM benchmark JOIN u ON vec_id = item_id),
sims AS (SELECT query_id, vec_id AS doc_id, round(list_sum(list_transform(list_zip(v, qv), lambda p: p[1] * p[2])), 6) AS score FROM u, qv),
l1 AS (SELECT query_id, 'lex_raw' AS list, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex),
l2 AS (SELECT query_id, 'vec_raw' AS list, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sims),
lists AS (SELECT * FROM l1 WHERE rank <= 100 UNION ALL SELECT * FROM l2 WHERE rank <= 100),
fused AS (SELECT query_id, doc_id, round(sum(CASE list WHEN 'lex_raw' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END / (60 + rank) + CASE WHEN rank = 1 THEN 0.5::DOUBLE / 61 ELSE 0::DOUBLE END), 6) AS score, CAST(count(*) AS BIGINT) AS lists,
  string_agg(list || ':' || rank, ',' ORDER BY list) AS trace FROM lists GROUP BY query_id, doc_id),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 40)"""


def vector_hits(spark: SparkSession, sf: str, k: int = S.LIST_CAP) -> DataFrame:
    """The vectors nearest to that of a question, which is the one with the item's number."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    q = e.join(table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query_id"), "v")
    return S.cosine_topk(e, q, k).withColumnRenamed("vec_id", "doc_id")


def listed(hits: DataFrame, name: str) -> DataFrame:
    return hits.select("query_id", F.lit(name).alias("list"), "doc_id", "rank")


def fused(spark: SparkSession, sf: str) -> DataFrame:
    lex = X.ranked(lexical(spark, sf), S.LIST_CAP)
    return S.rrf(listed(lex, "lex_raw").unionByName(listed(vector_hits(spark, sf), "vec_raw")))


@query("rrf_fuse", f"WITH {LISTS} SELECT query_id, doc_id, score, lists, trace, rank FROM ranked")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return fused(spark, sf)


STATUS = "CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'unchecked' END"
DEMOTED = f"""{LISTS}, st AS (SELECT doc_id, {STATUS} AS status FROM labels),
dem AS (SELECT query_id, doc_id, round(score * CASE coalesce(status, '') WHEN 'verified' THEN CAST(1.0 AS DOUBLE) WHEN 'unchecked' THEN CAST(0.85 AS DOUBLE) WHEN 'uncertain' THEN CAST(0.80 AS DOUBLE) WHEN 'failed' THEN CAST(0.70 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END, 6) AS score FROM ranked LEFT JOIN st USING (doc_id)),
demoted AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dem)"""


def statuses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", F.expr(STATUS).alias("status"))


def demoted(spark: SparkSession, sf: str) -> DataFrame:
    return S.demote(fused(spark, sf).join(statuses(spark, sf), "doc_id", "left")).select("query_id", "doc_id", "score", "rank")


@query("support_demote", f"WITH {DEMOTED} SELECT query_id, doc_id, score, rank FROM demoted")
def support_demote(spark: SparkSession, sf: str) -> DataFrame:
    return demoted(spark, sf)


@query("rerank_blend", f"""WITH {DEMOTED},
mm AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN CAST(1.0 AS DOUBLE) ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS m FROM demoted WINDOW w AS (PARTITION BY query_id)),
ce AS (SELECT mm.query_id, mm.doc_id, m, len(list_filter(terms, lambda t: list_contains({tokens_sql('text')}, t))) / greatest(len(terms), 1) AS c FROM mm JOIN documents USING (doc_id) JOIN questions USING (query_id)),
b AS (SELECT query_id, doc_id, round(0.7 * c + 0.3 * m, 6) AS score FROM ce)
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b) WHERE rank <= 8""")
def rerank_blend(spark: SparkSession, sf: str) -> DataFrame:
    """The default reranker scores the share of the question's terms that a document has."""
    hits = demoted(spark, sf).withColumn("m", S.minmax(F.col("score"), ["query_id"]))
    rows = hits.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(X.checked(questions(spark, sf)), "query_id")
    c = F.size(F.array_intersect("terms", T.index_tokens(F.col("text")))) / F.greatest(F.size("terms"), F.lit(1))
    blended = rows.select("query_id", "doc_id", F.round(0.7 * c + 0.3 * F.col("m"), 6).alias("score"))
    return S.top(blended, 8, ["query_id"], [F.desc("score"), F.asc("doc_id")])


@query("min_score_filter", f"""WITH {DEMOTED}, x AS (SELECT *, count(*) FILTER (score >= 0.03) OVER (PARTITION BY query_id) AS n FROM demoted)
SELECT query_id, doc_id, score FROM x WHERE score >= 0.03 OR (n = 0 AND rank = 1)""")
def min_score_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of a least score; the best one stays where none reaches it."""
    from pyspark.sql import Window

    n = F.sum(F.when(F.col("score") >= 0.03, 1).otherwise(0)).over(Window.partitionBy("query_id"))
    return demoted(spark, sf).withColumn("n", n).where("score >= 0.03 or (n = 0 and rank = 1)").select("query_id", "doc_id", "score")


@query("expansion_recovery_gate", f"""WITH {BM25}, h AS (SELECT questions.query_id, count(doc_id) AS n FROM questions LEFT JOIN lex USING (query_id) GROUP BY questions.query_id)
SELECT query_id, CAST(n AS BIGINT) AS lexical_hits, n < 5 AS expand FROM h""")
def expansion_recovery_gate(spark: SparkSession, sf: str) -> DataFrame:
    hits = lexical(spark, sf).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return questions(spark, sf).join(hits, "query_id", "left").select("query_id", n.alias("lexical_hits"), (n < 5).alias("expand"))


#: Words that name no entity.
SEED_STOP = ["the", "and", "for", "with", "what", "which", "that", "this", "from", "into", "does", "are", "how", "why", "when", "where", "between", "about", "of", "to", "is", "a", "an", "in", "on"]
_SEED_STOP = "[" + ", ".join(f"'{w}'" for w in SEED_STOP) + "]"


@query("seed_terms", f"""
WITH t AS (SELECT item_id, list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+\\-]*'), lambda w: (length(w) > 3 OR w = upper(w)) AND NOT list_contains({_SEED_STOP}, lower(w))) AS w FROM benchmark)
SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:8], ' ') AS terms FROM t""")
def seed_terms(spark: SparkSession, sf: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"([A-Za-z][A-Za-z0-9+\-]*)"), 1)
    keep = F.filter(words, lambda w: ((F.length(w) > 3) | (w == F.upper(w))) & ~F.lower(w).isin(SEED_STOP))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(F.array_distinct(keep), 1, 8), " ").alias("terms"))


#: What in a question asks for connections, and what for an overview.
EXPLORE = r"\b(what else|find connections?|new insight|explore|brainstorm|related ideas?|how (?:might|could)|connections? between)\b"
OVERVIEW = r"\b(overall|summar(?:y|ize|ise)|across (?:all|the)|in general|big picture|themes?|landscape|state of)\b"
#: Modes, intents and scopes that turns ask for, by their numbers, and what the policy of a conversation allows.
_ASKED = """SELECT conv_id, turn, text, CASE WHEN turn % 7 = 3 THEN 'global' WHEN turn % 11 = 5 THEN 'explore' ELSE 'auto' END AS mode,
  CASE WHEN conv_id % 13 = 4 THEN 'src1' END AS source_key, CASE WHEN conv_id % 5 = 1 THEN 'discovery' WHEN conv_id % 5 = 2 THEN 'synthesis' WHEN conv_id % 17 = 3 THEN 'lookup' END AS intent,
  conv_id % 4 <> 0 AS allows_global, conv_id % 3 <> 0 AS allows_explore FROM conversations WHERE role = 'user'"""


@query("graph_status", """SELECT EXISTS (SELECT 1 FROM supplier) AS has_entities, EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'A') AS has_relations, EXISTS (SELECT 1 FROM region WHERE r_regionkey > 0) AS has_reports""")
def graph_status(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda df, name: df.limit(1).agg((F.count(F.lit(1)) > 0).alias(name))
    rows = some(table(spark, sf, "supplier"), "has_entities").crossJoin(some(table(spark, sf, "lineitem").where("l_returnflag = 'A'"), "has_relations"))
    return rows.crossJoin(some(table(spark, sf, "region").where("r_regionkey > 0"), "has_reports"))


@query("route_choice", f"""
WITH q AS ({_ASKED}), g AS (SELECT EXISTS (SELECT 1 FROM supplier) AS has_entities, EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'A') AS has_relations, EXISTS (SELECT 1 FROM region WHERE r_regionkey > 0) AS has_reports),
w AS (SELECT conv_id, turn, allows_global, allows_explore, CASE WHEN mode <> 'auto' THEN mode WHEN source_key IS NOT NULL THEN 'source-section' WHEN intent = 'discovery' AND allows_explore AND has_relations THEN 'explore'
  WHEN intent = 'synthesis' AND has_reports THEN 'global' WHEN intent = 'lookup' THEN 'local' WHEN regexp_matches(lower(text), '{EXPLORE}') AND allows_explore AND has_relations THEN 'explore'
  WHEN regexp_matches(lower(text), '{OVERVIEW}') AND has_reports THEN 'global' ELSE 'local' END AS wanted FROM q, g)
SELECT conv_id, turn, wanted, CASE WHEN (wanted = 'global' AND NOT allows_global) OR (wanted = 'explore' AND NOT allows_explore) THEN 'local' ELSE wanted END AS route FROM w""")
def route_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The route of each question: mode, scope, intent, cues; local where the policy doesn't allow what was found."""
    return S.routes(table(spark, sf, "conversations").sparkSession.sql(_ASKED.replace("FROM conversations", "FROM {c}"), c=table(spark, sf, "conversations")), graph_status(spark, sf), EXPLORE, OVERVIEW).select("conv_id", "turn", "wanted", "route")


@query("route_admission", f"""
WITH q AS ({_ASKED}) SELECT conv_id, turn, mode, CASE WHEN mode = 'explore' OR mode NOT IN ('local', 'global', 'source-section', 'explore') THEN 'local' ELSE mode END AS served, CASE WHEN mode = 'explore' OR mode NOT IN ('local', 'global', 'source-section', 'explore') THEN mode END AS downgraded_from FROM q""")
def route_admission(spark: SparkSession, sf: str) -> DataFrame:
    """Routes that are served; those that are switched off or unknown become local."""
    c = table(spark, sf, "conversations")
    return S.admitted(spark.sql(_ASKED.replace("FROM conversations", "FROM {c}"), c=c).select("conv_id", "turn", "mode"), "mode", ["local", "global", "source-section", "explore"], ["explore"])


@query("search_docs_union", """
SELECT 'DOC-document-' || doc_id AS doc_id, 'document' AS family, sha256(text) AS content_hash FROM documents
UNION ALL SELECT 'DOC-page-' || page_id, 'page', sha256(html) FROM pages
UNION ALL SELECT 'DOC-turn-' || conv_id || '-' || turn, 'turn', sha256(text) FROM conversations
UNION ALL SELECT 'DOC-claim-' || item_id, 'claim', sha256(text) FROM benchmark
UNION ALL SELECT 'DOC-entity-' || p_partkey, 'entity', sha256(p_name) FROM part
UNION ALL SELECT 'DOC-report-' || r_regionkey, 'report', sha256(r_name) FROM region""")
def search_docs_union(spark: SparkSession, sf: str) -> DataFrame:
    """Six record families in one index."""
    def family(name: str, kind: str, body: str, *ids: str) -> DataFrame:
        key = F.concat_ws("-", F.lit("DOC"), F.lit(kind), *[F.col(i).cast("string") for i in ids])
        return table(spark, sf, name).select(key.alias("doc_id"), F.lit(kind).alias("family"), F.sha2(body, 256).alias("content_hash"))

    parts = [family("documents", "document", "text", "doc_id"), family("pages", "page", "html", "page_id"), family("conversations", "turn", "text", "conv_id", "turn"),
             family("benchmark", "claim", "text", "item_id"), family("part", "entity", "p_name", "p_partkey"), family("region", "report", "r_name", "r_regionkey")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("embedding_coverage", """
SELECT label, CAST(count(*) AS BIGINT) AS chunks, CAST(count(d.doc_id) FILTER (length(d.text) > 1000) AS BIGINT) AS ready
FROM embeddings LEFT JOIN documents d ON vec_id = d.doc_id GROUP BY label""")
def embedding_coverage(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), (F.length("text") > 1000).alias("current"))
    joined = table(spark, sf, "embeddings").select("vec_id", "label").join(docs, "vec_id", "left")
    return joined.groupBy("label").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("current").alias("ready"))


@query("pending_embeddings", """
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id) AND length(text) >= 40""")
def pending_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.length("text") >= 40).select("doc_id").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


EVAL = f"""{BM25}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex),
rel AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), family AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'direct' ELSE 'associative' END AS family FROM benchmark),
hard AS (SELECT query_id, min(rank) AS hard FROM r ANTI JOIN rel USING (query_id, doc_id) WHERE doc_id % 10 = 0 GROUP BY query_id),
best AS (SELECT rel.query_id, family, min(rank) AS rank, min(hard) AS hard, count(*) AS wanted, count(*) FILTER (rank <= 5) AS got FROM rel JOIN family USING (query_id) LEFT JOIN r USING (query_id, doc_id) LEFT JOIN hard USING (query_id) GROUP BY rel.query_id, family)"""


@query("eval_recall_mrr", f"""WITH {EVAL}
SELECT family, CAST(count(*) AS BIGINT) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1 ELSE 0 END), 6) AS recall_3,
  round(avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN rank <= 5 THEN 1 / rank ELSE 0 END), 6) AS mrr_5, round(avg(got / wanted), 6) AS completeness,
  CAST(count(*) FILTER (hard < rank) AS BIGINT) AS outranked FROM best GROUP BY family""")
def eval_recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """By family, whether the documents that hold an item's passage come first for its question, and before the hard negatives."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    relevant = X.holders(the_index(spark, sf), table(spark, sf, "documents").select("doc_id", "text"), items)
    hits = X.ranked(lexical(spark, sf), 1 << 30).select("query_id", "doc_id", "rank")
    hard = hits.where("doc_id % 10 = 0").join(relevant, ["query_id", "doc_id"], "left_anti").groupBy("query_id").agg(F.min("rank").alias("hard"))
    found = relevant.join(hits, ["query_id", "doc_id"], "left").withColumn("family", F.when(F.col("query_id") % 3 == 0, "direct").otherwise("associative"))
    best = found.groupBy("query_id", "family").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("wanted"), F.count_if(F.col("rank") <= 5).alias("got")).join(hard, "query_id", "left")
    at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return best.groupBy("family").agg(
        F.count(F.lit(1)).alias("queries"), at(1).alias("recall_1"), at(3).alias("recall_3"), at(5).alias("recall_5"), F.round(F.avg(F.when(F.col("rank") <= 5, 1 / F.col("rank")).otherwise(0.0)), 6).alias("mrr_5"),
        F.round(F.avg(F.col("got") / F.col("wanted")), 6).alias("completeness"), F.count_if(F.col("hard") < F.col("rank")).alias("outranked"),
    )


#: Questions with phrases, exclusions and plain terms, from the words of the test items.
_QUESTION = """SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN concat('"', w[{0}], ' ', w[{1}], '" ', w[{3}], ' ', w[{4}]) WHEN 1 THEN concat(w[{0}], ' ', w[{2}], ' the -', w[{5}]) WHEN 2 THEN concat('what is ', w[{1}], ' ', w[{2}]) ELSE concat(w[{0}], ' ', w[{1}], ' ', w[{2}], ' -', w[{4}], '.') END AS question"""
ASKED = f"""w_ AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), asked AS ({_QUESTION.format(*range(1, 7))} FROM w_)"""
_EDGE = "[.,;:!?''\"()\\[\\]{}]+"
_BARE = "list_filter(list_transform({}, lambda w: regexp_replace(regexp_replace(w, '^" + _EDGE.replace("{}", "{{}}") + "', ''), '" + _EDGE.replace("{}", "{{}}") + "$', '')), lambda w: w <> '')"
_QSTOP = "[" + ", ".join(f"'{w}'" for w in Q.STOP) + "]"
_WORDS = "list_filter(regexp_split_to_array(regexp_replace(question, '\"[^\"]+\"', ' ', 'g'), '\\s+'), lambda w: w <> '')"
PARSED = f"""{ASKED}, pw AS (SELECT query_id, question, {_WORDS} AS ws FROM asked),
pt AS (SELECT query_id, question, list_filter(list_transform(regexp_extract_all(question, '\"([^\"]+)\"', 1), lambda p: trim(p)), lambda p: p <> '') AS phrases,
  list_filter({_BARE.format("list_filter(ws, lambda w: NOT regexp_matches(w, '^-.'))")}, lambda w: regexp_matches(w, '[.\\-_/]') OR regexp_matches(w, '[^\\x00-\\x7F]') OR NOT (list_contains({_QSTOP}, lower(w)) OR (length(w) <= 2 AND NOT (regexp_matches(w, '[A-Z]') AND upper(w) = w)))) AS t0,
  {_BARE.format("list_transform(list_filter(ws, lambda w: regexp_matches(w, '^-.')), lambda w: regexp_replace(w, '^-', ''))")} AS gone FROM pw),
parsed AS (SELECT query_id, question, phrases, list_filter(t0, lambda x, i: list_position(t0, x) = i) AS terms, gone FROM pt)"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    return spark.sql(_QUESTION.format(*range(6)) + " FROM {w}", w=w)


@query("parsed_questions", f"""WITH {PARSED}
SELECT query_id, array_to_string(phrases, '|') AS phrases, array_to_string(terms, '|') AS terms, array_to_string(gone, '|') AS excluded,
  CASE WHEN regexp_matches(lower(question), 'what is|define|definition of|무엇|이란|란 ') THEN 'definition' WHEN regexp_matches(lower(question), ' vs |versus|compare|difference between|차이') THEN 'comparison' WHEN regexp_matches(lower(question), 'how to|how do|steps to|방법|어떻게') THEN 'procedure' ELSE 'default' END AS intent FROM parsed""")
def parsed_questions(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("question")
    return asked(spark, sf).select("query_id", F.array_join(Q.phrases(q), "|").alias("phrases"), F.array_join(Q.terms(q), "|").alias("terms"), F.array_join(Q.excluded(q), "|").alias("excluded"), Q.intent(q).alias("intent"))


@query("match_strings", f"""WITH {PARSED}, c AS (SELECT query_id, list_transform(phrases, lambda p: trim(regexp_replace(p, '[":()*^]', ' ', 'g'))) AS ps, list_transform(terms, lambda t: trim(regexp_replace(t, '[":()*^]', ' ', 'g'))) AS ts, list_transform(gone, lambda g: trim(regexp_replace(g, '[":()*^]', ' ', 'g'))) AS gs FROM parsed),
q AS (SELECT query_id, list_transform(list_filter(ps, lambda p: p <> ''), lambda p: '"' || p || '"') AS ps, list_transform(list_filter(ts, lambda t: t <> ''), lambda t: CASE WHEN regexp_matches(t, '[.\\-_/]') THEN '"' || t || '"*' ELSE t || '*' END) AS ts, list_transform(list_filter(gs, lambda g: g <> ''), lambda g: ' NOT "' || g || '"') AS gs FROM c)
SELECT query_id, trim(array_to_string(list_concat(ps, CASE WHEN len(ts) > 0 THEN ['(' || array_to_string(ts, ' OR ') || ')'] ELSE [] END), ' ') || array_to_string(gs, '')) AS match FROM q""")
def match_strings(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("query_id", Q.match_string(F.col("question")).alias("match"))


SEARCHED = f"""{PARSED}, {CORPUS},
units AS (SELECT query_id, unit, kind, {tokens_sql('word')} AS u FROM (
  SELECT query_id, unnest(list_concat(list_transform(phrases, lambda p, i: {{'kind': 'phrase', 'unit': i, 'word': p}}), list_transform(terms, lambda p, i: {{'kind': 'term', 'unit': 100 + i, 'word': p}}), list_transform(gone, lambda p, i: {{'kind': 'gone', 'unit': 200 + i, 'word': p}})), recursive := true) FROM parsed)),
used AS (SELECT * FROM units WHERE len(u) > 0),
one AS MATERIALIZED (SELECT query_id, unit, kind, u[1] AS w FROM used WHERE len(u) = 1), vt AS MATERIALIZED (SELECT query_id, unit, kind, term FROM one JOIN df ON df.term = w WHERE kind <> 'term' UNION ALL SELECT query_id, unit, kind, term FROM one JOIN df ON substr(df.term, 1, 2) = substr(w, 1, 2) AND starts_with(df.term, w) WHERE kind = 'term' AND length(w) > 1 UNION ALL SELECT query_id, unit, kind, term FROM one JOIN df ON substr(df.term, 1, 1) = w WHERE kind = 'term' AND length(w) = 1),
pos AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS p FROM rows_),
mu AS MATERIALIZED (SELECT query_id, unit, kind, len(u) AS n, unnest(u) AS w, generate_subscripts(u, 1) AS k FROM used WHERE len(u) > 1),
mt AS MATERIALIZED (SELECT mu.*, term FROM mu JOIN df ON term = w WHERE NOT (kind = 'term' AND k = n) UNION ALL SELECT mu.*, term FROM mu JOIN df ON starts_with(term, w) WHERE kind = 'term' AND k = n),
ms AS (SELECT query_id, unit, kind, doc_id, dl, p - k AS s FROM mt JOIN pos USING (term) GROUP BY query_id, unit, kind, doc_id, dl, p - k, n HAVING count(DISTINCT k) = n),
hits AS MATERIALIZED (SELECT query_id, unit, kind, doc_id, dl, sum(tf) AS f FROM vt JOIN tf USING (term) GROUP BY query_id, unit, kind, doc_id, dl
  UNION ALL SELECT query_id, unit, kind, doc_id, dl, count(*) FROM ms GROUP BY query_id, unit, kind, doc_id, dl),
udf AS (SELECT query_id, unit, count(*) AS df FROM hits GROUP BY query_id, unit),
per AS (SELECT query_id, doc_id, round(sum((CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score,
  count(*) FILTER (kind = 'phrase') AS ps, count(*) FILTER (kind = 'term') AS ts FROM hits JOIN udf USING (query_id, unit), stats WHERE kind <> 'gone' GROUP BY query_id, doc_id),
need AS (SELECT query_id, count(*) FILTER (kind = 'phrase') AS ps, count(*) FILTER (kind = 'term') AS ts FROM used GROUP BY query_id),
answers AS (SELECT per.query_id, doc_id, score FROM per JOIN need USING (query_id) WHERE per.ps = need.ps AND (per.ts > 0 OR need.ts = 0) AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.kind = 'gone' AND h.query_id = per.query_id AND h.doc_id = per.doc_id)),
lexed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM answers)"""


def answered(spark: SparkSession, sf: str) -> DataFrame:
    return X.lexical_hits(the_index(spark, sf), asked(spark, sf), Workspace(spark, "lexical"))


@query("search_lex", f"WITH {SEARCHED} SELECT query_id, rank, doc_id, score FROM lexed WHERE rank <= 8")
def search_lex(spark: SparkSession, sf: str) -> DataFrame:
    """Questions read with their phrases, beginnings and exclusions, answered by the index."""
    return X.ranked(answered(spark, sf), 8)


@query("search_vec", f"""WITH u AS (SELECT vec_id, {_UNIT} AS v FROM embeddings), qv AS (SELECT item_id AS query_id, v AS qv FROM benchmark JOIN u ON vec_id = item_id),
sims AS (SELECT query_id, vec_id AS doc_id, round(list_sum(list_transform(list_zip(v, qv), lambda p: p[1] * p[2])), 6) AS score FROM u, qv)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sims) WHERE rank <= 8""")
def search_vec(spark: SparkSession, sf: str) -> DataFrame:
    return vector_hits(spark, sf, 8)


HYBRID = f"""{SEARCHED}, u AS (SELECT vec_id, {_UNIT} AS v FROM embeddings), qv AS (SELECT item_id AS query_id, v AS qv FROM benchmark JOIN u ON vec_id = item_id WHERE item_id % 6 <> 5),
sims AS (SELECT query_id, vec_id AS doc_id, round(list_sum(list_transform(list_zip(v, qv), lambda p: p[1] * p[2])), 6) AS score FROM u, qv),
l2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sims),
lists AS (SELECT query_id, 'lex_raw' AS list, doc_id, rank FROM lexed WHERE rank <= 100 UNION ALL SELECT query_id, 'vec_raw', doc_id, rank FROM l2 WHERE rank <= 100),
fused AS (SELECT query_id, doc_id, round(sum(CASE list WHEN 'lex_raw' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END / (60 + rank) + CASE WHEN rank = 1 THEN 0.5::DOUBLE / 61 ELSE 0::DOUBLE END), 6) AS score FROM lists GROUP BY query_id, doc_id),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 40),
st AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'unchecked' END AS status FROM labels),
dem AS (SELECT query_id, doc_id, round(score * CASE coalesce(status, '') WHEN 'verified' THEN 1.0::DOUBLE WHEN 'unchecked' THEN 0.85::DOUBLE WHEN 'failed' THEN 0.70::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM ranked LEFT JOIN st USING (doc_id)),
mm AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS m FROM dem WINDOW w AS (PARTITION BY query_id)),
ft AS (SELECT query_id, {tokens_sql("array_to_string(terms, ' ')")} AS ts FROM parsed),
ce AS (SELECT mm.query_id, mm.doc_id, m, len(list_intersect(ts, {tokens_sql('text')})) / greatest(len(list_distinct(ts)), 1) AS c, text FROM mm JOIN documents USING (doc_id) JOIN ft USING (query_id)),
final AS (SELECT query_id, doc_id, round(0.7 * c + 0.3 * m, 6) AS score, text FROM ce),
top8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM final) WHERE rank <= 8)"""


def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, rank, doc_id, score, mode, text of the eight best answers of each question; some questions have no vector."""
    lex = X.ranked(answered(spark, sf), S.LIST_CAP)
    vec = vector_hits(spark, sf).where("query_id % 6 <> 5")
    q = asked(spark, sf).select("query_id", F.array_distinct(T.index_tokens(F.array_join(Q.terms(F.col("question")), " "))).alias("terms"))
    return S.hybrid(lex, vec, q, statuses(spark, sf), table(spark, sf, "documents").select("doc_id", "text"), Workspace(spark, "hybrid"))


@query("search_hybrid", f"""WITH {HYBRID}
SELECT query_id, rank, doc_id, score, CASE WHEN query_id IN (SELECT query_id FROM qv) THEN '' ELSE 'lex' END AS fallback_mode, substr(text, 1, 280) AS snippet FROM top8""")
def search_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search: both lists, fusion, demotion, reranking, snippets; without a vector the words alone decide."""
    return hybrid(spark, sf).select("query_id", "rank", "doc_id", "score", "fallback_mode", F.substring("text", 1, 280).alias("snippet"))


@query("query_traces", f"""WITH {HYBRID}
SELECT query_id, sha256(question) AS question_hash, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS evidence, CAST(count(*) AS BIGINT) AS hits FROM top8 JOIN parsed USING (query_id) GROUP BY query_id, question""")
def query_traces(spark: SparkSession, sf: str) -> DataFrame:
    """What a search leaves behind: the question's hash and the evidence in its order."""
    listed_ = F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string"))
    rows = hybrid(spark, sf).groupBy("query_id").agg(F.array_join(listed_, ",").alias("evidence"), F.count(F.lit(1)).alias("hits"))
    return rows.join(asked(spark, sf), "query_id").select("query_id", F.sha2("question", 256).alias("question_hash"), "evidence", "hits")
