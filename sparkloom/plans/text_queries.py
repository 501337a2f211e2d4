"""Queries over text: normalisation, sections, spans, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import chunking
from sparkloom.operators import spans as S
from sparkloom.plans.tables import table
from sparkloom.registry import query

NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\r\n?', chr(10), 'g'), '(?s)%%.*?%%', '', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"""


@query("normalize_text_hash", f"""
WITH n AS (SELECT doc_id, {NORMAL} AS t FROM documents)
SELECT doc_id, sha256(t) AS content_hash, substr(sha256(t), 1, 16) AS short_hash,
  CAST(len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) AS BIGINT) AS n_words,
  len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) < 10 AS is_empty FROM n""")
def normalize_text_hash(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", T.normalize(F.col("text")).alias("t"))
    return t.select("doc_id", T.content_hash(F.col("t")).alias("content_hash"), T.short_hash(F.col("t")).alias("short_hash"), T.word_count(F.col("t")).alias("n_words"), (T.word_count(F.col("t")) < 10).alias("is_empty"))


_HTML = "html"
_HTML = f"regexp_replace({_HTML}, '(?is)<!--.*?-->', '', 'g')"
for _tag in ("script", "style", "nav", "footer", "aside", "form", "noscript", "head"):
    _HTML = f"regexp_replace({_HTML}, '(?is)<{_tag}[ >].*?</{_tag}>', '', 'g')"
for _level in range(1, 7):
    _HTML = f"regexp_replace({_HTML}, '(?i)<h{_level}[^>]*>', chr(10) || '{'#' * _level} ', 'g')"
_HTML = f"regexp_replace({_HTML}, '(?i)</(p|div|li|h[1-6]|article|section|ul|ol|table|tr)>|<(br|p|li|div)[^>]*>', chr(10), 'g')"
_HTML = f"regexp_replace({_HTML}, '<[^>]*>', ' ', 'g')"
for _entity, _sign in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
    _HTML = f"replace({_HTML}, '{_entity}', {_sign})"
HTML_TEXT = f"regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"


@query("html_strip_text", f"""
SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, {HTML_TEXT} AS body FROM pages""")
def html_strip_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"), T.strip_html(F.col("html")).alias("body"))


@query("md_sections", f"""
WITH b AS (SELECT page_id, {HTML_TEXT} AS body FROM pages),
m AS (SELECT page_id, body, string_split(regexp_replace(chr(10) || body, '\\n(#{{1,6}}) +([^\\n]+)', chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g'), chr(1)) AS parts FROM b),
s AS (SELECT page_id, unnest(parts[2:]) AS p, generate_subscripts(parts[2:], 1) AS pos FROM m WHERE len(parts) > 1
  UNION ALL SELECT page_id, '#' || chr(2) || chr(3) || body, 1 FROM m WHERE len(parts) = 1)
SELECT page_id, CAST(pos AS BIGINT) AS pos, CAST(len(split_part(p, chr(2), 1)) AS BIGINT) AS level,
  substr(trim(split_part(split_part(p, chr(3), 1), chr(2), 2)), 1, 120) AS title,
  CASE WHEN split_part(split_part(p, chr(3), 1), chr(2), 2) = '' THEN split_part(p, chr(3), 2) ELSE regexp_replace(split_part(p, chr(3), 2), '^[ \\n]+|[ \\n]+$', '', 'g') END AS text FROM s""")
def md_sections(spark: SparkSession, sf: str) -> DataFrame:
    return S.sections(table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("body")), "page_id", "body")


_PARAGRAPHS = """p AS (SELECT doc_id AS source_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents),
r AS (SELECT source_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS pos FROM p),
spans AS (SELECT source_id, substr(sha256(text), 1, 16) AS span_hash, CAST(min(pos) AS BIGINT) AS pos, arg_min(text, pos) AS text FROM r GROUP BY ALL)"""
_PARAGRAPHS = _PARAGRAPHS.replace("GROUP BY ALL", "GROUP BY source_id, substr(sha256(text), 1, 16)")


def document_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Each line of a document is a paragraph of its own."""
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return S.prose_spans(docs, "doc_id", "text")


@query("span_preview_dedup", f"""
WITH {_PARAGRAPHS} SELECT source_id, span_hash, pos, substr(regexp_replace(trim(text), '\\s+', ' ', 'g'), 1, 200) AS preview FROM spans""")
def span_preview_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return document_spans(spark, sf).select("source_id", "span_hash", "pos", T.preview(F.col("text")).alias("preview"))


@query("char_windows", """
WITH s AS (SELECT doc_id, text, range(0, greatest(0, length(text) - 250 - 1) + 1, 2750) AS starts FROM documents),
e AS (SELECT doc_id, text, unnest(starts) AS start, generate_subscripts(starts, 1) - 1 AS chunk FROM s)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(start AS BIGINT) AS start, sha256(substr(text, CAST(start AS INT) + 1, 3000)) AS hash FROM e""")
def char_windows(spark: SparkSession, sf: str) -> DataFrame:
    return S.windows(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 3000, 250).select("doc_id", "chunk", "start", F.sha2("text", 256).alias("hash"))


@query("sentence_split", """
WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), '\\n{2,}', chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS parts FROM documents)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_sentences, sha256(array_to_string(parts, '|')) AS hash FROM s""".replace("\\\\", "\\"))
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.filter(F.split("text", r"(?<=[.!?。！？])\s+|\n{2,}"), lambda x: F.trim(x) != "")
    return table(spark, sf, "documents").select("doc_id", F.size(parts).cast("long").alias("n_sentences"), F.sha2(F.array_join(parts, "|"), 256).alias("hash"))


@query("search_chunks", """
WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), '\\n{2,}', chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS parts FROM documents),
t AS (SELECT doc_id, parts, len(parts) AS n, list_transform(parts, lambda x: greatest(1, length(x) // 4)) AS sizes FROM s WHERE len(parts) > 0),
c AS (SELECT doc_id, parts, n, list_concat([0], list_transform(range(1, n + 1), lambda i: CAST(list_sum(sizes[1:i]) AS BIGINT))) AS total FROM t),
f AS (SELECT doc_id, n, total, 0 AS i, 0 AS first, 0 AS chunk, CAST(NULL AS INTEGER) AS a1, CAST(NULL AS INTEGER) AS b1, CAST(NULL AS INTEGER) AS a2, CAST(NULL AS INTEGER) AS b2 FROM c
  UNION ALL SELECT doc_id, n, total, i + 1, CASE WHEN full2 THEN least(i, greatest(f1, len(list_filter(total, lambda x: x < total[i + 2] - 48)))) ELSE f1 END, chunk + full1::INT + full2::INT, CASE WHEN full1 THEN first END, CASE WHEN full1 THEN i - 1 END, CASE WHEN full2 THEN f1 END, CASE WHEN full2 THEN i END FROM (
    SELECT *, total[i + 2] - total[f1 + 1] >= 256 AS full2 FROM (SELECT *, i > first AND total[i + 2] - total[first + 1] > 384 AS full1, CASE WHEN i > first AND total[i + 2] - total[first + 1] > 384 THEN least(i - 1, greatest(first, len(list_filter(total, lambda x: x < total[i + 1] - 48)))) ELSE first END AS f1 FROM f WHERE i < n))),
k AS (SELECT doc_id, chunk - (a2 IS NOT NULL)::INT - 1 AS chunk, a1 AS a, b1 AS b FROM f WHERE a1 IS NOT NULL UNION ALL SELECT doc_id, chunk - 1, a2, b2 FROM f WHERE a2 IS NOT NULL),
l AS (SELECT doc_id, n, chunk, first, total[n + 1] - total[first + 1] AS own FROM f WHERE i = n),
r AS (SELECT k.doc_id, k.chunk, a, CASE WHEN l.own < 32 AND k.chunk = l.chunk - 1 THEN l.n - 1 ELSE b END AS b FROM k JOIN l USING (doc_id) UNION ALL SELECT doc_id, chunk, first, n - 1 FROM l WHERE NOT (chunk > 0 AND own < 32))
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(b - a + 1 AS BIGINT) AS sentences, sha256(array_to_string(parts[a + 1:b + 1], '|')) AS hash FROM r JOIN c USING (doc_id)""".replace("\\\\", "\\"))
def search_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The windows of sentences that a search index takes from each document."""
    parts = F.filter(F.split("text", r"(?<=[.!?。！？])\s+|\n{2,}"), lambda x: F.trim(x) != "")
    rows = chunking.chunks(table(spark, sf, "documents"), "doc_id", "text")
    return rows.select("doc_id", "chunk", F.size(parts).cast("long").alias("sentences"), F.sha2(F.array_join(parts, "|"), 256).alias("hash"))


@query("token_estimates", """
SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS chunk_tokens,
  CAST(greatest(1, ceil(length(text) / 4), ceil(strlen(text) / 3)) AS BIGINT) AS budget_tokens,
  round(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / greatest(length(text), 1), 6) AS ascii_share,
  length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / greatest(length(text), 1) > 0.85 AS probably_english FROM documents""")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.chunk_tokens(t).alias("chunk_tokens"), T.budget_tokens(t).alias("budget_tokens"), F.round(T.ascii_share(t), 6).alias("ascii_share"), (T.ascii_share(t) > 0.85).alias("probably_english"))


_SHARE = "CASE WHEN length({0}) > 0 THEN (length({0}) - length(regexp_replace({0}, '%s', '', 'g'))) / length({0}) ELSE %s END"
_WORDS_OF = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}''\-]*')"
_MEAN = f"CASE WHEN len({_WORDS_OF}) > 0 THEN length(array_to_string({_WORDS_OF}, '')) / len({_WORDS_OF}) ELSE 0 END"
_BROKEN = _SHARE % (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{{FFFD}}]", "1")
_BLANK = _SHARE % (r"[\s\x0b]", "1")
#: The quality of a text, for ``format``.
QUALITY = f"""greatest(0, least(1, least(0.25, length(regexp_replace({{0}}, '[\\s\\x0b]', '', 'g')) / 1200) + least(0.3, len({_WORDS_OF}) / 240) + least(0.15, len(list_filter(string_split({{0}}, chr(10)), lambda l: trim(l) <> '')) / 30)
  + least(0.2, ({_SHARE % (chr(92) + 'p{{L}}', '0')} + {_SHARE % (chr(92) + 'p{{N}}', '0')}) * 0.25) + least(0.1, ({_MEAN}) / 60) - least(0.35, ({_BROKEN}) * 3)
  - CASE WHEN ({_BLANK}) > 0.45 THEN least(0.2, (({_BLANK}) - 0.45) * 0.8) ELSE 0 END - CASE WHEN len({_WORDS_OF}) > 0 AND ({_MEAN}) < 2.2 THEN 0.15 ELSE 0 END))"""


@query("text_quality_score", f"SELECT doc_id, round({QUALITY.format('text')}, 6) AS quality FROM documents")
def text_quality_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(T.text_quality(F.col("text")), 6).alias("quality"))


#: Documents with the links and marks of notes after their words.
_NOTES = """SELECT doc_id AS note_id, concat(text, ' See ![[plot', doc_id % 7, '.png', CASE WHEN doc_id % 2 = 0 THEN '|200' ELSE '' END, ']] and ![a](img/', doc_id % 3, '.svg) ![x](img/1.svg) [[Home#Top|top]] [[#Rank fusion|above]] [[#Below]] [[', source, ']] [[Home]]',
  CASE WHEN doc_id % 5 = 0 THEN concat(' picture [', doc_id, ' x 480] intentionally omitted') WHEN doc_id % 7 = 0 THEN ' Picture intentionally omitted' ELSE '' END) AS text FROM {}"""
_NOTES_SQL = "(" + _NOTES.format("documents") + ")"


def notes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_NOTES.format("{d}"), d=table(spark, sf, "documents"))


@query("note_links", f"""
SELECT note_id, array_to_string(list_distinct_ordered, ',') AS images, plain, links FROM (
SELECT note_id,
  list_filter(im, lambda x, i: list_position(im, x) = i) AS list_distinct_ordered,
  regexp_replace(regexp_replace(text, '\\[\\[#[^\\]|]+\\|([^\\]]+)\\]\\]', '\\1', 'g'), '\\[\\[#([^\\]|]+)\\]\\]', '\\1', 'g') AS plain,
  array_to_string(list_filter(wl, lambda x, i: list_position(wl, x) = i), ',') AS links
FROM (SELECT note_id, text, list_concat(regexp_extract_all(text, '!\\[\\[([^\\]|#]+?\\.(?:png|jpe?g|gif|webp|svg))(?:\\|[^\\]]*)?\\]\\]', 1), regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)\\s]+)\\)', 1)) AS im,
  list_transform(regexp_extract_all(text, '\\[\\[([^\\]|#]+)', 1), lambda x: trim(x)) AS wl FROM {_NOTES_SQL}))""")
def note_links(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return notes(spark, sf).select("note_id", F.array_join(T.image_links(t), ",").alias("images"), T.plain_links(t).alias("plain"), F.array_join(T.wikilinks(t), ",").alias("links"))


@query("lost_pictures", f"""
SELECT note_id, regexp_extract(text, '(?i)picture(?: \\[(\\d+) ?x ?(\\d+)\\])? intentionally omitted', 0) <> '' AS lost,
  TRY_CAST(regexp_extract(text, '(?i)picture(?: \\[(\\d+) ?x ?(\\d+)\\])? intentionally omitted', 1) AS INT) AS width,
  TRY_CAST(regexp_extract(text, '(?i)picture(?: \\[(\\d+) ?x ?(\\d+)\\])? intentionally omitted', 2) AS INT) AS height FROM {_NOTES_SQL}""")
def lost_pictures(spark: SparkSession, sf: str) -> DataFrame:
    found = T.lost_picture(F.col("text"))
    return notes(spark, sf).select("note_id", found.isNotNull().alias("lost"), found["width"].alias("width"), found["height"].alias("height"))


@query("span_hydration", f"""
WITH {_PARAGRAPHS}, now AS (SELECT source_id, span_hash, text FROM spans WHERE source_id % 7 <> 0)
SELECT s.source_id, s.span_hash, n.span_hash IS NULL AS stale, CAST(coalesce(length(n.text), 0) AS BIGINT) AS hydrated_chars
FROM spans s LEFT JOIN now n ON s.source_id = n.source_id AND s.span_hash = n.span_hash""")
def span_hydration(spark: SparkSession, sf: str) -> DataFrame:
    """Spans joined with a later parse of their sources, of which every seventh has vanished."""
    spans = document_spans(spark, sf)
    now = spans.where("source_id % 7 <> 0").select("source_id", "span_hash", F.col("text").alias("full_text"))
    joined = spans.join(now, ["source_id", "span_hash"], "left")
    return joined.select("source_id", "span_hash", F.col("full_text").isNull().alias("stale"), F.coalesce(F.length("full_text"), F.lit(0)).cast("long").alias("hydrated_chars"))


@query("script_language", """
SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{AC00}-\\x{D7AF}\\x{1100}-\\x{11FF}]') THEN 'Korean' WHEN regexp_matches(text, '[\\x{3040}-\\x{30FF}]') THEN 'Japanese'
  WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'Chinese' WHEN regexp_matches(text, '[\\x{0400}-\\x{04FF}]') THEN 'Russian' WHEN regexp_matches(text, '[\\x{0370}-\\x{03FF}]') THEN 'Greek'
  WHEN regexp_matches(text, '[\\x{0600}-\\x{06FF}]') THEN 'Arabic' WHEN regexp_matches(text, '[\\x{0590}-\\x{05FF}]') THEN 'Hebrew' WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'Hindi'
  WHEN regexp_matches(text, '[\\x{0E00}-\\x{0E7F}]') THEN 'Thai' ELSE 'English' END AS language FROM documents""")
def script_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.script_language(F.col("text")).alias("language"))
