"""URL filtering: a blocked Bloom filter passes possible hits to an exact hash join.

A list holds entries: rules (a host with all its subdomains, and a beginning of
the path) and canonical URLs. A URL is asked for under every expression that an
entry could have: each end of its host with each beginning of its path whose
length some rule has, and its own canonical form. Expressions are hashed; a hash
names one block of the filter and a bit in each of the block's eight words, so that one look-up
decides. Few expressions pass, and only they are joined with the list itself,
which removes what passed by chance. The longest rule decides, then the list of
URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import labelled
from sparkloom.storage import Workspace

#: Bits of the filter for each entry, and blocks of 256 bits that it has at most (32 MB, broadcast); more entries only let more pass by chance.
BITS_EACH, MOST_BLOCKS, WORDS = 16, 1 << 20, 8
#: Entries up to which the list is broadcast to the exact join.
BROADCAST_ENTRIES = 100_000

#: The rules of the query, with what they say.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path; both empty for null and where no ``://`` is."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """One form for the URLs of a page: no ``www.``, port 80 or 443, final dot, index page, ``.html`` or slash at the end."""
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.|\.?(:(80|443))?$", ""), r"\.$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?$", ""), r"/+$", "")
    return F.concat(host, F.when(path == "", "/").otherwise(path))


def entries(rules: DataFrame, listed: DataFrame) -> DataFrame:
    """kind (r, u), entry, verdict: rules (host, path, verdict) and listed URLs (url), each once; of equal rules that differ, block."""
    host = F.regexp_replace(lower_ascii(F.col("host")), r"^\.|\.$", "")
    of_rules = rules.where("host is not null and path is not null").select(F.lit("r").alias("kind"), F.concat(host, "path").alias("entry"), host.alias("host"), F.col("path").alias("path"), "verdict")
    h, p = host_and_path(F.col("url"))
    of_urls = listed.select(h.alias("host"), p.alias("path")).where("host <> ''").select(F.lit("u").alias("kind"), canonical(F.col("host"), F.col("path")).alias("entry"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit("block").alias("verdict"))
    found = of_rules.unionByName(of_urls)
    return found.groupBy("kind", "entry").agg(F.max("verdict").alias("verdict"), F.max(F.length("path")).alias("path_length"))


def bit(h: Column, word: int) -> Column:
    """The bit of a word that a hash sets: five bits of the hash for each word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 5 * word).bitwiseAND(F.lit(31).cast("long")).cast("int"))


def block_of(h: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(blocks))


def blocked_filter(hashes: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The filter of ``n`` hashes (column h): a row for each block with a bit set, two words of 32 bits in each long."""
    blocks = max(1, min(MOST_BLOCKS, n * BITS_EACH // (32 * WORDS)))
    words = [F.bit_or(bit(F.col("h"), 2 * i).bitwiseOR(F.shiftleft(bit(F.col("h"), 2 * i + 1), 32))).alias(f"w{i}") for i in range(WORDS // 2)]
    return hashes.groupBy(block_of(F.col("h"), blocks).alias("block")).agg(*words), blocks


def passes(h: Column) -> Column:
    """Whether all bits of a hash are set in the words of its block."""
    out = F.lit(True)
    for i in range(WORDS // 2):
        mask = bit(h, 2 * i).bitwiseOR(F.shiftleft(bit(h, 2 * i + 1), 32))
        out = out & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    return out


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """All (kind, entry) that an entry for the URL could have; none without a host."""
    parts = F.split(host, r"\.")
    # The whole host, and what follows each of its dots.
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    rules = F.flatten(F.transform(ends, lambda h: F.transform(starts, lambda p: F.struct(F.lit("r").alias("kind"), F.concat(h, p).alias("entry"), F.length(h).alias("host_length")))))
    own = F.array(F.struct(F.lit("u").alias("kind"), canonical(host, path).alias("entry"), F.length(host).alias("host_length")))
    return F.when(host != "", F.concat(own, rules)).otherwise(F.slice(own, 1, 0))


def judged_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The id, host, path, rule and verdict of every row of ``pages`` (an id and url).

    ``rules`` has host, path and verdict (allow or block), ``listed`` has url.
    The rule is the longest that fits (of equally long ones that with the longer
    host), written as host and path, else null; its verdict counts, else block
    for URLs whose canonical form is listed, else allow. A null url or one
    without ``://`` has an empty host and path, no rule, and is allowed. Repeated
    rows stay as many as they are; other columns don't matter. Null rules and
    URLs in the lists are left out; empty lists allow all.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "urls")
    known = work.put(entries(rules, listed), "entries")
    n = known.count()
    lengths = sorted(r[0] for r in known.where("kind = 'r'").select("path_length").distinct().collect())
    hashed = lambda df: df.withColumn("h", F.xxhash64("kind", "entry"))
    sieve, blocks = blocked_filter(hashed(known), n)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    row = ["page_id", "host", "path"]
    asked = hashed(rows.select(*row, F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("e")).select(*row, "e.*"))
    # Proven bound: the filter has MOST_BLOCKS rows of five longs at most.
    possible = asked.withColumn("block", block_of(F.col("h"), blocks)).join(F.broadcast(sieve), "block").where(passes(F.col("h"))).select(*row, "kind", "entry", "host_length")
    list_ = known.select("kind", "entry", "verdict")
    if n <= BROADCAST_ENTRIES:
        hits = possible.join(F.broadcast(list_), ["kind", "entry"])
    else:
        key = F.concat("kind", F.lit(" "), "entry")
        possible = work.put(possible.withColumn("key", key), "possible")
        members = possible.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
        hits = labelled(possible, list_.select(key.alias("key"), "verdict").join(members, "key"), "key", "members").drop("key")
    # Each row comes once as itself, which counts it, and once for each hit; copies are added up before the shuffle.
    rule = F.when(F.col("kind") == "r", F.struct(F.length("entry").alias("length"), "host_length", F.col("entry").alias("rule"), F.col("verdict").alias("said")))
    none = F.lit(None)
    itself = rows.select(*row, none.cast("struct<length:int,host_length:int,rule:string,said:string>").alias("best"), F.lit(False).alias("listed"), F.lit(1).cast("long").alias("times"))
    found = itself.unionByName(hits.select(*row, rule.alias("best"), (F.col("kind") == "u").alias("listed"), F.lit(0).cast("long").alias("times")))
    found = found.groupBy(*row).agg(F.max("best").alias("best"), F.max("listed").alias("listed"), F.sum("times").alias("times"))
    verdict = F.coalesce("best.said", F.when(F.col("listed"), "block").otherwise("allow"))
    out = found.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(F.col("page_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def listed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs to block: those of pages whose document, named by the number at the end of the path, is labelled toxic."""
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", F.expr("try_cast(regexp_extract(url, '://[^/?#]*/(?:[^/?#]*/)*([0-9]+)', 1) as long)").alias("doc_id"))
    return pages.join(toxic, "doc_id", "left_semi").select("url")


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judged_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, listed_pages(spark, sf_dir))


URLS_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, url FROM pages),
q AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(host, '^www\.|\.?(:(80|443))?$', '', 'g'), '\.$', '') || CASE WHEN short = '' THEN '/' ELSE short END AS canonical FROM (SELECT *, regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') AS short FROM q)),
listed AS (SELECT DISTINCT canonical FROM c WHERE host <> '' AND TRY_CAST(regexp_extract(url, '://[^/?#]*/(?:[^/?#]*/)*([0-9]+)', 1) AS BIGINT) IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rules(h, p, said) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged AS (SELECT page_id, host, path, canonical, (SELECT max({'n': length(h || p), 'rule': h || p, 'said': said}) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM c)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.said, CASE WHEN host <> '' AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"""
