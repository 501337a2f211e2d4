"""Ranked search, rolling users and URL filters against brute force, with odd rows in every table."""

import datetime
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sparkloom.llm import queries, ranked, rolling, urls

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def same_as_sql(df, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = df.toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tidy = lambda x: sorted(map(tuple, x[columns].astype(object).where(x[columns].notna(), None).values.tolist()), key=str)
    assert tidy(got) == tidy(want)


@pytest.mark.parametrize("name, tables", [("op11_ranked", ["documents", "benchmark"]), ("op12_rolling", ["clicks"]), ("op13_urls", ["pages", "labels"])])
def test_query_equals_its_sql(spark, name, tables):
    same_as_sql(queries.QUERIES[name](spark, SF), name, tables)


# 11. Ranked search


def brute(docs, items, k):
    """docs and items are (id, text); the result is a set of (item_id, rank, doc_id, score)."""
    words = [TERM.findall(lower(t or "")) for _, t in docs]
    n, length = sum(map(bool, words)), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = []
    for item, text in {(i, t) for i, t in items}:
        found = []
        for (doc, _), w in zip(docs, words):
            tf, m = Counter(w), 25 + 75 * len(w) * n // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in TERM.findall(lower(text or "")))
            if s > 0:
                found.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return Counter(out)


def corpus(rng, n):
    words = ["alpha", "Beta", "gamma", "délta", "ε", "zeta9", "THE", "of", "License", "x", "日本"] + [f"w{i}" for i in range(40)]
    some = [" ".join(rng.choice(words[: rng.randrange(3, len(words))]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    return [None, "", " \n\t-", "one", some[0], some[0], " ".join(rng.choice(words) for _ in range(20_000)), *some, "a" * 500, "\x7fodd\x00white;space"]


def test_ranks_equal_brute_force(spark):
    rng = random.Random(11)
    docs = [(i, t) for i, t in enumerate(corpus(rng, 300))] + [(7, "alpha beta"), (7, "alpha beta"), (None, "alpha beta"), (None, None), (-3, "alpha beta")]
    items = [(1, "Alpha beta gamma alpha"), (2, "日本 of of w3 w7"), (3, "nowhere"), (4, ""), (5, None), (None, "License, x!"), (6, "zeta9"), (6, "zeta9"), (6, "délta ε"), (8, " ".join(f"w{i}" for i in range(40)))]
    d = spark.createDataFrame([(*r, 0, "x") for r in docs], "doc_id long, text string, score int, item_id string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    for k, block in ((10, ranked.BLOCK_TERMS), (3, 9)):
        got = ranked.ranked_documents(d, q, k, block).collect()
        assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == brute(docs, items, k)


def test_ranks_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "doc_id long, text string")
    ask = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.ranked_documents(none, ask).count() == 0
    assert ranked.ranked_documents(some, ask.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ranked.ranked_documents(some, ask, 0)


def segment(rng, docs, terms):
    texts = [" ".join(f"t{int(min(terms - 1, rng.expovariate(0.15)))}" for _ in range(rng.randrange(1, 30))).encode() for _ in range(docs)]
    known = {f"t{i}".encode(): i for i in range(terms)}
    (s,) = ranked.segments_of(iter([pa.record_batch([pa.array(range(docs)), pa.array(texts)], ["doc_id", "text"])]), known)
    row = {c: s.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("docs", "sizes", "terms", "ends", "at", "tf")}
    return ranked.Segment(row, s.column("n_docs")[0].as_py(), s.column("n_terms")[0].as_py()), row


def test_treaps_are_trees_by_document_and_heaps_by_impact():
    s, row = segment(random.Random(3), 400, 30)
    t = s.treaps
    seen = []

    def walk(x, lo, hi, most):
        if x == len(t.doc) - 1:
            return 0
        assert lo <= t.doc[x] < hi and t.impact[x] <= most
        seen.append(x)
        return 1 + max(walk(t.left[x], lo, t.doc[x], t.impact[x]), walk(t.right[x], t.doc[x] + 1, hi, t.impact[x]))

    depth = max(walk(r, 0, 400, 1 << 60) for r in t.roots)
    assert sorted(seen) == list(range(len(row["at"]))) and depth < 40


def test_search_finds_the_best_and_leaves_subtrees_out(monkeypatch):
    rng = random.Random(5)
    s, _ = segment(rng, 3000, 60)
    scored = [0]
    plain = ranked.Segment.scores

    def counted(self, doc, *rest):
        scored[0] += len(doc)
        return plain(self, doc, *rest)

    monkeypatch.setattr(ranked.Segment, "scores", counted)
    terms = np.array([[*rng.sample(range(30, 60), 4), -1] for _ in range(20)])
    terms[0] = -1
    weights = np.where(terms >= 0, np.array([[rng.randrange(1, 9000) for _ in range(5)] for _ in range(20)]), 0)
    search, doc, score = s.best(ranked.Searches(terms, weights), 5)
    assert scored[0] < 20 * 3000 / 2
    for i in range(20):
        w = defaultdict(int, zip(terms[i].tolist(), weights[i].tolist()))
        total = np.zeros(3000, np.int64)
        for p in range(len(s.at)):
            total[s.at[p]] += w[int(s.terms[s.term[p]])] * s.impact[p]
        want = sorted(((-v, d) for d, v in enumerate(total.tolist()) if v > 0))[:5]
        assert [(-v, d) for v, d in zip(score[search == i].tolist(), doc[search == i].tolist())] == want


# 12. Rolling users


def rolled(rows, w):
    """Counts for rows (kind, minute, user) of different clicks."""
    out = {}
    for kind, minute in {(k, m) for k, m, _ in rows}:
        inside = lambda n: [u for k, m, u in rows if k == kind and minute - n < m <= minute and u is not None]  # noqa: E731, B023
        out[kind, minute] = (*(len(set(inside(n))) for n in (w.short, w.middle, w.long)), sum(c >= w.hot for c in Counter(inside(w.long)).values()))
    return out


@pytest.mark.parametrize("seed, block, shard_rows", [(1, 60, 7), (2, 41, 10_000), (3, 500, 1)])
def test_rolling_users_equal_brute_force(spark, seed, block, shard_rows):
    rng, w = random.Random(seed), rolling.Windows(3, 10, 41, 3)
    zero = datetime.datetime(1969, 12, 31, 22, 50)
    one = lambda i: (i, zero + datetime.timedelta(microseconds=rng.randrange(300 * 60_000_000)), rng.choice([None, 1, 1, 1, -5, 2**40, *range(9)]), rng.choice("abb"))
    clicks = [one(i) for i in range(400)]
    odd = [(900, None, 1, "a"), (901, zero, 1, None), (902, zero, None, "only"), (None, zero, 4, "b"), (None, zero, 4, "b"), (903, zero + datetime.timedelta(hours=3), 2, "b"), (903, zero + datetime.timedelta(hours=2), 3, "a")]
    rows = [*clicks, *clicks[:50], *odd]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "click_id long, ts timestamp_ntz, client_id long, kind string, minute string, block int")
    got = {(r["kind"], r["minute"]): tuple(r[c] for c in rolling.COUNTS) for r in rolling.rolling_users(df, w, block, shard_rows).collect()}
    minute = lambda ts: (ts - datetime.datetime(1970, 1, 1)) // datetime.timedelta(minutes=1)
    kept = [(k, minute(t), u) for _, t, u, k in [*clicks, *odd[2:5], odd[6]]]
    assert got == rolled(kept, w)


def test_times_are_utc_in_any_session(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("select 1L as click_id, timestamp_ntz'1970-01-02 00:03:59.9' as ts, 5L as client_id, 'k' as kind")
        assert rolling.rolling_users(df).first()["minute"] == 1443
        assert rolling.rolling_users(df.withColumn("ts", df["ts"].cast("timestamp"))).first()["minute"] == 1443 + 300
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_rolling_users_of_nothing(spark):
    df = spark.createDataFrame([], "click_id long, ts timestamp_ntz, client_id long, kind string")
    assert rolling.rolling_users(df).count() == 0
    with pytest.raises(ValueError):
        rolling.rolling_users(df, block=719)
    with pytest.raises(ValueError):
        rolling.Windows(10, 5, 720)


@pytest.mark.parametrize("windows", [rolling.Windows(1, 1, 1, 1), rolling.Windows(2, 7, 23, 5), rolling.Windows(5, 64, 64, 2)])
def test_queues_of_two_stacks(windows):
    rng = np.random.default_rng(4)
    for _ in range(30):
        n, rows = rng.integers(1, 150), rng.integers(1, 200)
        pairs = np.unique(np.stack([rng.integers(0, n, rows), rng.integers(0, 150, rows)]), axis=1)
        clicks = rng.integers(1, 4, pairs.shape[1])
        got = rolling.window_counts(*pairs, clicks, n, windows)
        for t in range(n):
            inside = lambda k: (pairs[0] <= t) & (pairs[0] > t - k)  # noqa: E731, B023
            assert got[t, :3].tolist() == [len(set(pairs[1][inside(k)])) for k in (windows.short, windows.middle, windows.long)]
            assert got[t, 3] == (np.bincount(pairs[1][inside(windows.long)], clicks[inside(windows.long)], 1) >= windows.hot).sum()


# 13. URLs


def canonical(host, path):
    host = re.sub(r"\.$", "", re.sub(r"^www\.|\.?(:(80|443))?$", "", host))
    return host + (re.sub(r"/+$", "", re.sub(r"(/index)?\.html?$", "", path)) or "/")


def judged(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = lower(host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits and host else None
    return host, path, best and best[2], best[3] if best else "block" if host and canonical(host, path) in listed else "allow"


URLS = [None, "", "no scheme", "http://", "://", "HTTP://A.Net", "http://a.net/", "http://net/x", "http://anet/x", "https://www.Example.NET/en/1?q#f", "x://example.com/de/", "http://EXAMPLE.com/de", "ftp://org/fr/é",
        "http://m.b.org/fr/2#://z", "http://shop.test/a/index.html", "http://www.shop.test:80/a/", "http://shop.test/a?x=1", "http://shop.test/b", "http://ÄB.net/", "http://a..net//", "http://" + "x." * 50 + "net/" + "y" * 50_000]


@pytest.fixture
def pages(spark):
    rng = random.Random(13)
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['a', 'b', 'example'])}.{rng.choice(['net', 'org', 'com', 'co.uk'])}/{rng.choice(['en', 'de', 'fr', ''])}/{rng.randrange(20)}{rng.choice(['', '/', '.html', '?q', '#x'])}" for _ in range(400)]
    rows = [(i, u) for i, u in enumerate([*URLS, *made])] + [(7, "http://hot.net/")] * 300 + [(None, "http://a.org/fr/"), (None, None)]
    return rows, spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, host string, verdict string")


@pytest.mark.parametrize("bits, blocks, broadcast", [(16, 1 << 20, 100_000), (16, 1 << 20, 1), (1, 1, 1)])
def test_verdicts_equal_brute_force(spark, pages, monkeypatch, bits, blocks, broadcast):
    monkeypatch.setattr(urls, "BITS_EACH", bits)
    monkeypatch.setattr(urls, "MOST_BLOCKS", blocks)
    monkeypatch.setattr(urls, "BROADCAST_ENTRIES", broadcast)
    rows, df = pages
    rules = [*urls.RULES, ("co.uk", "/", "block"), ("b.co.uk", "/e", "allow"), ("hot.net", "/", "allow")]
    bad = ["http://shop.test/a", "https://www.a.org/en/3", "http://b.com/de/5.html", None, "nothing", *[f"http://other{i}.test/{i}" for i in range(50)]]
    listed = {canonical(*judged(u, [], set())[:2]) for u in bad if u and "://" in u}
    got = urls.judged_urls(df, spark.createDataFrame([*rules, (None, "/", "block"), ("x", None, "block")], "host string, path string, verdict string"), spark.createDataFrame([(u,) for u in bad], "url string"))
    want = Counter((i, *judged(u, rules, listed)) for i, u in rows)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(v for k, v in want.items() if k[3] is None and k[4] == "block") > 3


def test_urls_without_lists_and_without_rows(spark, pages):
    rules, listed = spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "url string")
    rows, df = pages
    got = urls.judged_urls(df, rules, listed)
    assert got.count() == len(rows) and got.where("verdict <> 'allow' or rule is not null").count() == 0
    assert urls.judged_urls(df.limit(0), rules, listed).count() == 0


def test_the_filter_passes_all_entries_and_few_others(spark):
    from pyspark.sql import functions as F

    hashes = spark.range(5000).select(F.xxhash64("id").alias("h"))
    sieve, blocks = urls.blocked_filter(hashes, 5000)
    asked = spark.range(50_000).select("id", F.xxhash64("id").alias("h"))
    passed = asked.withColumn("block", urls.block_of(F.col("h"), blocks)).join(sieve, "block").where(urls.passes(F.col("h")))
    ids = pd.Series([r["id"] for r in passed.select("id").collect()])
    assert (ids < 5000).sum() == 5000 and (ids >= 5000).sum() < 0.01 * 45_000
