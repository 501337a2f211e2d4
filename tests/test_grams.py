"""Substring search against Python's own, in several scripts."""

import random

from sparkloom.operators import grams
from sparkloom.storage import Workspace


def places(text, phrase):
    return [i for i in range(len(text)) if text.startswith(phrase, i)]


def test_phrases_are_found_as_python_finds_them(spark):
    rng = random.Random(2)
    letters = "abAé日本語𝄞 .\n"
    docs = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(80)))) for i in range(200)] + [(900, None), (901, ""), (902, "a" * 3000), (903, "日本語の検索"), (904, "x" * 3000 + "needle")]
    phrases = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    some = [t for _, t in docs if t]
    phrases += [(100 + i, t[k : k + n]) for i in range(40) for t in [rng.choice(some)] for k, n in [(rng.randrange(len(t)), rng.randrange(1, 30))]]
    phrases += [(300, ""), (301, None), (302, "aaa"), (303, "検索"), (304, "needle"), (305, "needles"), (306, "の"), (307, "x" * 2999 + "xneedle"), (308, "AAAAA")]
    d = spark.createDataFrame([(*r, 1, "p") for r in docs + [(None, "aaa")]], "doc_id long, text string, gram int, places string")
    q = spark.createDataFrame([(*r, 1) for r in phrases], "query_id long, phrase string, size int")
    for fold in (True, False):
        same = str.lower if fold else str
        got = {(r["query_id"], r["doc_id"]): (r["places"], r["first"]) for r in grams.holding(grams.build_grams(d, Workspace(spark, "g"), fold=fold), q).collect()}
        want = {(i, j): (len(p), p[0]) for i, phrase in phrases if phrase for j, t in docs if t for p in [places(same(t), same(phrase))] if p}
        assert got == want


def test_grams_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "abc"), (2, "a")], "query_id long, phrase string")
    work = Workspace(spark, "g")
    assert grams.holding(grams.build_grams(none, work), q).count() == 0
    some = grams.build_grams(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), work)
    assert grams.holding(some, q.limit(0)).count() == 0
