"""Operators on small inputs with known results."""

import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import questions as Q
from sparkloom.functions import text as T
from sparkloom.operators import claims, graph, index, packs, search, spans, sync
from sparkloom.operators.components import connected_components
from sparkloom.storage import Workspace

EDGES = [("N01", "N02", 0.95), ("N02", "N03", 0.95), ("N01", "N04", 0.20), ("N05", "N06", 0.95), ("N06", "N07", 0.85), ("N07", "N08", 0.25),
         ("N09", "N11", 0.95), ("N10", "N12", 0.95), ("N04", "N13", 0.05), ("N13", "N14", 0.05), ("N14", "N05", 0.05)]


def giant(spark, least):
    e = spark.createDataFrame(EDGES, "a string, b string, c double").where(f"c >= {least}")
    sizes = connected_components(e, Workspace(spark, "t")).groupBy("component").count()
    return sizes.agg(F.max("count") / F.sum("count")).first()[0]


def test_giant_component_before_and_after_a_threshold(spark):
    assert round(giant(spark, 0), 3) == 0.714
    assert round(giant(spark, 0.5), 3) == 0.300


def test_components_of_a_long_chain_loops_and_repeats(spark):
    rows = [(i, i + 1) for i in range(200)] + [(5, 5), (3, 4), (500, 501), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(rows, "a long, b long"), Workspace(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def test_bridges_need_two_nodes_on_each_side(spark):
    #  1-2-3 triangle, bridge 3-4, triangle 4-5-6, pendant 6-7, parallel edge 8-9 twice
    e = [(1, 1, 2), (2, 2, 3), (3, 1, 3), (4, 3, 4), (5, 4, 5), (6, 5, 6), (7, 4, 6), (8, 6, 7), (9, 8, 9), (10, 9, 8), (11, 7, 7)]
    edges = spark.createDataFrame(e, "edge_id long, src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 10)], "node long")
    parts = graph.communities(nodes, edges, Workspace(spark, "t"))
    assert [r["edge_id"] for r in graph.bridges(edges, parts, Workspace(spark, "test")).collect()] == [4]


def test_bridges_equal_the_loss_of_each_edge(spark):
    rng = random.Random(3)
    edges = [(i, a, b) for i, (a, b) in enumerate((rng.randrange(60), rng.randrange(60)) for _ in range(62))] + [(900, 200, 201), (901, 201, 202), (902, 202, 203), (903, 300, 301), (904, 301, 300)]

    def component(node, left):
        seen, todo = {node}, [node]
        while todo:
            x = todo.pop()
            for _, a, b in left:
                for y in (b,) * (a == x) + (a,) * (b == x):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
        return seen

    want = set()
    for e in edges:
        if e[1] != e[2]:
            left = [x for x in edges if x != e]
            a, b = component(e[1], left), component(e[2], left)
            if e[2] not in a and len(a) >= 2 and len(b) >= 2:
                want.add(e[0])
    parts = [(n, min(component(n, edges))) for n in {x for e in edges if e[1] != e[2] for x in e[1:]}]
    got = graph.bridges(spark.createDataFrame(edges, "edge_id long, src long, dst long"), spark.createDataFrame(parts, "node long, component long"), Workspace(spark, "test"))
    assert {r["edge_id"] for r in got.collect()} == want and len(want) > 3


def test_pagerank_equals_its_rounds_and_leaves_out_what_the_walk_cannot_reach(spark):
    # 1-2-3-4 with a heavy edge and a loop, a seed 9 without edges, and a far part that is larger than the rest
    edges = [(1, 2, 1.0), (2, 3, 3.0), (3, 4, 1.0), (1, 3, 2.0), (4, 4, 1.0)] + [(i, i + 1, 1.0) for i in range(100, 130)]
    both = edges + [(b, a, w) for a, b, w in edges]
    total = {a: sum(w for x, _, w in both if x == a) for a, _, _ in both}
    df, seeds = spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame([(1,), (9,)], "node long")
    for rounds in (0, 1, 2, 7, 30):
        rank = {1: 0.5, 9: 0.5}
        for _ in range(rounds):
            moved = {1: 0.15 * 0.5, 9: 0.15 * 0.5}
            for a, b, w in both:
                if a in rank:
                    moved[b] = moved.get(b, 0.0) + 0.85 * w / total[a] * rank[a]
            rank = moved
        work = Workspace(spark, "test")
        got = {r["node"]: r["r"] for r in graph.pagerank(df, seeds, work, rounds).collect()}
        assert got == pytest.approx(rank, abs=1e-12)
    assert {r["src"] for r in spark.read.parquet(work.path("pagerank-reached")).collect()} == {1, 2, 3, 4}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pagerank")]


def test_memory_paths_scores(spark):
    e = spark.createDataFrame([(10, 1, 2, 0.8, True), (11, 2, 3, 0.7, True), (12, 4, 1, 0.4, False), (13, 4, 5, 0.6, False)], "edge_id long, src long, dst long, confidence double, has_span boolean")
    seeds, domain = spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(5,), (4,)], "node long")
    got = {(r["via"], r["end"]): r["score"] for r in graph.paths(e, seeds, domain).collect()}
    assert got == {(2, None): 0.75, (2, 3): 0.36875, (4, None): round(0.35 + 0.1 + 0.1, 6), (4, 5): round((0.35 + 0.125 + 0.1) / 2, 6)}
    assert {(r["via"], r["end"]) for r in graph.paths(e, seeds, domain, most=2).collect()} == {(2, None), (2, 3)}


def test_closure_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 3)], "src long, dst long")
    got = {r["node"]: r["depth"] for r in graph.closure(edges, spark.createDataFrame([(0,)], "node long"), Workspace(spark, "test")).collect()}
    assert got == {i: i for i in range(41)}


def test_vector_order_and_zero_vector(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.7, 0.7, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 0.0])], "vec_id long, v array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, v array<float>")
    assert [(r["vec_id"], round(r["score"], 3)) for r in search.cosine_topk(v, q, 4).orderBy("rank").collect()] == [(1, 1.0), (2, 0.707), (3, 0.0), (4, 0.0)]
    zero = spark.range(1).select(search.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("v")).first()["v"]
    assert zero == [0.0, 0.0]
    with pytest.raises(Exception, match="different dimensions"):
        search.cosine_topk(v.unionByName(spark.createDataFrame([(5, [1.0])], v.schema)), q, 4).collect()


def test_blocks_of_queries_and_ties(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, i % 3, [float(rng.randrange(3)) for _ in range(3)] + [1.0]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, record long, v array<float>").repartition(5)
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "v")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in search.cosine_topk(v.select("vec_id", "v"), q, 7).collect()}
    best = {(r["query_id"], r["record"]): r["vec_id"] for r in search.best_chunks(v, q).collect()}
    for a, _, x in rows[::10]:
        order = sorted((-cos(x, y), b, c) for b, c, y in rows)
        assert [got[a, k + 1] for k in range(7)] == [b for _, b, _ in order[:7]]
        assert all(best[a, c] == next(b for _, b, r in order if r == c) for c in range(3))


DOCS = [(1, "Residual learning: residual connections ease deep network optimization"), (8, "Jaguar: the apex predator of the amazon basin"), (9, "Jaguar: the e-type sports car and its engine"), (4, "Dropout: randomly deactivating units for regularization"), (5, "coral bleaching under heat stress"), (6, None)]


def test_bm25_finds_the_right_record_and_prefers_the_predator(spark):
    q = spark.createDataFrame([(1, ["residual", "connections", "network"]), (7, ["jaguar", "apex", "predator", "amazon"]), (8, ["jaguar", "sports", "car"])], "query_id long, terms array<string>")
    x = index.build_index(spark.createDataFrame(DOCS, "doc_id long, text string"), Workspace(spark, "test"))
    assert {r["query_id"]: r["doc_id"] for r in index.ranked(index.scored_terms(x, q), 1).collect()} == {1: 1, 7: 8, 8: 9}


def test_search_equals_a_full_text_engine(spark):
    """Phrases, beginnings and exclusions against the search engine of the standard library, with the same match strings; before a bracket it wants AND spelt out."""
    rng = random.Random(11)
    words = ["alpha", "alphabet", "beta", "nn.conv", "e-type", "rank", "fusion", "Naïve", "naive", "gamma_ray", "the", "delta"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(80)]
    asked = ['"rank fusion" alpha', "alpha -beta", "alph nn.c", '"rank fusion"', "naive e-type -delta", '"the alpha" "beta rank" gam', "zeta", "the -alpha", '"zeta zeta" alpha', "a/b alpha"]
    db = sqlite3.connect(":memory:")
    db.execute("""create virtual table d using fts5(text, tokenize = "unicode61 remove_diacritics 2 tokenchars '_-.'")""")
    db.executemany("insert into d(rowid, text) values (?, ?)", docs)
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    matches = {r["query_id"]: r["m"] for r in q.select("query_id", Q.match_string(F.col("question")).alias("m")).collect()}
    x = index.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), Workspace(spark, "test"))
    got = {}
    for r in index.lexical_hits(x, q, Workspace(spark, "test")).collect():
        got.setdefault(r["query_id"], {})[r["doc_id"]] = r["score"]
    for i, m in matches.items():
        want = {d: -s for d, s in db.execute("select rowid, bm25(d) from d where d match ?", (m.replace('" (', '" AND ('),))} if m and not m.startswith("NOT") else {}
        assert set(got.get(i, {})) == set(want), asked[i]
        assert all(abs(got[i][d] - s) < 1e-5 for d, s in want.items()), asked[i]


def test_passages_are_found_where_they_stand(spark):
    docs = [(1, "one two three four five"), (2, "xone two three fourx"), (3, "two three"), (4, None), (5, "One two three four")]
    passages = [(1, "one two three four"), (2, "two three"), (3, "not there at all"), (4, "two")]
    x = index.build_index(spark.createDataFrame(docs, "doc_id long, text string"), Workspace(spark, "test"))
    got = index.holders(x, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "query_id long, passage string"))
    assert {tuple(r) for r in got.collect()} == {(q, d) for q, p in passages for d, t in docs if t and p in t}


def test_rrf_first_place_bonus(spark):
    lists = spark.createDataFrame([(1, "lex_raw", 10, 1), (1, "vec_raw", 10, 2), (1, "vec_raw", 11, 1)], "query_id long, list string, doc_id long, rank long")
    got = {r["doc_id"]: r["score"] for r in search.rrf(lists).collect()}
    assert got == {10: round(1 / 61 + 0.5 / 61 + 0.9 / 62, 6), 11: round(0.9 / 61 + 0.5 / 61, 6)}


def test_demotion_leaves_stale_alone(spark):
    hits = spark.createDataFrame([(1, d, 1.0, d, s) for d, s in enumerate(["verified", "unchecked", "failed", "stale", None])], "query_id long, doc_id long, score double, rank long, status string")
    assert {r["doc_id"]: r["score"] for r in search.demote(hits).collect()} == {0: 1.0, 1: 0.85, 2: 0.7, 3: 1.0, 4: 1.0}


def test_the_two_packers_differ(spark):
    items = spark.createDataFrame([(1, i, c) for i, c in enumerate([6, 7, 4, 1])], "q long, i long, cost long")
    assert [r["kept"] for r in packs.prefix_budget(items, ["q"], ["i"], F.col("cost"), 10).orderBy("i").collect()] == [True, False, False, False]
    assert packs.first_fit_budget(items, ["q"], ["i"], "cost", "i", 10).first()["kept"] == [0, 2]
    assert packs.room(16_000) == 15_000 and packs.room(100) == 75


def test_globs_and_scope(spark):
    paths = spark.createDataFrame([("a/b.md",), ("a/c/d.md",), ("x.md",)], "p string")
    keep = lambda inc, exc: [r["p"] for r in paths.where(packs.in_globs(F.col("p"), inc, exc)).orderBy("p").collect()]
    assert keep(["a/*.md"], []) == ["a/b.md"]
    assert keep(["a/**"], ["**/d.md"]) == ["a/b.md"]
    assert keep([], ["a/**"]) == ["x.md"]


def test_verdicts_take_the_best_span(spark):
    c = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, "the and for"), (4, "omega sigma tau rho")], "claim_id long, text string")
    s = spark.createDataFrame([(10, "alpha beta"), (11, "nothing here"), (12, "alpha zeta")], "span_id long, text string")
    d = spark.createDataFrame([(1, 11, 0), (1, 10, 1), (2, 12, 0), (3, 10, 0)], "claim_id long, span_id long, pos long")
    got = {r["claim_id"]: (r["status"], r["reason"], r["primary_span"]) for r in claims.verdicts(c, d, s).collect()}
    assert got[1] == ("verified", "covered", 10) and got[2] == ("uncertain", "partial", 12)
    assert got[3][:2] == ("failed", "no_terms") and got[4][:2] == ("failed", "no_span")


def test_formulas_decide(spark):
    c = spark.createDataFrame([(1, r"$x^2 + y$"), (2, r"alpha beta $a - b$"), (3, r"alpha beta $a - b$"), (4, r"$$\frac{a}{b}$$")], "claim_id long, text string")
    s = spark.createDataFrame([(10, r"so $z = x^2\, + y$ here"), (11, r"alpha beta and $b - a$"), (12, r"alpha beta $c+a-b$"), (13, "nothing")], "span_id long, text string")
    d = spark.createDataFrame([(1, 10, 0), (2, 11, 0), (3, 11, 0), (3, 12, 1), (4, 13, 0)], "claim_id long, span_id long, pos long")
    got = {r["claim_id"]: (r["status"], r["reason"], r["primary_span"]) for r in claims.verdicts(c, d, s).collect()}
    assert got == {1: ("verified", "formula", 10), 2: ("uncertain", "formula_missing", 11), 3: ("verified", "covered", 12), 4: ("failed", "no_terms", 13)}
    loss = lambda e, p, r, x, i: spark.range(1).select(claims.formula_loss(*[F.lit(v) for v in (e, p, r, x)], F.lit(i)).alias("l")).first()["l"]
    assert [loss("a+b", "", "", "$a+b$", False), loss("a+b", "", "$a + b$", "text", False), loss("a+b", "", "", "$a$", False), loss("a+b", "", "", "", True), loss("a+b", "", "", "t", True), loss("a+b", "", "", "", False)] == [None, "parser_omitted", "fragmented", "image_only", "fragmented", None]


def test_last_write_wins_keeps_ties_local(spark):
    a = spark.createDataFrame([(1, 5, "a"), (2, 5, "a"), (3, 5, "a")], "k long, t long, v string")
    b = spark.createDataFrame([(1, 5, "b"), (2, 6, "b"), (4, 1, "b")], "k long, t long, v string")
    got = {r["k"]: (r["v"], r["outcome"]) for r in sync.last_write_wins(a, b, "k", "t", "v").collect()}
    assert got == {1: ("a", "skipped"), 2: ("b", "updated"), 3: ("a", "local"), 4: ("b", "inserted")}


def test_a_deletion_wins_ties(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "k long, t long")
    gone = spark.createDataFrame([(1, 5), (2, 4)], "k long, deleted_at long")
    assert sorted(r["k"] for r in sync.tombstones(rows, gone, "k", "t").collect()) == [2, 3]


def test_remap_keeps_order_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, [])], "k long, ids array<string>")
    got = {r["k"]: r["ids"] for r in sync.remap(rows, spark.createDataFrame([("b", "z")], "old string, new string"), "ids").collect()}
    assert got[1] == ["a", "z", "c"]


def test_sections_drop_text_before_the_first_heading(spark):
    df = spark.createDataFrame([(1, "before\n# A\none\n## B\ntwo"), (2, "none")], "id long, t string")
    got = [(r["id"], r["level"], r["title"], r["text"]) for r in spans.sections(df, "id", "t").orderBy("id", "pos").collect()]
    assert got == [(1, 1, "A", "one"), (1, 2, "B", "two"), (2, 1, "", "none")]


def test_equal_paragraphs_of_a_source_are_one_span(spark):
    df = spark.createDataFrame([(1, "a b\n\nc\n \na b"), (2, "a b"), (3, None)], "id long, t string")
    got = sorted((r["source_id"], r["pos"], r["text"]) for r in spans.prose_spans(df, "id", "t").collect())
    assert got == [(1, 1, "a b"), (1, 2, "c"), (2, 1, "a b")]


def test_windows_reject_a_size_of_nothing(spark):
    with pytest.raises(ValueError):
        spans.windows(spark.range(1), "id", "t", 0, 0)


def test_normalised_text(spark):
    t = spark.createDataFrame([("a\r\n\r\n\r\n\r\nb  \t c \n%%x\ny%%d ",)], "t string").select(T.normalize(F.col("t"))).first()[0]
    assert t == "a\n\nb c\nd"


def test_titles_of_filenames(spark):
    names = spark.createDataFrame([("notes-on_RRF.md",)], "t string").select(T.title_of_filename(F.col("t"))).first()[0]
    assert names == "Notes On RRF"


def test_pairs_of_merge_guards_are_not_shuffled(spark):
    from sparkloom.plans.knowledge_queries import merge_guards

    plan = merge_guards(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = plan.splitlines()
    assert top[0].startswith("Project") and top[1].lstrip("+- ").startswith("Join Inner") and "Aggregate" not in "".join(top[:3])


def test_formulas_end_where_the_pattern_of_the_sql_ends(spark):
    texts = ["alpha$$$ beta%%% gamma$$$ delta", "alpha $$beta$ gamma", "alpha $beta gamma", "alpha $$$ beta", "alpha $$beta$$ gamma $delta$", r"alpha \$beta $gamma$ delta"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", claims.content_terms(F.col("t")).alias("w"), F.size(claims.formulas(F.col("t"))).alias("n"))
    got = {r["i"]: (sorted(r["w"]), r["n"]) for r in df.collect()}
    assert got == {0: (["alpha", "delta"], 1), 1: (["alpha", "gamma"], 1), 2: (["alpha", "beta", "gamma"], 0), 3: (["alpha", "beta"], 1), 4: (["alpha", "gamma"], 2), 5: (["alpha", "beta", "delta"], 1)}


def test_cosines_and_postings_are_made_in_bounded_pieces(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from sparkloom.operators import index, search

    monkeypatch.setattr(index, "POST_TOKENS", 5)
    docs = [["a", "b"], [], ["a", "a", "c"], list("defghij"), ["a"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(docs, pa.list_(pa.string()))], ["doc_id", "tokens"])
    assert [p.num_rows for p in index.slices(batch)] == [3, 1, 2]
    got = {(t, d): (n, p) for b in index.post(iter([batch.slice(1), batch.slice(0, 0)])) for t, d, n, p in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4)))}
    assert got == {(t, d): (docs[d].count(t), [i for i, x in enumerate(docs[d]) if x == t]) for d in range(1, 6) for t in docs[d]}
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, v array<double>")
    q = v.withColumnRenamed("vec_id", "query_id").where("query_id < 11").select("query_id", "v")
    whole = sorted(map(tuple, search.cosine_topk(v, q, 3).collect()))
    monkeypatch.setattr(search, "CELLS", 7)
    assert sorted(map(tuple, search.cosine_topk(v, q, 3).collect())) == whole and len(whole) == 33


def test_hybrid_search_makes_its_vectors_once(spark, tmp_path):
    from sparkloom.operators.search import hybrid
    from sparkloom.storage import Workspace

    vec = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    vec.write.parquet(f"file://{tmp_path}/vec")
    vec = spark.read.parquet(f"file://{tmp_path}/vec")
    lex = spark.createDataFrame([(1, 10, 1), (2, 11, 1)], "query_id long, doc_id long, rank int")
    terms = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "query_id long, terms array<string>")
    status = spark.createDataFrame([(10, "verified")], "doc_id long, status string")
    docs = spark.createDataFrame([(10, "a b"), (11, "b c")], "doc_id long, text string")
    got = hybrid(lex, vec, terms, status, docs, Workspace(spark, "once"))
    assert not [f for f in got.inputFiles() if "/vec/" in f and str(tmp_path) in f]
    assert sorted((r["query_id"], r["doc_id"], r["fallback_mode"]) for r in got.collect()) == [(1, 10, ""), (1, 11, ""), (2, 11, "lex")]
