"""Captions, the sections around them, and the definitions that mentions mean, against plain programs."""

import random

from sparkloom.operators import captions as C


def test_captions_of_lines(spark):
    text = "\n".join(["Figure 1.2: a plot", "see Figure 1.2", " Tbl. 3a", "수식 4", "FIGURE 7", "Figures of speech 3", "x = y (2.1)", "(2.2)", "E = m", "(5)", "no maths", "(6)", "a (7) b", "Eq. A4.2 holds, f(x) = 1 (A4.3).", "Lemma 9", "Fig12"])
    df = spark.createDataFrame([(1, 3, text), (1, 4, None), (2, 1, "")], "doc_id long, page long, text string")
    got = sorted((r["line"], r["kind"], r["number"]) for r in C.captions(C.lines_of(df)).collect())
    assert got == [(0, "figure", "1.2"), (2, "table", "3A"), (3, "equation", "4"), (4, "figure", "7"), (6, "equation", "2.1"), (7, "equation", "2.2"), (9, "equation", "5"), (13, "equation", "A4.2"), (13, "equation", "A4.3"), (14, "theorem", "9")]


def test_sections_are_a_stack(spark):
    rng = random.Random(1)
    docs = []
    for d in range(20):
        for page in range(4):
            docs.append((d, page, "\n".join(rng.choice(["#", "##", "###", "####### no", "#no", ""]) + f" t{rng.randrange(9)}" for _ in range(rng.randrange(7)))))
    df = spark.createDataFrame(docs, "doc_id long, page long, text string")
    got = {(r["doc_id"], r["page"], r["line"]): r["sections"] for r in C.enclosing(C.lines_of(df)).collect()}
    for d in range(20):
        stack = []
        for doc, page, text in docs:
            if doc != d:
                continue
            for k, line in enumerate(text.split("\n")):
                mark = len(line) - len(line.lstrip("#"))
                if 1 <= mark <= 6 and line[mark : mark + 1] == " ":
                    stack = [s for s in stack if s[0] < mark] + [(mark, line[mark:].strip())]
                assert got[d, page, k] == [t for _, t in stack], (d, page, k)


def test_mentions_find_the_nearest(spark):
    rng = random.Random(2)
    objects = [(rng.randrange(2), rng.randrange(60), rng.randrange(3), "figure", rng.choice(["1", "1.2", "A3"])) for _ in range(40)]
    asks = [(i, rng.randrange(3), "figure", rng.choice(["1", "1.2", "a3", "9"]), rng.randrange(60)) for i in range(120)]
    o = spark.createDataFrame(objects, "doc_id long, page long, line int, kind string, number string")
    m = spark.createDataFrame(asks, "mention_id long, doc_id long, kind string, number string, page long")
    got = {r["mention_id"]: (r["found_page"], r["found_line"]) for r in C.resolved(m, o).collect()}
    for i, d, kind, number, page in asks:
        far = lambda p: (p - page) * 1.15 if p >= page else page - p  # noqa: E731, B023
        fits = sorted((far(p), p, line) for doc, p, line, k, n in objects if (doc, k, n) == (d, kind, number.upper()))
        assert got[i] == (fits[0][1:] if fits else (None, None))


def test_objects_have_owners(spark):
    outline = [(1, 0, "1 Start", 1), (1, 1, "1.1 More", 3), (1, 2, "1.1.1 Deep", 5), (1, 3, "Appendix 4 Tables", 20), (1, 4, "2.3 Late", 9), (1, 5, "2 General", None), (1, 6, "No number", 2)]
    objects = [(1, 4, 0, "figure", "1.1"), (1, 4, 0, "table", "1.7"), (1, 6, 0, "figure", "1.9"), (1, 1, 0, "figure", "2.8"), (1, 30, 0, "result", "A4"), (1, 30, 1, "result", "A4.1"), (1, 3, 0, "figure", "8.1"), (2, 1, 0, "figure", "1.1")]
    got = [r["owner"] for r in C.owners(spark.createDataFrame(objects, "doc_id long, page long, line int, kind string, number string"), spark.createDataFrame(outline, "doc_id long, place int, title string, page long")).orderBy("doc_id", "number", "page", "line").collect()]
    assert got == ["1.1 More", "1.1 More", "1.1.1 Deep", "2 General", None, "Appendix 4 Tables", "Appendix 4 Tables", None]
