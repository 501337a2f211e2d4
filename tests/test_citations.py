"""Folds over text in order."""

from sparkloom.operators import citations as C


def test_bibliography_over_pages():
    pages = ["Text [1].\n## References\n[1] First entry\ncontinued here\n[2] Second", "[3] Third\n[2] not a bibliography any more\n[4] lost", "Literatur\n1. Neu\n# Ende\n2. nicht"]
    assert C.bibliography(pages) == {1: "Neu", 2: "Second", 3: "Third"}
    assert C.bibliography([]) == {} and C.bibliography(["[1] no heading"]) == {}


def test_references_do_not_overlap():
    got = C.cross_references("See Fig. 2.1a and Section 3.2, p. 14, eq. (5) and Lemma 7; §4.")
    assert [(k, n) for _, _, k, n in got] == [("figure", "2.1a"), ("section", "3.2"), ("page", "14"), ("equation", "5"), ("theorem", "7"), ("section", "4")]
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_turn_budget_cuts_only_where_it_is_worth_it():
    items = [("a", 500, False, 2), ("b", 300, True, 9), ("c", 2000, False, 1), ("d", 10, False, 3)]
    assert C.turn_budget(items, 2500) == [("b", 300), ("c", 2000), ("d", 10)]
    assert C.turn_budget(items, 1500) == [("b", 300), ("c", 1200)]


def test_batches_close_before_they_overflow():
    assert C.batches([5, 5, 5, 20, 1], 10) == [0, 0, 1, 2, 3] and C.batches([], 10) == []


def test_bibliographies_of_documents(spark):
    pages = spark.createDataFrame([(1, 2, "[2] b"), (1, 1, "References\n[1] a"), (2, 1, None)], "d long, p long, t string")
    assert sorted(map(tuple, C.bibliographies(pages, "d", "p", "t").collect())) == [(1, 1, "a"), (1, 2, "b")]
