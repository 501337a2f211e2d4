"""Where a proposed edit belongs in a text that may have drifted, and which part of a long note to carry along.

Lines are compared by fingerprints without the blanks around them, as arrays within
a row: a place counts only if it is the only one of its kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AROUND = r"^[\s ﻿]+|[\s ﻿]+$"
#: The stretch between two anchors is at most so many times as long as what is searched for.
LONGEST = 3


def bare(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.regexp_replace(x, _AROUND, ""))


def fingerprints(lines: Column) -> Column:
    return F.transform(bare(lines), lambda x: F.xxhash64(x))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named: a column named twice is worked out twice within a row's lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def upto(n: Column) -> Column:
    """0 to n - 1; none for n under 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def edit_places(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """edit_id, strategy, start and end (characters, from 0) of edits (edit_id, doc_id, search) in documents (doc_id, text).

    exact: the first place of the very text. line_trim: the only run of lines
    that are equal but for blanks around them. anchored: for three lines or more,
    the only stretch from a line like the first that says something to the next
    one like the last, if it is at most LONGEST times as long. ambiguous: more
    than one such place. none: no place, an empty or null search, or no text; then
    there is no start. Ids of documents are different; each edit gives one row.
    """
    joined = edits.select("edit_id", "doc_id", F.col("search").cast("string").alias("search")).join(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id", "left")
    exact = F.when(F.length("search") > 0, F.expr("position(search, text)") - 1).otherwise(F.lit(-1))
    rows = joined.withColumn("at", F.coalesce(exact, F.lit(-1)))
    # Only what is not found as it stands is cut into lines.
    lines = lambda c: F.when((F.col("at") < 0) & (F.length("search") > 0), F.split(F.coalesce(c, F.lit("")), "\n", -1))
    rows = rows.withColumn("lines", lines(F.col("text"))).withColumn("wanted", lines(F.col("search")))
    rows = rows.withColumn("prints", fingerprints(F.col("lines"))).withColumn("asked", fingerprints(F.col("wanted")))
    n, m = F.size("asked"), F.size("prints")
    runs = F.filter(upto(m - n + 1), lambda i: F.slice("prints", i + 1, n) == F.col("asked"))
    says = F.transform(F.filter(bare(F.col("wanted")), lambda x: x != ""), lambda x: F.xxhash64(x))
    rows = rows.withColumn("runs", runs).withColumn("says", says)
    after = lambda i: F.array_position(F.slice("prints", i + 2, m), F.element_at("says", -1))
    firsts = F.filter(upto(m), lambda i: (F.element_at("prints", i + 1) == F.element_at("says", 1)) & (after(i) > 0))
    spans = F.when((n >= 3) & (F.size("says") >= 2) & (F.size("runs") == 0), F.transform(firsts, lambda i: F.struct(i.alias("first"), (after(i).cast("int") + 1).alias("count"))))
    rows = rows.withColumn("spans", F.coalesce(spans, F.array().cast("array<struct<first:int,count:int>>")))
    one = F.element_at("spans", 1)
    strategy = (
        F.when(F.col("at") >= 0, "exact").when(F.size("runs") == 1, "line_trim").when(F.size("runs") > 1, "ambiguous")
        .when((F.size("spans") == 1) & (F.try_element_at("spans", F.lit(1))["count"] <= LONGEST * n), "anchored").when(F.size("spans") > 1, "ambiguous").otherwise("none")
    )
    rows = rows.withColumn("strategy", strategy)
    first = F.when(F.col("strategy") == "line_trim", F.element_at("runs", 1)).when(F.col("strategy") == "anchored", one["first"])
    count = F.when(F.col("strategy") == "line_trim", n).when(F.col("strategy") == "anchored", one["count"])
    before = F.length(F.array_join(F.slice("lines", 1, first), "\n")) + F.when(first > 0, 1).otherwise(0)
    start = F.when(F.col("strategy") == "exact", F.col("at")).when(first.isNotNull(), before)
    size = F.when(F.col("strategy") == "exact", F.length("search")).when(first.isNotNull(), F.length(F.array_join(F.slice("lines", first + 1, count), "\n")))
    return rows.select("edit_id", "strategy", start.cast("long").alias("start"), (start + size).cast("long").alias("end"))


#: Words that say nothing about a note.
NOTE_STOP = ["the", "and", "for", "was", "with", "that", "this", "what", "did", "how", "why", "about", "have", "has", "are", "were", "from", "into", "not", "but", "you", "your", "its", "it's", "write", "wrote", "said", "say"]
#: What stands where text was left out, the least room for a piece of a section, and how much of a selection is looked for.
CUT, EARLIER, REST, BETWEEN, LATER = "\n[...truncated]", "[... earlier in this section omitted ...]\n", "\n[... rest of this section omitted ...]", "[... unrelated sections omitted ...]", "[... later sections omitted ...]"
LEAST_ROOM, SELECTED = 200, 80


def note_terms(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]{3,})"), 1)
    return F.array_except(words, F.array(*[F.lit(w) for w in NOTE_STOP]))


def note_sections(text: Column) -> Column:
    """A note cut before each heading; blank text before the first is no section."""
    parts = F.split(text, r"(?m)\n(?=#{1,6}\s)", -1)
    return F.filter(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "") != "")


def piece_around(section: Column, selection: Column, terms: Column, room: Column) -> Column:
    """A slice of a long section around the selection, or else the first term in it; empty if neither is there."""
    picked = F.when(F.length(selection) > 0, F.call_function("position", F.substring(selection, 1, SELECTED), section)).otherwise(0)
    hit = once(F.lower(section), lambda low: F.filter(F.transform(terms, lambda w: F.call_function("position", w, low)), lambda p: p > 0))
    first = F.when(picked > 0, picked - 1).otherwise(F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit(0)) - 1)
    half = F.floor(room / 2).cast("int")

    def slice_at(at: Column) -> Column:
        start, end = F.greatest(F.lit(0), at - half), F.least(F.length(section), at + half)
        inner = F.trim(section.substr(start + 1, end - start))
        return F.when(at >= 0, F.concat(F.when(start > 0, EARLIER).otherwise(""), inner, F.when(end < F.length(section), REST).otherwise(""))).otherwise("")

    return once(first, slice_at)


def note_window(text: Column, question: Column, selection: Column, budget: int) -> Column:
    """The part of a note that fits the reader within about ``budget`` characters.

    A short note stays whole. Sections are taken by the terms that they share with
    the question (one each) and the selection (two each, fifty for the selection
    itself) while they fit; the first that doesn't gives a piece if there is room.
    They come in the note's order with marks where text was left out. With no
    section, or nothing shared, the note's beginning stays. A null note is empty.
    """
    given = F.struct(F.coalesce(text, F.lit("")).alias("note"), F.coalesce(selection, F.lit("")).alias("chosen"), note_terms(question).alias("asked"), note_terms(selection).alias("picked"))
    return once(given, lambda g: given_window(g["note"], g["chosen"], g, budget))


def given_window(note: Column, chosen: Column, terms: Column, budget: int) -> Column:
    """The window of a note and a selection that are there, with the terms (asked, picked)."""
    kept_type = "array<struct<i:int,s:string>>"

    def ranked(sections: Column, given: Column) -> Column:
        def scored(s: Column, i: Column) -> Column:
            literal = F.when((F.length(chosen) > 0) & F.contains(s, F.substring(chosen, 1, SELECTED)), 50).otherwise(0)
            score = once(note_terms(s), lambda t: F.size(F.array_intersect(given["asked"], t)) + 2 * F.size(F.array_intersect(given["picked"], t)) + literal)
            return F.struct((-score).alias("rank"), i.alias("i"), s.alias("s"))

        return F.filter(F.array_sort(F.transform(sections, scored)), lambda x: x["rank"] < 0)

    def kept(rows: Column, given: Column) -> Column:
        start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("cut"), F.array().cast(kept_type).alias("kept"))

        def take(state: Column, x: Column) -> Column:
            room = F.lit(budget) - state["used"]
            fits = F.length(x["s"]) <= room
            piece = F.when(fits, x["s"]).when((room >= LEAST_ROOM) & ~state["cut"], piece_around(x["s"], chosen, F.concat(given["picked"], given["asked"]), room)).otherwise("")

            def taken(p: Column) -> Column:
                return F.struct(
                    (state["used"] + F.length(p)).alias("used"), (state["cut"] | ((F.length(p) > 0) & ~fits)).alias("cut"),
                    F.when(F.length(p) > 0, F.concat(state["kept"], F.array(F.struct(x["i"].alias("i"), p.alias("s"))))).otherwise(state["kept"]).alias("kept"),
                )

            return once(piece, taken)

        return F.array_sort(F.aggregate(rows, start, take)["kept"])

    def put_together(rows: Column, n: Column) -> Column:
        # What is before a section and was not kept leaves one mark.
        join0 = F.struct(F.lit(-1).alias("last"), F.array().cast("array<string>").alias("parts"))
        joined = F.aggregate(rows, join0, lambda a, x: F.struct(x["i"].alias("last"), F.concat(a["parts"], F.when(x["i"] > a["last"] + 1, F.array(F.lit(BETWEEN))).otherwise(F.array().cast("array<string>")), F.array(x["s"])).alias("parts")))
        whole = once(joined, lambda j: F.array_join(F.concat(j["parts"], F.when(j["last"] < n - 1, F.array(F.lit(LATER))).otherwise(F.array().cast("array<string>"))), "\n"))
        return F.regexp_replace(whole, r"^\s+|\s+$", "")

    head = F.concat(F.substring(note, 1, budget), F.lit(CUT))

    def window_of(sections: Column) -> Column:
        rows = kept(ranked(sections, terms), terms)
        return F.when(F.size(sections) <= 1, head).otherwise(once(rows, lambda r: F.when(F.size(r) == 0, head).otherwise(put_together(r, F.size(sections)))))

    return F.when(F.length(note) <= budget, note).otherwise(once(note_sections(note), window_of))
