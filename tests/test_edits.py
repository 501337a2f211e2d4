"""Places of edits and windows of notes against plain programs."""

import random
import re

from pyspark.sql import functions as F

from sparkloom.operators import edits as E


def place(text, search):
    if not search or text is None:
        return "none", None, None
    if search in text:
        return "exact", text.index(search), text.index(search) + len(search)
    lines, want = text.split("\n"), search.split("\n")
    start = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
    span = lambda i, k: (start[i], start[k] + len(lines[k]))
    a, b = [x.strip() for x in lines], [x.strip() for x in want]
    runs = [i for i in range(len(a) - len(b) + 1) if a[i : i + len(b)] == b]
    if runs:
        return ("line_trim", *span(runs[0], runs[0] + len(b) - 1)) if len(runs) == 1 else ("ambiguous", None, None)
    says = [x for x in b if x]
    if len(b) >= 3 and len(says) >= 2:
        spans = [(i, next(k for k in range(i + 1, len(a)) if a[k] == says[-1])) for i in range(len(a)) if a[i] == says[0] and says[-1] in a[i + 1 :]]
        if len(spans) > 1:
            return "ambiguous", None, None
        if spans and spans[0][1] - spans[0][0] + 1 <= 3 * len(b):
            return "anchored", *span(*spans[0])
    return "none", None, None


def test_places_equal_a_plain_program(spark):
    rng = random.Random(9)
    some = ["a", " a", "b\t", "", "  ", "cc", "d e", "{", "}"]
    docs = [(i, "\n".join(rng.choice(some) for _ in range(rng.randrange(1, 12)))) for i in range(150)] + [(900, None), (901, ""), (902, "x\n" * 3000 + "y")]
    asks = []
    for i, t in docs:
        lines = (t or "").split("\n")
        k = rng.randrange(len(lines))
        part = [rng.choice(["", " ", "\t"]) + x for x in lines[k : k + rng.randrange(1, 5)]]
        if rng.random() < 0.4 and len(part) > 2:
            part[1] = "changed"
        asks.append((len(asks), i, "\n".join(part)))
    asks += [(1000, 902, " x\ny"), (1001, 902, "x\n z\ny"), (1002, 12345, "a"), (1003, 1, None), (1004, 1, "")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, lines int")
    got = {r["edit_id"]: (r["strategy"], r["start"], r["end"]) for r in E.edit_places(d, spark.createDataFrame([(*a, "x") for a in asks], "edit_id long, doc_id long, search string, at string")).collect()}
    text = dict(docs)
    want = {a: place(text.get(i), s) for a, i, s in asks}
    assert got == want and {s for s, *_ in want.values()} == {"exact", "line_trim", "anchored", "ambiguous", "none"}


def terms(t):
    return {w for w in re.findall(r"[^\W_]{3,}", (t or "").lower()) if w not in E.NOTE_STOP}


def window(note, question, selection, budget):
    note, selection = note or "", selection or ""
    if len(note) <= budget:
        return note
    secs = [s for s in re.split(r"\n(?=#{1,6}\s)", note) if s.strip()]
    q, p = terms(question), terms(selection)
    rank = sorted(((-(len(q & terms(s)) + 2 * len(p & terms(s)) + 50 * bool(selection and selection[:80] in s)), i) for i, s in enumerate(secs)))
    kept, used, cut = {}, 0, False
    for r, i in rank:
        s, room = secs[i], budget - used
        if r == 0:
            continue
        if len(s) <= room:
            kept[i] = s
        elif room >= 200 and not cut:
            ordered = [w for t in (selection, question or "") for w in dict.fromkeys(re.findall(r"[^\W_]{3,}", t.lower())) if w not in E.NOTE_STOP]
            places = [s.lower().index(w) for w in ordered if w in s.lower()]
            at = s.index(selection[:80]) if selection and selection[:80] in s else places[0] if places else -1
            if at < 0:
                continue
            a, b = max(0, at - room // 2), min(len(s), at + room // 2)
            kept[i], cut = (E.EARLIER if a else "") + s[a:b].strip(" ") + (E.REST if b < len(s) else ""), True
        else:
            continue
        used += len(kept[i])
    if len(secs) <= 1 or not kept:
        return note[:budget] + E.CUT
    out, last = [], -1
    for i in sorted(kept):
        out += [E.BETWEEN] * (i > last + 1) + [kept[i]]
        last = i
    return "\n".join(out + [E.LATER] * (last < len(secs) - 1)).strip()


def test_windows_equal_a_plain_program(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(40)] + ["the", "été", "日本語"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(None, "a", "b"), ("", None, None), ("# one", "one", None), ("x" * 900, "x", "")]
    for _ in range(120):
        note = "\n".join(rng.choice(["# ", "### ", "#", ""]) + say(rng.choice([1, 5, 30, 90])) for _ in range(rng.randrange(1, 9)))
        k = rng.randrange(len(note))
        rows.append((note, rng.choice([None, say(3)]), rng.choice([None, "", note[k : k + 100]])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, note string, question string, selection string")
    for budget in (300, 700):
        got = {r["id"]: r["w"] for r in df.select("id", E.note_window(F.col("note"), F.col("question"), F.col("selection"), budget).alias("w")).collect()}
        for i, r in enumerate(rows):
            assert got[i] == window(*r, budget), (budget, r)


def test_a_window_works_its_parts_out_once(spark):
    df = spark.createDataFrame([("a", "b", "c")], "note string, question string, selection string")
    plan = df.select(E.note_window(F.regexp_replace("note", "x", "mark of the note"), F.col("question"), F.concat("selection", F.lit("mark of the selection")), 300).alias("w"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("mark of the note") == 1 and plan.count("(?=#{1,6}") == 1 and plan.count("mark of the selection") <= 2
