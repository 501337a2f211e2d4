"""Bibliographies, cross references and budgets that are read in order."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Headings that open a bibliography, in the languages that are read, and those that close it.
OPENING = re.compile(r"^\s*#*\s*(?:\d+\.?\s+)?(references|bibliography|works cited|literature|literatur|literaturverzeichnis|références|bibliographie|referencias|bibliografía|참고문헌|参考文献)\s*:?\s*$", re.I)
CLOSING = re.compile(r"^\s*(?:#+\s*\S|appendix\b|acknowledge?ments?\b|supplementary\b)", re.I)
ENTRY = re.compile(r"^\s*(?:\[(\d{1,4})\]|(\d{1,4})\.)\s+(\S.*)$")
#: Room in characters that is worth cutting an item for.
WORTH_CUTTING = 600


def bibliography(pages: list[str]) -> dict[int, str]:
    """Entries by number. A section goes on over pages as long as its numbers climb; lines without a number join the entry before."""
    out: dict[int, str] = {}
    now, last = False, 0
    for text in pages:
        for line in text.split("\n"):
            if OPENING.match(line):
                now, last = True, 0
                continue
            if not now:
                continue
            if CLOSING.match(line):
                now = False
                continue
            if m := ENTRY.match(line):
                n = int(m[1] or m[2])
                if n <= last:
                    now = False
                    continue
                out[n], last = m[3].strip(), n
            elif line.strip() and last:
                out[last] = f"{out[last]} {line.strip()}"
    return out


#: Kinds of places that a text may refer to, and how each is written.
KINDS = {
    "page": r"\bp(?:age|p?\.)s?\s*(\d+)",
    "section": r"(?:\bsec(?:tion|\.)s?|§)\s*(\d+(?:\.\d+)*)",
    "appendix": r"\bapp(?:endix|\.)\s*([A-Z]|\d+)\b",
    "chapter": r"\bch(?:apter|\.)\s*(\d+)",
    "figure": r"\bfig(?:ure|\.)s?\s*(\d+(?:\.\d+)*[a-z]?)",
    "table": r"\btab(?:le|\.)s?\s*(\d+(?:\.\d+)*)",
    "equation": r"\b(?:eq(?:uation|n)?\.?)s?\s*\(?(\d+(?:\.\d+)*)\)?",
    "theorem": r"\b(?:theorem|lemma|proposition|corollary|definition)\s*(\d+(?:\.\d+)*)",
}
PATTERNS = {k: re.compile(p, re.I) for k, p in KINDS.items()}


def cross_references(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and number of each reference; of overlapping ones the earliest stays, then the longest."""
    found = sorted(((m.start(), -m.end(), k, m[1]) for k, p in PATTERNS.items() for m in p.finditer(text)))
    out: list[tuple[int, int, str, str]] = []
    for start, end, kind, number in found:
        if not out or start >= out[-1][1]:
            out.append((start, -end, kind, number))
    return out


def turn_budget(items: list[tuple[str, int, bool, int]], limit: int) -> list[tuple[str, int]]:
    """Items (id, characters, pinned, priority) that fit, with the characters of each.

    Pinned ones come first and whole, then the others by priority. The first
    that doesn't fit is cut if there is room worth it; nothing follows a cut.
    """
    out, room = [], limit
    for ident, size, pinned, _ in sorted(items, key=lambda i: (not i[2], i[3])):
        if pinned or size <= room:
            out.append((ident, size))
            room -= size
        elif room > WORTH_CUTTING:
            out.append((ident, room))
            break
    return out


def batches(sizes: list[int], limit: int) -> list[int]:
    """The batch of each item in order: a batch is closed before an item that would take it over the limit."""
    out, now, used = [], 0, 0
    for n in sizes:
        if used and used + n > limit:
            now, used = now + 1, 0
        out.append(now)
        used += n
    return out


def bibliographies(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, number, entry of every document's pages; a document's pages are read together."""
    rows_ = pages.select(F.col(doc).cast("long").alias("doc"), F.struct(F.col(page).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("page"))
    listed = rows_.groupBy("doc").agg(F.sort_array(F.collect_list("page")).alias("pages"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = [(d, n, e) for d, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, e in bibliography(ps).items()]
            cols = list(zip(*found)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))], ["doc", "number", "entry"])

    return listed.select("doc", F.col("pages.text")).mapInArrow(run, "doc long, number long, entry string")
