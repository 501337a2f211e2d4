"""License scan by ordered signature rules.

Each rule of ``license_rules`` is a regular expression with a priority and the
keywords without one of which it can't match. One automaton pass over a text
finds the keywords; only rules with a keyword that is there run. SPDX tags are read as the
expressions that they are. Detections that lie inside one of higher priority (or
of the same priority and longer) are suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, id_text, map_batches, small_batches
from sparkloom.llm.license_rules import TABLE

#: Fixed by the contract of the query: phrases and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Priority of the identifiers of an SPDX tag, and what follows the tag: identifiers with operators and brackets.
TAGGED, TAG = 100, "spdx-license-identifier"
EXPRESSION = re.compile(r"spdx-license-identifier: ?(?P<all>\(? ?[\w.+-]{1,80}(?: ?\(? ?(?:and|or|with) ?\(? ?[\w.+-]{1,80} ?\)?){0,20})", re.I)
IDENTIFIER = re.compile(r"(?:(?P<with>with) )?\b(?!(?:and|or|with)\b)(?P<id>[\w.+-]+)", re.I)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: frozenset[str]
    pattern: re.Pattern[str]

    def name(self, m: re.Match[str]) -> str:
        groups = m.groupdict()
        v = re.sub("[_-]", ".", groups.get("v") or "")
        v = v if "." in v or not v else f"{v[0]}.{v[1:] or 0}"
        return self.label.replace("-{v}", f"-{v}" if v else "") + "-or-later" * bool(groups.get("later"))


def rules() -> list[Rule]:
    out = []
    for line in TABLE.strip().splitlines():
        label, priority, keywords, pattern = re.split(" {2,}", line.strip(), maxsplit=3)
        out.append(Rule(label, int(priority), frozenset(keywords.split("|")), re.compile(pattern, re.I)))
    return out


def tagged(m: re.Match[str]) -> list[tuple[int, int, str]]:
    """The identifiers of an SPDX expression, with their places; exceptions after "with" are named as such."""
    out = []
    for i in IDENTIFIER.finditer(m["all"]):
        name = i["id"].lower().removesuffix("-only")
        name = name[:-1] + "-or-later" if name.endswith("+") else name.strip(".+-")
        if name:
            out.append((m.start("all") + i.start("id"), m.start("all") + i.end("id"), f"exception:{name}" if i["with"] else name))
    return out


#: Bytes after lower-casing A-Z: what isn't in a word is a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


#: More than one white space character, or one that is no blank.
WIDE = re.compile(r"\s{2,}|[^\S ]")


class Scanner:
    def __init__(self) -> None:
        self.rules = rules()
        self.keywords = ahocorasick.Automaton()
        for k in {TAG} | {k for r in self.rules for k in r.keywords}:
            self.keywords.add_word(k, k)
        self.keywords.make_automaton()

    def detections(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, priority) of what no other detection suppresses, by place."""
        line, wide = text, [m.span() for m in WIDE.finditer(text)]
        if wide:
            line = WIDE.sub(" ", text)
        there = {k for _, k in self.keywords.iter(line.lower())}
        if not there:
            return []
        found = [(m.start(), m.end(), r.name(m), r.priority) for r in self.rules if not there.isdisjoint(r.keywords) for m in r.pattern.finditer(line)]
        if TAG in there:
            found += [(s, e, name, TAGGED) for m in EXPRESSION.finditer(line) for s, e, name in tagged(m)]
        kept: list[tuple[int, int, str, int]] = []
        reach: list[tuple[int, int]] = []
        for s, e, label, priority in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
            if not contained(reach, s, e):
                kept.append((s, e, label, priority))
                add_interval(reach, s, e)
        if wide and kept:  # back to places in the text
            after = np.array([e for _, e in wide])
            lost = np.cumsum([e - s - 1 for s, e in wide])
            at = after - lost  # the place in the line of what follows each run
            back = lambda p: p + (int(lost[k - 1]) if (k := int(np.searchsorted(at, p, "right"))) else 0)
            kept = [(back(s), back(e - 1) + 1, label, priority) for s, e, label, priority in kept]
        return sorted(kept)

    def base(self, text: str) -> tuple[int, list[tuple[int, str]]]:
        """The number of words, and each place of a base phrase as (first word, label)."""
        spaced = text.encode("utf-8", "replace").translate(WORD_BYTES)
        words = spaced.split()
        places = []
        if b"license" in spaced or b"cc" in spaced:
            line = b" " + b" ".join(words) + b" "
            for phrase, label in BASE_PHRASES.items():
                want, at, counted, word = f" {phrase} ".encode(), -1, 0, -1
                while (at := line.find(want, at + 1)) >= 0:
                    word += line.count(b" ", counted, at + 1)
                    counted = at + 1
                    places.append((word, label))
        return len(words), places


def contained(reach: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether [s, e) lies in one of the kept intervals, of which none holds another, in order of start."""
    i = bisect_right(reach, (s, float("inf"))) - 1
    return i >= 0 and reach[i][1] >= e


def add_interval(reach: list[tuple[int, int]], s: int, e: int) -> None:
    """Add an interval that none holds, and drop those that it holds."""
    i = j = bisect_left(reach, (s, e))
    while j < len(reach) and reach[j][1] <= e:
        j += 1
    reach[i:j] = [(s, e)]


SCHEMA = (
    "doc_id long, n_words long, base array<struct<word:long,label:string>>, "
    "detections array<struct<start:int,end:int,label:string,priority:int,confidence:double>>"
)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its words, the places of base phrases, and the detections that no other suppresses.

    Offsets count code points. A null text is an empty one (no words, nothing
    found); rows with null or repeated doc_ids stay rows of their own; other
    columns are left out. A detection that lies inside a kept one is dropped, so
    equal spans keep the first by priority, length, start and label.
    """
    small_batches(df.sparkSession)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scanner = Scanner()
        kind = pa.struct([("word", pa.int64()), ("label", pa.string())])
        found_kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64())])

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, base, found = [], [], []
            for t in batch.column(1).to_pylist():
                words, places = scanner.base(t or "")
                n.append(words)
                base.append([{"word": w, "label": x} for w, x in sorted(places)])
                found.append([{"start": s, "end": e, "label": label, "priority": p, "confidence": min(0.99, p / 100)} for s, e, label, p in scanner.detections(t or "")])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(base, pa.list_(kind)), pa.array(found, pa.list_(found_kind))], ["doc_id", "n_words", "base", "detections"]
            )

        return run

    return map_batches(id_text(df, id_col, text_col), SCHEMA, make)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and labels of all documents, with the labels that the rules add."""
    found = scan_licenses(documents(spark, sf_dir))
    distinct = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    best = F.array_max(F.col("detections.confidence"))  # priorities by their hundredth
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.word")).alias("first_word"),
        F.array_max(F.col("base.word")).alias("last_word"),
        distinct(F.col("base.label")).alias("base_labels"),
        distinct(F.col("base.label"), F.col("detections.label")).alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.8)).otherwise(F.lit(0.0))).alias("score"),
    )
