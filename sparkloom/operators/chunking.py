"""Chunks for search and batches for extraction: folds over one document each."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: Tokens of a chunk: wanted, at most, repeated from the chunk before, and at least.
TARGET, MOST, OVERLAP, LEAST = 256, 384, 48, 32
BOUNDARY = re.compile(r"(?<=[.!?。！？])\s+|\n{2,}")
BLOCK = re.compile(r"```.*?(?:```|\Z)|\$\$.*?(?:\$\$|\Z)", re.S)


def estimate(text: str) -> int:
    return max(1, len(text) // 4)


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence."""
    out, at = [], 0
    for m in BOUNDARY.finditer(text):
        if text[at : m.start()].strip():
            out.append((at, m.start()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def sentence_windows(text: str) -> list[tuple[int, int]]:
    """Start and end of each chunk.

    A chunk is closed before a sentence that would take it over MOST, and once
    it has TARGET tokens. The next one begins with the last sentences of up to
    OVERLAP tokens, the very last in any case. What is left at the end, if only
    that, is a chunk too, unless it has fewer than LEAST tokens: then it joins the
    chunk before.
    """
    found = sentences(text)
    total = list(accumulate((estimate(text[a:b]) for a, b in found), initial=0))
    out: list[tuple[int, int]] = []  # first and last sentence
    first = 0

    def close(last: int) -> int:
        out.append((first, last))
        return min(last, max(first, bisect_left(total, total[last + 1] - OVERLAP)))

    for i in range(len(found)):
        if i > first and total[i + 1] - total[first] > MOST:
            first = close(i - 1)
        if total[i + 1] - total[first] >= TARGET:
            first = close(i)
    if found:
        if out and total[-1] - total[first] < LEAST:
            out[-1] = (out[-1][0], len(found) - 1)
        else:
            out.append((first, len(found) - 1))
    return [(found[a][0], found[b][1]) for a, b in out]


def block_windows(text: str, size: int = 30_000, overlap: int = 2_500) -> list[tuple[int, int]]:
    """Windows of ``size`` characters that overlap; a fenced or $$ block at a window's end is taken whole."""
    if size <= 0:
        raise ValueError("size must be positive")
    blocks = [(m.start(), m.end()) for m in BLOCK.finditer(text)]
    inside = lambda p: next(((a, b) for a, b in blocks if a < p < b), None)
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text) and (b := inside(end)):
            end = b[0] if b[0] > start else b[1]
        out.append((start, end))
        if end >= len(text):
            break
        again = max(end - overlap, start + 1)
        if b := inside(again):
            again = b[1] if b[1] < end else b[0] if b[0] > start else end
        start = again
    return out


#: Rows of a batch that are Python's strings at once.
PIECE = 128


def chunks(df: DataFrame, id_col: str, text_col: str, cut=sentence_windows) -> DataFrame:  # noqa: ANN001
    """doc_id, chunk (from 0), start, text for each chunk of each row; null and blank texts have none."""
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, PIECE) for whole in batches for at in range(0, whole.num_rows, PIECE)):
            rows = [(d, i, s, t[s:e]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, (s, e) in enumerate(cut(t or ""))]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "chunk", "start", "text"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, chunk long, start long, text string")
