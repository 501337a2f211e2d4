"""Substring search in any script: segments of three-character grams with their places.

A gram is three code points in one number, the text's end padded, so that every
character starts a gram. Texts are cut into segments as they are read; a segment
keeps for each gram its places in all its texts, which are laid end to end. A
phrase is found from the gram that is rarest in the segment; grams that cover all
its characters, at the same distance from the start, make it exact. Texts are not
read again, and nothing is shuffled to build the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import Workspace

#: Bits of a code point, and what stands after the end: no character.
BITS, END = 21, 0x110000
#: Characters and texts of a segment (one text is never cut), and characters of phrases that are asked for together.
SEGMENT_CHARS, SEGMENT_DOCS, BLOCK_CHARS = 1 << 22, 1 << 16, 2_000_000
SCHEMA = "segment string, gram long, n long, steps binary, ids array<long>, starts array<long>"
#: The gram of the row that holds a segment's ids and starts.
DOCS = -1


@dataclass
class Grams:
    """segment, gram, n places and the steps from one to the next; one row of each segment has the ids and starts of its texts."""

    segments: DataFrame
    fold: bool


def codes(text: str | None, fold: bool) -> np.ndarray:
    text = text or ""
    return np.frombuffer((text.lower() if fold else text).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def grams_of(c: np.ndarray) -> np.ndarray:
    """The gram that starts at each character."""
    c = np.append(c, [END, END])
    return c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:]


def packed(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in one to four bytes of seven bits each, the eighth set where another follows, and where each number ends."""
    n = 1 + sum((steps >= 1 << 7 * k).astype(np.int64) for k in (1, 2, 3))
    ends = np.cumsum(n)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(4):
        m = n > k
        out[ends[m] - n[m] + k] = steps[m] >> 7 * k & 127 | (n[m] > k + 1) << 7
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(b < 128) + 1
    starts = np.append(0, ends[:-1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((b & 127) << 7 * place, starts)


def segment_rows(name: str, ids: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
    starts = np.cumsum([0] + [len(g) for g in grams])
    g = np.concatenate(grams)
    place = np.argsort(g, kind="stable")
    g = g[place]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    steps = np.diff(place, prepend=0)
    steps[first] = place[first]
    n = len(first)
    data, ends = packed(steps)
    # The last row, that of the ids, has no bytes.
    cuts = np.append(np.append(0, ends)[first], [len(data)] * 2).astype(np.int32)
    rows = pa.Array.from_buffers(pa.binary(), n + 1, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
    only_last = lambda values: pa.array([None] * n + [values], pa.list_(pa.int64()))
    sizes = np.append(np.diff(np.append(first, len(g))), len(ids))
    return pa.RecordBatch.from_arrays([pa.array([name] * (n + 1)), pa.array(np.append(g[first], DOCS)), pa.array(sizes), rows, only_last(ids), only_last(starts)], ["segment", "gram", "n", "steps", "ids", "starts"])


def build_grams(docs: DataFrame, work: Workspace, doc_id: str = "doc_id", text: str = "text", fold: bool = True) -> Grams:
    """Write the index of ``docs``; with ``fold``, case doesn't count. Null and empty texts hold nothing, rows without an id are left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        grams: list[np.ndarray] = []
        size = n = 0
        for b in batches:
            for doc, t in zip(b.column(0), b.column(1)):
                g = grams_of(codes(t.as_py(), fold))
                if ids and (size + len(g) > SEGMENT_CHARS or len(ids) == SEGMENT_DOCS):
                    yield segment_rows(f"{TaskContext.get().partitionId()}-{n}", ids, grams)
                    ids, grams, size, n = [], [], 0, n + 1
                ids.append(doc.as_py())
                grams.append(g)
                size += len(g)
        if ids:
            yield segment_rows(f"{TaskContext.get().partitionId()}-{n}", ids, grams)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text <> ''")
    return Grams(work.put(rows.mapInArrow(read, SCHEMA), "grams"), fold)


@dataclass
class Phrase:
    query: int
    size: int
    grams: list[int]
    offsets: list[int]

    @classmethod
    def of(cls, query: int, c: np.ndarray, often: dict[int, int]) -> Phrase:
        """The grams that cover the phrase and have the fewest places together; of one under three characters, its characters."""
        n = len(c)
        if n < 3:
            return cls(query, n, [int(c[0] if n == 1 else c[0] << BITS | c[1])], [0])
        g = grams_of(c)[: n - 2].tolist()
        # From the first gram to the last, no step over three characters.
        cost, before = [often.get(g[0], 0)], [-1]
        for k in range(1, n - 2):
            j = min(range(max(0, k - 3), k), key=cost.__getitem__)
            cost.append(cost[j] + often.get(g[k], 0))
            before.append(j)
        at = [n - 3]
        while before[at[-1]] >= 0:
            at.append(before[at[-1]])
        return cls(query, n, [g[k] for k in at], at)

    def starts(self, places: dict[int, np.ndarray]) -> np.ndarray:
        """Where the phrase begins, among the places of a segment's grams."""
        if self.size < 3:
            some = [p for g, p in places.items() if g >> BITS * (3 - self.size) == self.grams[0]]
            return np.sort(np.concatenate(some)) if some else np.zeros(0, np.int64)
        if any(g not in places for g in self.grams):
            return np.zeros(0, np.int64)
        rarest, *rest = sorted(zip(self.grams, self.offsets), key=lambda x: len(places[x[0]]))
        start = places[rarest[0]] - rarest[1]
        for g, offset in rest:
            p = places[g]
            k = np.minimum(np.searchsorted(p, start + offset), len(p) - 1)
            start = start[p[k] == start + offset]
            if not len(start):
                break
        return start


def holding(index: Grams, phrases: DataFrame) -> DataFrame:
    """query_id, doc_id, places (how often, overlaps too) and first (the first place, from 0) of documents that hold a phrase (query_id, phrase).

    An empty or null phrase is held by nothing. Rows of one doc_id count
    together. Phrases go in blocks of about BLOCK_CHARS characters, each a pass
    over the index.
    """
    spark = phrases.sparkSession
    asked = phrases.select(F.col("query_id").cast("long").alias("query_id"), F.col("phrase").cast("string").alias("phrase")).where("query_id is not null and phrase <> ''").distinct()
    blocks = max(1, -(-(asked.agg(F.sum(F.length("phrase")).alias("n")).first()["n"] or 0) // BLOCK_CHARS))
    out = spark.createDataFrame([], "query_id long, doc_id long, places long, first long")
    for b in range(blocks):
        block = [(r["query_id"], codes(r["phrase"], index.fold)) for r in asked.where(F.pmod(F.xxhash64("query_id", "phrase"), F.lit(blocks)) == b).collect()]
        all_ = {g for _, c in block if len(c) > 2 for g in grams_of(c)[:-2].tolist()}
        named = F.broadcast(spark.createDataFrame([(g,) for g in sorted(all_)], "gram long"))
        often = dict(index.segments.select("gram", "n").join(named, "gram").groupBy("gram").agg(F.sum("n")).collect()) if all_ else {}
        out = out.unionByName(held_block(index, [Phrase.of(q, c, often) for q, c in block]))
    return out.groupBy("query_id", "doc_id").agg(F.sum("places").alias("places"), F.min("first").alias("first"))


def held_block(index: Grams, block: list[Phrase]) -> DataFrame:
    spark = index.segments.sparkSession
    shared = spark.sparkContext.broadcast(block)
    # A block is bounded, and so are its grams.
    rows = None
    segments = index.segments.drop("n")
    for size in (3, 1, 2):
        wanted = {g for p in block if min(p.size, 3) == size for g in p.grams} | ({DOCS} if size == 3 else set())
        if not wanted:
            continue
        keys = spark.createDataFrame([(g,) for g in sorted(wanted)], "key long")
        some = segments.withColumn("key", F.shiftright("gram", BITS * (3 - size))).join(F.broadcast(keys), "key").drop("key")
        rows = some if rows is None else rows.unionByName(some)

    def search(group: pa.Table) -> pa.Table:
        grams, steps = group.column("gram").to_numpy(), group.column("steps").to_pylist()
        places = {int(g): np.cumsum(unpacked(steps[i])) for i, g in enumerate(grams) if g != DOCS}
        row = int(np.flatnonzero(grams == DOCS)[0])
        ids, starts = (np.asarray(group.column(c)[row].as_py()) for c in ("ids", "starts"))
        found: list[np.ndarray] = []
        for p in shared.value:
            start = p.starts(places)
            if len(start):
                doc = np.searchsorted(starts, start, "right") - 1
                of, first, n = np.unique(doc, return_index=True, return_counts=True)
                found.append(np.stack([np.full(len(of), p.query), ids[of], n, start[first] - starts[of]]))
        cols = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], names=["query_id", "doc_id", "places", "first"])

    return rows.groupBy("segment").applyInArrow(search, "query_id long, doc_id long, places long, first long")
