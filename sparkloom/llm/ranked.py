"""Ranked lexical search: for each item the documents of highest score, by inverted treaps.

Documents are cut into segments as they are read; a segment is a row with its
postings. Counts of all segments give the weights. Then each segment is searched
on its own: every term has a treap over its postings, in search order by document
and in heap order by impact, so that the root of a subtree has the greatest impact
of its range of documents. A search holds a range of documents and, for each of its terms, the
topmost node in that range. The weighted impacts of these nodes add up to a
bound; a range whose bound is under the k-th score so far is dropped with all its
subtrees, others are split at the document of their strongest node. Ranges of a
few documents are scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import documents
from sparkloom.storage import Workspace

#: Documents and postings of a segment; documents of a range that is scored whole; searches that run together; terms of items in one pass over the texts.
SEGMENT_DOCS, SEGMENT_POSTINGS, LEAF, TOGETHER, BLOCK_TERMS = 8192, 1 << 19, 16, 64, 1_000_000
#: Part of the results that one task ranks first, before all of an item's are ranked.
PARTS = 256

#: Letters, digits and all beyond ASCII make terms; A to Z are lower-cased.
AS_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SEGMENT = "n_docs long, n_terms long, docs array<long>, sizes array<long>, terms array<int>, ends array<int>, at array<int>, tf array<int>"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(AS_TERM).split()


def segments_of(batches: Iterator[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text as bytes) to segments with the postings of known terms."""
    held: list[tuple[int | None, int, list[int], list[int]]] = []
    count = postings = 0

    def row() -> pa.RecordBatch:
        # By id, null last; documents without terms are in no posting.
        some = sorted((d for d in held if d[2]), key=lambda d: (d[0] is None, d[0] or 0))
        term = np.array([t for d in some for t in d[2]], np.int32)
        tf = np.array([f for d in some for f in d[3]], np.int32)
        at = np.repeat(np.arange(len(some), dtype=np.int32), [len(d[2]) for d in some])
        o = np.argsort(term, kind="stable")
        named, starts = np.unique(term[o], return_index=True)
        ends = np.append(starts[1:], len(o)) if len(named) else starts
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        cols = [
            pa.array([sum(d[1] > 0 for d in held)]), pa.array([sum(d[1] for d in held)]), one([d[0] for d in some], pa.int64()), one([d[1] for d in some], pa.int64()),
            one(named, pa.int32()), one(ends.astype(np.int32), pa.int32()), one(at[o], pa.int32()), one(tf[o], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["n_docs", "n_terms", "docs", "sizes", "terms", "ends", "at", "tf"])

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = terms_of(text.as_py())
            found = [(known[t], n) for t, n in Counter(words).items() if t in known]
            held.append((doc, len(words), [t for t, _ in found], [n for _, n in found]))
            count, postings = count + 1, postings + len(found)
            if count >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                yield row()
                held, count, postings = [], 0, 0
    if held:
        yield row()


@dataclass
class Treaps:
    """The treaps of a segment's terms: nodes are postings, the last one stands for none. ``doc`` is a place in the segment."""

    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: np.ndarray


def treaps(doc: np.ndarray, impact: np.ndarray, ends: np.ndarray) -> Treaps:
    """Build all treaps level by level: the node of a run of postings is that of the greatest impact, of equal ones that of the greatest hash.

    The hash keeps runs of equal impacts from becoming lists: depth is logarithmic on average.
    """
    n = len(doc)
    none = n
    place = np.arange(n, dtype=np.int64)
    mixed = (place * 2654435761 + 12345) * 40503 >> 7 & 0xFFFFF
    key = impact << 43 | mixed << 23 | place
    left, right = np.full(n + 1, none, np.int32), np.full(n + 1, none, np.int32)
    starts = np.append(0, ends[:-1]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    lo, hi = starts, ends.astype(np.int64)
    roots = parents = side = None
    padded = np.append(key, -1)
    while len(lo):
        cuts = np.stack([lo, hi], axis=1).ravel()
        top = np.maximum.reduceat(padded, cuts)[::2] & ((1 << 23) - 1)
        if roots is None:
            roots = top.astype(np.int32)
        else:
            left[parents[~side]] = top[~side]
            right[parents[side]] = top[side]
        lo, hi = np.concatenate([lo, top + 1]), np.concatenate([top, hi])
        parents, side = np.concatenate([top, top]), np.arange(2 * len(top)) >= len(top)
        some = lo < hi
        o = np.flatnonzero(some)[np.argsort(lo[some], kind="stable")]
        lo, hi, parents, side = lo[o], hi[o], parents[o], side[o]
    return Treaps(np.append(doc, -1).astype(np.int32), np.append(impact, 0), left, right, roots if roots is not None else np.zeros(0, np.int32))


def topmost(t: Treaps, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The topmost node from each node down whose document lies in [lo, hi)."""
    none = len(t.doc) - 1
    node = node.copy()
    open_ = np.flatnonzero(node != none)
    while len(open_):
        x = node[open_]
        d = t.doc[x]
        low, high = d < lo[open_], d >= hi[open_]
        out = low | high
        open_ = open_[out]
        node[open_] = np.where(low[out], t.right[x[out]], t.left[x[out]])
        open_ = open_[node[open_] != none]
    return node


@dataclass
class Searches:
    """Searches that run together: term numbers and weights (weight times how often the item has the term), padded with term -1 and weight 0."""

    terms: np.ndarray
    weights: np.ndarray


class Segment:
    """A segment's postings with impacts: as treaps, and by document for exact scores."""

    def __init__(self, row: dict, n: int, length: int) -> None:
        self.docs, self.terms = row["docs"], row["terms"]
        self.at, ends = row["at"].astype(np.int64), row["ends"]
        m = 25 + 75 * row["sizes"] * n // max(1, length)
        tf = row["tf"].astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.at])
        self.treaps = treaps(self.at, self.impact, ends)
        self.term = np.repeat(np.arange(len(self.terms)), np.diff(np.append(0, ends)))
        self.by_doc = np.argsort(self.at, kind="stable")
        self.first = np.searchsorted(self.at[self.by_doc], np.arange(len(self.docs) + 1))

    def scores(self, doc: np.ndarray, search: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of documents under searches; ``weight`` is (searches, terms of the segment)."""
        size = self.first[doc + 1] - self.first[doc]
        ends = np.cumsum(size)
        p = self.by_doc[np.repeat(self.first[doc] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        part = weight[np.repeat(search, size), self.term[p]] * self.impact[p]
        return np.add.reduceat(part, ends - size) if len(doc) else np.zeros(0, np.int64)  # every document here has a posting

    def best(self, asked: Searches, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """search, document (place) and score of the k best of each search: highest first, ties to the earlier place."""
        t, n = self.treaps, len(asked.terms)
        none = len(t.doc) - 1
        found = np.searchsorted(self.terms, asked.terms)
        found[found == len(self.terms)] = 0
        here = self.terms[found] == asked.terms
        weight = np.zeros((n, len(self.terms)), np.int64)
        s, j = np.nonzero(here)
        weight[s, found[s, j]] = asked.weights[s, j]
        node = np.where(here, t.roots[found], none)
        search, lo, hi = np.arange(n), np.zeros(n, np.int64), np.full(n, len(self.docs))
        least = np.ones(n, np.int64)
        kept = (np.zeros(0, np.int64),) * 3
        while len(search):
            bound = (t.impact[node] * asked.weights[search]).sum(axis=1)
            may = bound >= least[search]
            leaf = may & (hi - lo <= LEAF)
            size = (hi - lo)[leaf]
            doc = np.repeat(lo[leaf] - np.cumsum(size) + size, size) + np.arange(size.sum())
            by = np.repeat(search[leaf], size)
            go = may & ~leaf
            node, search, lo, hi = node[go], search[go], lo[go], hi[go]
            strongest = np.argmax(t.impact[node] * asked.weights[search], axis=1)
            cut = t.doc[node[np.arange(len(node)), strongest]].astype(np.int64)
            doc, by = np.concatenate([doc, cut]), np.concatenate([by, search])
            kept = self.top(*(np.concatenate(x) for x in zip(kept, (by, doc, self.scores(doc, by, weight)))), k)
            enough = np.bincount(kept[0], minlength=n) >= k
            lowest = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(lowest, kept[0], kept[2])
            least = np.where(enough, lowest, 1)
            # Each range goes on left and right of the document that cut it.
            width = node.shape[1]
            both, search = np.concatenate([node, node]), np.concatenate([search, search])
            lo, hi = np.concatenate([lo, cut + 1]), np.concatenate([cut, hi])
            some = lo < hi
            both, search, lo, hi = both[some], search[some], lo[some], hi[some]
            node = topmost(t, both.ravel(), np.repeat(lo, width), np.repeat(hi, width)).reshape(-1, width)
        return kept

    def top(self, search: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        o = np.flatnonzero(score > 0)
        o = o[np.lexsort((doc[o], -score[o], search[o]))]
        search, doc, score = search[o], doc[o], score[o]
        keep = np.arange(len(search)) - np.searchsorted(search, search) < k
        return search[keep], doc[keep], score[keep]


def items_of(items: DataFrame, work: Workspace) -> DataFrame:
    """item_id, text, terms (with how often each occurs) of the different items that have terms; equal rows are one item."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(terms_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))], ["item_id", "terms", "times"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).distinct()
    found = rows.mapInArrow(read, "item_id long, terms array<binary>, times array<long>").where("size(terms) > 0")
    return work.put(found.withColumn("item", F.xxhash64("item_id", "terms", "times")), "items")


def weight_of(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search_block(docs: DataFrame, asked: list, k: int, work: Workspace, name: str) -> DataFrame:
    """The k best documents of every item of a block in each segment: item (its number in the block), segment, doc_id, score."""
    context = docs.sparkSession.sparkContext
    known = {t: i for i, t in enumerate(sorted({t for r in asked for t in r["terms"]}))}
    shared = context.broadcast(known)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    segments = rows.mapInArrow(lambda b: segments_of(b, shared.value), SEGMENT)
    segments = work.put(segments.withColumn("segment", F.monotonically_increasing_id()), f"{name}-segments")
    total = segments.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l"), F.count(F.lit(1)).alias("segments")).first()
    n, length = total["n"] or 0, total["l"] or 0
    sizes = F.transform("ends", lambda e, i: F.struct(F.element_at("terms", i + 1).alias("term"), (e - F.when(i > 0, F.element_at("ends", F.greatest(i, F.lit(1)))).otherwise(0)).alias("n")))
    df = dict(segments.select(F.explode(sizes).alias("t")).groupBy("t.term").agg(F.sum("t.n").alias("n")).collect())
    weights = {t: weight_of(n, df.get(i, 0)) for t, i in known.items()}
    groups = []
    for s in range(0, len(asked), TOGETHER):
        part = asked[s : s + TOGETHER]
        width = max(len(r["terms"]) for r in part)
        terms, w = np.full((len(part), width), -1, np.int64), np.zeros((len(part), width), np.int64)
        for i, r in enumerate(part):
            terms[i, : len(r["terms"])] = [known[t] for t in r["terms"]]
            w[i, : len(r["terms"])] = [weights[t] * c for t, c in zip(r["terms"], r["times"])]
        groups.append(Searches(terms, w))
    ready = context.broadcast(groups)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].values for c in ("docs", "sizes", "terms", "ends", "at", "tf")}
                ids = row.pop("docs")
                row = {c: v.to_numpy(zero_copy_only=False) for c, v in row.items()} | {"docs": np.arange(len(ids))}
                if not len(row["terms"]):
                    continue
                segment = Segment(row, n, length)
                for g, group in enumerate(ready.value):
                    item, doc, score = segment.best(group, k)
                    yield pa.RecordBatch.from_arrays([pa.array(item + g * TOGETHER), pa.array(np.full(len(item), b.column("segment")[i].as_py())), ids.take(pa.array(doc)), pa.array(score)], ["item", "segment", "doc_id", "score"])

    # Segments go to as many tasks as there are, since a search costs more than reading.
    spread = segments.repartition(max(1, min(total["segments"], 4 * context.defaultParallelism + total["segments"] // 4)), "segment")
    return spread.mapInArrow(search, "item long, segment long, doc_id long, score long")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k documents of highest score for each item.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns don't
    matter. Scores are those of whole texts over counts of all documents; equal
    scores go by ascending doc_id, null last. Null and empty texts have no terms;
    documents and items without terms are in no result. Each row of ``docs`` is a
    document, repeated ones too; equal rows of ``items`` are one item. Items go in
    blocks of about ``block_terms`` terms, each a pass over the texts.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    work = Workspace(docs.sparkSession, "ranked")
    asked = items_of(items, work)
    size = asked.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_terms))
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod("item", F.lit(blocks)) == b).orderBy("item_id", "item").collect()
        ids = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)], "item long, item_id long")
        found = search_block(docs, part, k, work, f"block{b}")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", F.pmod(F.xxhash64("segment"), F.lit(PARTS))).orderBy(*order))).where(F.col("rank") <= k)
        best = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        best = best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring documents for each test item."""
    return ranked_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


RANKED_SQL = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
tokens AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id), corpus AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM sizes),
postings AS (SELECT term, doc_id, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(corpus.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, corpus GROUP BY term),
scores AS (SELECT item_id, p.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * s.n * corpus.n) // corpus.l)))) AS BIGINT) AS score
  FROM asked JOIN postings p USING (term) JOIN weights USING (term) JOIN sizes s ON s.doc_id = p.doc_id, corpus GROUP BY ALL),
ranks AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranks WHERE rank <= 10"""
