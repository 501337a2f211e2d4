"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment.

Seeds are ordered pairs of words that stand next to each other or one word apart.
An alignment that reaches the threshold has errors in so few places that a known
number of an item's words start such a pair in item and passage alike; so an item
may go without its most frequent seeds, as long as fewer are left out than must
match, and no pair over the threshold is lost. A passage that shares a seed with
an item is aligned with it word by word, so that edited copies score too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import annotate, documents, small_batches
from sparkloom.storage import Workspace

MATCH, MISMATCH, GAP = 2, -1, -1
#: An alignment counts from this share of the score that an exact copy of the item has.
THRESHOLD = 0.5
#: Words under which an item counts only where it stands whole, word after word.
SHORT = 4
#: Words of test items that are broadcast at once; a larger benchmark is taken in blocks.
BLOCK_WORDS = 2_000_000
#: Bytes of text that are hashed at once (a longer document is hashed whole).
CHUNK = 1 << 22

_rng = np.random.Generator(np.random.PCG64(7))
LETTER = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
PLACE = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of lower-cased UTF-8 bytes start, and a hash of each: runs of letters, digits and bytes over 127."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.concatenate([[False], IN_WORD[data], [False]])
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turn[::2], turn[1::2]
    if len(start) == 0:
        return start, np.zeros(0, np.uint64)
    at = np.flatnonzero(inside[1:-1])
    first = np.cumsum(end - start) - (end - start)
    place = np.arange(len(at)) - np.repeat(first, end - start)
    h = np.add.reduceat(LETTER[data[at]] * (PLACE[place & 63] + (place >> 6).astype(np.uint64) * np.uint64(2)), first)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return start, h ^ (h >> np.uint64(29))


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of words."""
    h = (first ^ (first >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + second
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def text_words(text: str) -> np.ndarray:
    return hashed_words(np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8))[1]


@dataclass
class Items:
    """Test items as hashed words, and their seeds; equal items are one class under their smallest id."""

    ids: list[int]
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted, one entry for each place of a seed
    item: np.ndarray
    place: np.ndarray
    single: bool  # whether there are items of one word

    def sieve(self) -> np.ndarray:
        table = np.zeros(1 << max(16, min(26, 5 + len(self.seeds).bit_length())), bool)
        table[(self.seeds & np.uint64(len(table) - 1)).astype(np.int64)] = True
        return table


def short(m: int, threshold: float) -> bool:
    return m < SHORT or threshold * m <= 1


def kept_starts(often: np.ndarray, threshold: float) -> np.ndarray:
    """Places of an item whose pairs are seeds, by how often each of its words occurs.

    With M matches and E errors an alignment scores 2M - E, at least 2tm for an item of m words; of its M - 1 steps
    from match to match at most M - tm have two errors or more. So ceil(tm) - 1 places at least start a pair that is
    at most one word apart on both sides, and all but that many less one of the m - 1 places are enough.
    """
    m = len(often)
    if short(m, threshold):
        return np.arange(1)
    after = often[1:] + np.append(often[2:], 0)
    keep = m - math.ceil(threshold * m - 1e-9) + 1
    return np.sort(np.argsort(often[:-1] * after, kind="stable")[:keep])


def seeded(ids: list[int], words: list[np.ndarray], often: list[np.ndarray], threshold: float) -> Items:
    seeds, item, place = [], [], []
    for k, (w, n) in enumerate(zip(words, often)):
        at = kept_starts(n.astype(float), threshold)
        for gap in (1, 2) if not short(len(w), threshold) else (min(1, len(w) - 1),):
            i = at[at + gap < len(w)]
            seeds.append(pairs(w[i], w[i + gap]))
            item.append(np.full(len(i), k))
            place.append(i)
    none = np.zeros(0, np.int64)
    s, i, p = (np.concatenate(x) if x else none for x in (seeds, item, place))
    o = np.lexsort((p, i, s))
    return Items(ids, words, s[o].astype(np.uint64), i[o], p[o], any(len(w) == 1 for w in words))


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words with linear gaps: the best score, and where its alignment ends and starts in b."""
    n = len(b)
    steps = np.arange(n + 1) * -GAP
    h, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, best_end, best_start = 0, 0, 0
    for x in a:
        diagonal = h[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = h + GAP
        new, begun = np.maximum(up, 0), np.where(up > 0, origin, np.arange(n + 1))
        better = diagonal > new[1:]
        new[1:], begun[1:] = np.where(better, diagonal, new[1:]), np.where(better, origin[:-1], begun[1:])
        # Gaps along b: the largest value to the left, less one step for each word between.
        lifted = new + steps
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(n + 1), 0))
        h, origin = reach - steps, begun[source]
        k = int(h.argmax())
        if h[k] > best:
            best, best_end, best_start = int(h[k]), k, int(origin[k])
    return best, best_end, best_start


def passages(start: np.ndarray, m: int, slack: int) -> Iterator[tuple[int, int]]:
    """The stretches of a document where an item of m words may lie, given where it would start by its seeds."""
    start = np.sort(start)
    cut = np.flatnonzero(np.diff(start) > m + 2 * slack)
    for s, e in zip(np.append(0, cut + 1), np.append(cut, len(start) - 1)):
        yield int(start[s]) - slack, int(start[e]) + m + slack


def hits_of(words: np.ndarray, places: np.ndarray, rows: np.ndarray, items: Items, threshold: float) -> list[dict]:
    """Items that one document holds, with the best alignment of each. places: where its seeds are; rows: which seeds."""
    out = []
    for k in np.unique(items.item[rows]):
        a = items.words[k]
        m, mine = len(a), items.item[rows] == k
        start = places[mine] - items.place[rows[mine]]
        best = (0, 0, 0)
        if short(m, threshold):
            for at in np.unique(start).tolist():
                if best[0] == 0 and at >= 0 and np.array_equal(words[at : at + m], a):
                    best = (MATCH * m, -at, at + m)
        else:
            for lo, hi in passages(start, m, math.ceil(2 * m * (1 - threshold))):
                lo, hi = max(0, lo), min(len(words), hi)
                b = words[lo:hi]
                # No alignment scores more than a match for each word that both have.
                if MATCH * np.isin(a, b).sum() < threshold * MATCH * m:
                    continue
                score, end, at = align(a, b)
                best = max(best, (score, -(lo + at), lo + end))
        if best[0] >= threshold * MATCH * m:
            out.append({"item_id": items.ids[k], "score": best[0] / (MATCH * m), "first_word": -best[1], "last_word": best[2] - 1, "seeds": int(mine.sum())})
    return sorted(out, key=lambda h: h["item_id"])


HITS = "array<struct<item_id:long,score:double,first_word:long,last_word:long,seeds:long>>"
KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("seeds", pa.int64())]))


def find_hits(texts: list[str | None], items: Items, sieve: np.ndarray, threshold: float) -> list[list[dict]]:
    out: list[list[dict]] = []
    k, mask = 0, np.uint64(len(sieve) - 1)
    while k < len(texts):
        parts, size = [], 0
        while k + len(parts) < len(texts) and (not parts or size < CHUNK):
            parts.append((texts[k + len(parts)] or "").lower().encode("utf-8", "replace"))
            size += len(parts[-1])
        starts = np.cumsum([0] + [len(p) + 1 for p in parts])
        at, words = hashed_words(np.frombuffer(b"\n".join(parts), np.uint8))
        first = np.searchsorted(at, starts)  # each document's first word
        found = []
        for gap in (0, 1, 2) if items.single else (1, 2):
            g = pairs(words[: max(0, len(words) - gap)], words[gap:])
            maybe = np.flatnonzero(sieve[(g & mask).astype(np.int64)])
            lo, hi = np.searchsorted(items.seeds, g[maybe], "left"), np.searchsorted(items.seeds, g[maybe], "right")
            maybe, lo, n = maybe[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            places = np.repeat(maybe, n)
            rows = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            doc = np.searchsorted(first[1:], places, "right")
            inside = places + gap < first[np.minimum(doc + 1, len(parts))]
            found.append((doc[inside], places[inside], rows[inside]))
        doc, places, rows = (np.concatenate(x) for x in zip(*found))
        o = np.lexsort((rows, places, doc))
        doc, places, rows = doc[o], places[o], rows[o]
        bounds = np.searchsorted(doc, np.arange(len(parts) + 1))
        for d in range(len(parts)):
            s, e = bounds[d], bounds[d + 1]
            out.append(hits_of(words[first[d] : first[d + 1]], places[s:e] - first[d], rows[s:e], items, threshold) if e > s else [])
        k += len(parts)
    return out


def classes(benchmark: DataFrame, work: Workspace) -> DataFrame:
    """item_id (the smallest of items with equal words), words (hashes) and often (how often each occurs in all items)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [text_words(t).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int64()))], ["item_id", "words"])

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    found = rows.mapInArrow(hashed, "item_id long, words array<long>").where("size(words) > 0")
    found = work.put(found.groupBy("words").agg(F.min("item_id").alias("item_id")), "classes")
    places = found.select("item_id", F.posexplode("words").alias("at", "word"))
    counts = places.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    often = places.join(counts, "word").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("often"))
    return work.put(found.join(often, "item_id").select("item_id", "words", F.col("often.n").alias("often")), "items")


def with_hits(df: DataFrame, benchmark: DataFrame, name: str = "hits", threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``df`` with the test items that each row holds, under ``name``: item, score, words from first to last, seeds found.

    Every item whose best alignment reaches the threshold is found. Items under
    SHORT words count only where they stand whole. Items with equal words are
    one class, named by its smallest id. Null and empty texts and items without
    words have no hits; null item ids are left out. All rows and columns of
    ``df`` stay, repeated ones too. The items are broadcast in blocks of about
    BLOCK_WORDS words, each a pass over the texts; what is found does not depend
    on the blocks. The name must be free.
    """
    spark = df.sparkSession
    small_batches(spark)
    items = classes(benchmark, Workspace(spark, "decontamination"))
    n = items.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-n // BLOCK_WORDS))
    names = [f"{name}_block{k}" for k in range(blocks)] if blocks > 1 else [name]
    for k, part in enumerate(names):
        df = with_block(df, items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k), part, threshold, text_col)
    return df if blocks == 1 else df.withColumn(name, F.array_sort(F.flatten(F.array(*names)))).drop(*names)


def with_block(df: DataFrame, items: DataFrame, name: str, threshold: float, text_col: str) -> DataFrame:
    found = items.orderBy("item_id").toArrow()
    arrays = lambda c, kind: [np.array(x, np.int64).view(kind) for x in found.column(c).to_pylist()]
    block = df.sparkSession.sparkContext.broadcast(seeded(found.column(0).to_pylist(), arrays(1, np.uint64), arrays(2, np.int64), threshold))

    def make() -> Callable[[list[str | None]], pa.Array]:
        sieve = block.value.sieve()
        return lambda texts: pa.array(find_hits(texts, block.value, sieve, threshold), KIND)

    return annotate(df, name, HITS, make, text_col)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and test item that it holds, whole or edited."""
    found = with_hits(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
