"""Language-model scores by a weighted backoff automaton.

States are the empty history and every word of the training texts. An arc leads
from a word's state over each pair of words that occurs MIN_COUNT times or more
and carries its discounted, interpolated log-probability; a failure arc leads to
the empty state, whose arcs are the smoothed words, and carries the backoff
weight. One pass from left to right carries the state and adds up the weights.
All words and pairs of the corpus are counted, so the automaton grows with it.

The automaton is never in one place. Texts are written as numbers in parts of a
few megabytes; each part sends its different pairs and words to buckets by their
hashes, with its counts; a bucket adds up what all parts sent and answers each
part in the order of its question. So a part gets just the slice of the automaton that its
texts walk on. What is sent are packs of numbers, one for each part and bucket.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, small_batches
from sparkloom.llm.toxicity import remainder
from sparkloom.storage import Workspace

#: Occurrences in the training texts that make an arc of a pair, and what is taken off each arc's count.
MIN_COUNT, DISCOUNT = 2, 0.5
#: Text of a part (a longer document is a part of its own), and buckets for each shuffle partition.
PART_BYTES, BUCKETS_EACH = 8 << 20, 2
#: Kinds of packs: the texts of a part, pairs, words, and sums over the arcs of a state.
TEXTS, PAIRS, WORDS, SUMS = range(4)
PARTS = "part long, texts binary, docs array<long>"
PACKS = "kind int, part long, bucket int, data binary, docs array<long>, n long, kinds long"
NAMES = ["kind", "part", "bucket", "data", "docs", "n", "kinds"]
TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64()]


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, cut at ASCII white space only."""
    return (text or "").encode("utf-8", "replace").lower().split()


def squeeze(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays as one compressed pack."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + zstandard.ZstdCompressor(level).compress(b"".join(parts))


def spread(pack: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", pack)
    sizes = struct.unpack_from(f"<{n}Q", pack, 4)
    data, out, at = zstandard.ZstdDecompressor().decompress(pack[4 + 8 * n :], max_output_size=max(1, sum(sizes))), [], 0
    for s in sizes:
        out.append(data[at : at + s])
        at += s
    return out


def packs(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], NAMES)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) * np.uint64(0x9E3779B97F4A7C15) + second)


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Walk:
    """The tokens of a part: words by number (0 ends a document, and so stands before the next), their hashes, their pairs."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, buckets: int) -> None:
        self.ids, self.hashes = ids, hashes
        self.state = np.append(0, ids[:-1]).astype(np.int64) if len(ids) else ids.astype(np.int64)
        keys, self.pair = np.unique(self.state * len(hashes) + ids, return_inverse=True)
        self.first, self.second = np.divmod(keys, max(1, len(hashes)))
        bucket = (pair_hash(hashes[self.first], hashes[self.second]) >> np.uint64(20)) % np.uint64(buckets)
        self.by_bucket, self.pair_cuts = grouped(bucket, buckets)
        self.words_by_bucket, self.word_cuts = grouped(word_bucket(hashes, buckets), buckets)


def word_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(20)) % np.uint64(buckets)


def grouped(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes in order of bucket, and where each bucket's begin."""
    o = np.argsort(bucket, kind="stable")
    return o, np.searchsorted(bucket[o], np.arange(buckets + 1, dtype=np.uint64))


def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, train) to parts: the texts as numbers of words, their lengths, whether they teach, and the words."""
    made = 0
    docs: list[int | None] = []
    numbers, flat, lengths, learnt, size = Numbers({b"": 0}), [], [], [], 0

    def close() -> pa.RecordBatch:
        texts = squeeze(np.concatenate(flat).astype("<i4"), np.array(lengths, "<i8"), np.array(learnt, "u1"), b"\n".join(numbers), level=3)
        cols = [[(TaskContext.get().partitionId() << 32) + made], [texts], [docs]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.list_(pa.int64())))], ["part", "texts", "docs"])

    for b in batches:
        for doc, text, train in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            tokens = words_of(text.as_py())
            flat.append(np.array([*map(numbers.__getitem__, tokens), 0], np.int64))
            docs.append(doc)
            lengths.append(len(tokens) + 1)
            learnt.append(train)
            size += 1 + len(text.as_py() or "")
            if size >= PART_BYTES:
                yield close()
                made += 1
                docs, numbers, flat, lengths, learnt, size = [], Numbers({b"": 0}), [], [], [], 0
    if docs:
        yield close()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def read_part(texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The tokens of a part by number, its documents' lengths, whether each token teaches, and the words."""
    ids, lengths, learnt, words = spread(texts)
    lengths = np.frombuffer(lengths, "<i8")
    return np.frombuffer(ids, "<i4").astype(np.int64), lengths, np.repeat(np.frombuffer(learnt, "u1") > 0, lengths), words.split(b"\n")


def ask_pairs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Parts (part, texts) to a pack of pairs for each bucket, with their training counts."""
    for b in batches:
        for part, texts in zip(b.column(0).to_pylist(), b.column(1)):
            ids, _, teaches, words = read_part(texts.as_py())
            walk = Walk(ids, hashes_of(words), buckets)
            counts = np.bincount(walk.pair[teaches], minlength=len(walk.first))
            for k in range(buckets):
                p = walk.by_bucket[walk.pair_cuts[k] : walk.pair_cuts[k + 1]]
                if len(p):
                    yield packs([(PAIRS, part, k, squeeze(walk.hashes[walk.first[p]], walk.hashes[walk.second[p]], counts[p].astype("<i8")), None, None, None)])


def ask_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Parts (part, texts) to a pack of words for each bucket, with their training counts."""
    for b in batches:
        for part, texts in zip(b.column(0).to_pylist(), b.column(1)):
            ids, _, teaches, words = read_part(texts.as_py())
            counts = np.bincount(ids[teaches], minlength=len(words)).astype("<i8")
            by_bucket, cuts = grouped(word_bucket(hashes_of(words), buckets), buckets)
            for k in range(buckets):
                w = by_bucket[cuts[k] : cuts[k + 1]]
                if len(w):
                    yield packs([(WORDS, part, k, squeeze(b"\n".join([words[x] for x in w]), counts[w]), None, None, None)])


def by_key(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[dict]]]:
    """Rows in order of a column, those of one value together."""
    held: list[dict] = []
    for b in batches:
        for k in range(b.num_rows):
            row = {n: b.column(i)[k].as_py() for i, n in enumerate(NAMES[:5])}
            if held and row[NAMES[column]] != held[0][NAMES[column]]:
                yield held[0][NAMES[column]], held
                held = []
            held.append(row)
    if held:
        yield held[0][NAMES[column]], held


def summed(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry the sum of n over its equals; one entry of each kind; the sums of these."""
    h = pair_hash(first, second)
    o = np.argsort(h)
    new = lambda: np.append(True, (first[o][1:] != first[o][:-1]) | (second[o][1:] != second[o][:-1]))
    cut = new()
    if (cut[1:] & (h[o][1:] == h[o][:-1])).any():  # different pairs with one hash
        o = np.lexsort((second, first))
        cut = new()
    at = np.flatnonzero(cut)
    sums = np.add.reduceat(n[o], at)
    out = np.empty(len(n), np.int64)
    out[o] = np.repeat(sums, np.diff(np.append(at, len(n))))
    return out, o[at], sums


def answer_pairs(batches: Iterator[pa.RecordBatch], buckets: int, least: int, discount: float) -> Iterator[pa.RecordBatch]:
    """Packs of pairs in order of bucket to their counts (0 for those without an arc) in the same order, and what the arcs of each state add up to."""
    for bucket, rows in by_key(batches, 2):
        parts = [spread(r["data"]) for r in rows]
        first, second, n = (np.concatenate([np.frombuffer(p[k], t) for p in parts]) for k, t in ((0, "<u8"), (1, "<u8"), (2, "<i8")))
        sums, kinds, of_kind = summed(first, second, n)
        sums[sums < least] = 0
        out, at = [], 0
        for r, p in zip(rows, parts):
            size = len(p[2]) // 8
            out.append((PAIRS, r["part"], bucket, squeeze(sums[at : at + size].astype("<i8")), None, None, None))
            at += size
        arcs = of_kind >= least
        state, which = np.unique(first[kinds[arcs]], return_inverse=True)
        mass = np.bincount(which, of_kind[arcs] - discount, len(state))
        o, cuts = grouped(word_bucket(state, buckets), buckets)
        for k in range(buckets):
            if cuts[k] < cuts[k + 1]:
                mine = o[cuts[k] : cuts[k + 1]]
                out.append((SUMS, None, k, squeeze(state[mine], mass[mine]), None, None, None))
        yield packs(out)


def answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of words and of sums in order of bucket to counts and sums of the words in the same order, and totals."""
    for bucket, rows in by_key(batches, 2):
        number = Numbers()
        asked, counts = [], []
        states, masses = [np.zeros(0, np.uint64)], [np.zeros(0)]
        for r in rows:
            a, n = spread(r["data"])
            if r["kind"] == SUMS:
                states.append(np.frombuffer(a, "<u8"))
                masses.append(np.frombuffer(n, "<f8"))
            else:
                asked.append((r["part"], np.array([number[w] for w in a.split(b"\n")], np.int64)))
                counts.append(np.frombuffer(n, "<i8"))
        total = np.zeros(len(number), np.int64)
        for (_, ids), n in zip(asked, counts):
            np.add.at(total, ids, n)
        state, which = np.unique(np.concatenate(states), return_inverse=True)
        mass = np.bincount(which, np.concatenate(masses), len(state))
        hashes = hashes_of(list(number))
        at = np.minimum(np.searchsorted(state, hashes), max(0, len(state) - 1))
        arcs = np.where(state[at] == hashes, mass[at], 0.0) if len(state) else np.zeros(len(hashes))
        out = [(WORDS, part, bucket, squeeze(total[ids], arcs[ids]), None, None, None) for part, ids in asked]
        yield packs([*out, (WORDS, None, bucket, None, None, int(total.sum()), int((total > 0).sum()))])


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def traverse(walk: Walk, counts: np.ndarray, words: np.ndarray, arcs: np.ndarray, total: int, kinds: int, discount: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known words, base and model log-probabilities of each token, read from left to right.

    The state before a token is that of the word before it, so the states of all tokens of a part are carried as one vector.
    """
    empty = np.log10(words + 0.5) - np.log10(total + 0.5 * (kinds + 1))  # arcs of the empty state
    share = np.divide(arcs, words, out=np.zeros(len(words)), where=words > 0)
    fail = np.log10(np.maximum(1e-300, 1 - share))  # weights of the failure arcs
    at, to = walk.first, walk.second
    with np.errstate(divide="ignore"):
        arc = np.log10(np.maximum(0.0, counts - discount) / np.maximum(1, words[at]) + 10 ** (fail[at] + empty[to]))
    step = np.where(counts > 0, arc, fail[at] + empty[to])
    return words[walk.ids] > 0, empty[walk.ids], step[walk.pair]


def score_parts(batches: Iterator[pa.RecordBatch], buckets: int, total: int, kinds: int, discount: float) -> Iterator[pa.RecordBatch]:
    """A part's texts and answers, in order of part and kind, to the scores of its documents."""
    for _, rows in by_key(batches, 1):
        texts = next(r for r in rows if r["kind"] == TEXTS)
        ids, lengths, _, vocabulary = read_part(texts["data"])
        walk = Walk(ids, hashes_of(vocabulary), buckets)
        counts, words, arcs = np.zeros(len(walk.first), np.int64), np.zeros(len(walk.hashes), np.int64), np.zeros(len(walk.hashes))
        for r in rows:
            k = r["bucket"]
            if r["kind"] == PAIRS:
                counts[walk.by_bucket[walk.pair_cuts[k] : walk.pair_cuts[k + 1]]] = np.frombuffer(spread(r["data"])[0], "<i8")
            elif r["kind"] == WORDS:
                mine, (n, mass) = walk.words_by_bucket[walk.word_cuts[k] : walk.word_cuts[k + 1]], spread(r["data"])
                words[mine], arcs[mine] = np.frombuffer(n, "<i8"), np.frombuffer(mass, "<f8")
        known, base, score = traverse(walk, counts, words, arcs, total, kinds, discount)
        starts = np.cumsum(lengths) - lengths
        cols = [pa.array(texts["docs"], pa.int64()), pa.array(lengths), *(pa.array(np.add.reduceat(x, starts)) for x in (known.astype(np.int64), base, score))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def score_documents(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, discount: float = DISCOUNT) -> DataFrame:
    """Scores of each row by a model of the rows for which ``train`` (over doc_id) holds.

    Gives doc_id, n_tokens, n_known, train_tokens, base_score and score (log10).
    A null text is empty: its end is its one token. Rows with null or repeated
    ids stay rows of their own; a null ``train`` is false. Without training rows
    every token has probability 1. Other columns are left out. Pairs are told
    apart by two 64-bit hashes of their words, words by their bytes.
    """
    spark = df.sparkSession
    small_batches(spark)
    work = Workspace(spark, "lm")
    buckets = BUCKETS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))

    def in_order(rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(by[0]).sortWithinPartitions(*by)

    def mapped(rows: DataFrame, f: Callable[..., Iterator[pa.RecordBatch]], *args: object, schema: str = PACKS) -> DataFrame:
        return rows.mapInArrow(lambda b: f((x for x in b if x.num_rows), *args), schema)

    parts = work.put(mapped(docs, number, schema=PARTS), "parts")
    asked = mapped(parts.select("part", "texts"), ask_pairs, buckets)
    pairs = work.put(mapped(in_order(asked, "bucket", "part"), answer_pairs, buckets, min_count, discount), "pairs", by="kind")
    asked = mapped(parts.select("part", "texts"), ask_words, buckets).unionByName(pairs.where(F.col("kind") == SUMS))
    words = work.put(mapped(in_order(asked, "bucket", "kind", "part"), answer_words), "words")
    totals = words.where("part is null").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).first()
    total, kinds = totals["n"] or 0, totals["kinds"] or 0
    answers = pairs.where(F.col("kind") == PAIRS).unionByName(words.where("part is not null"))
    texts = parts.select(F.lit(TEXTS).alias("kind"), "part", F.lit(0).alias("bucket"), F.col("texts").alias("data"), "docs", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("kinds"))
    scored = mapped(in_order(texts.unionByName(answers), "part", "kind", "bucket"), score_parts, buckets, total, kinds, discount, schema=SCORES)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of four fifths of them."""
    held_out = remainder("doc_id", 5) == 1
    scored = score_documents(documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
