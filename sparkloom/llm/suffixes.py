"""Removal of repeated passages by sorting sampled suffixes.

Every window of WINDOW bytes is assigned to one suffix inside it: the one whose
first GRAM bytes hash least. Equal windows get equal suffixes at equal places,
so it is enough to sort these suffixes, about one in 38; with each go the bytes
of all windows assigned to it. Sampled splitters deal the suffixes out by their
leading bytes into ranges. In a range a multikey quicksort puts them in order by
their bytes, and windows of suffixes that begin alike are compared. Windows that
may go on beyond a splitter, because they share its leading bytes as far as they
reach, are compared across the ranges afterwards.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import documents, map_batches, small_batches
from sparkloom.storage import Workspace

WINDOW, GRAM = 100, 32
#: Bytes before a suffix that its windows may reach.
LEFT = WINDOW - GRAM
#: Bytes of text that are hashed at once, and whose suffixes leave a task together.
CHUNK, FLUSH = 1 << 20, 1 << 22
#: Text of a range on average, ranges for each shuffle partition at least, and splitters (100 bytes each) at most.
RANGE_BYTES, PER_PARTITION, MOST_SPLITTERS = 8 << 20, 4, 200_000
#: Documents sampled for each splitter (SAMPLED at least), and suffixes of them.
SAMPLED, DOCS_EACH, KEYS_EACH = 2000, 2, 10
#: Suffixes of a range after which equal ones are joined before more are read.
HELD = 400_000
#: A suffix as a row of bytes: from its start to its last window's end, before its start, and where its windows lie.
RIGHT_AT, LEFT_AT, PLACE_AT, ROW = 0, 104, 176, 184
WORDS, GRAM_WORDS = ROW // 8, GRAM // 8

_rng = np.random.Generator(np.random.PCG64(20240229))
TABLE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64, for a chunk."""
    if not _powers:
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.ones(CHUNK + 1, np.uint64)
            p[1:] = np.uint64(b)
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of a batch (order key, text) in chunks: bytes, start of each piece, order key, place of the piece in its document.

    A document over CHUNK bytes is cut into pieces that overlap by WINDOW - 1, so that each window is in one piece.
    """
    order = batch.column(0).to_numpy(zero_copy_only=False)
    text = batch.column(1).cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
    parts: list[tuple[int, int, int, int]] = []
    size = 0

    def chunk() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([e - s for s, e, _, _ in parts])
        return np.concatenate([data[s:e] for s, e, _, _ in parts]), np.cumsum(lengths) - lengths, np.array([o for _, _, o, _ in parts]), np.array([p for _, _, _, p in parts])

    for k in range(len(text)):
        s, e = int(offsets[k]), int(offsets[k + 1])
        for p in range(s, max(s + 1, e - WINDOW + 1), CHUNK - WINDOW + 1):
            q = min(e, p + CHUNK)
            if q - p < WINDOW:
                continue
            if size + q - p > CHUNK:
                yield chunk()
                parts, size = [], 0
            parts.append((p, q, int(order[k]), p - s))
            size += q - p
    if parts:
        yield chunk()


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of documents, overlapping and touching ones joined."""
    if len(doc) == 0:
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o].copy()
    group = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * far) - group * far
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1]))
    return doc[new], start[new], reach[np.append(np.flatnonzero(new)[1:], len(doc)) - 1]


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of a chunk that have windows: first and last window, and where the suffix starts."""
    n = len(data)
    up, down = powers()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(TABLE[data] * up[:n], out=sums[1:])
    bits = np.uint64(CHUNK.bit_length())
    keys = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    keys = (keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)
    width, least = 1, keys
    while width * 2 <= LEFT + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if rest := LEFT + 1 - width:
        least = np.minimum(least[:-rest], least[rest:])
    inside = np.ones(len(least), bool)  # windows that lie in one piece
    for s in starts[1:]:
        inside[max(0, s - WINDOW + 1) : s] = False
    window = np.flatnonzero(inside)
    anchor = (least[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return window[first], window[np.append(first[1:], len(window)) - 1], anchor[first]


def suffix_rows(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes of suffixes as rows; what no window of a suffix covers is zero."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(WINDOW, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, LEFT + WINDOW)[at]
    out = np.zeros((len(at), ROW), np.uint8)
    out[:, RIGHT_AT : RIGHT_AT + WINDOW], out[:, LEFT_AT : LEFT_AT + LEFT] = around[:, LEFT:], around[:, :LEFT]
    place = np.stack([at - lo, at - hi], axis=1).astype(np.uint8)
    out *= covered(place)
    out[:, PLACE_AT : PLACE_AT + 2] = place
    return out


def multikey_quicksort(words: np.ndarray, last: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words (then of ``last``), and how many leading words each shares with the row before it.

    Rows are put in order by one word; only runs of equal rows go on to the next.
    """
    n, columns = words.shape
    order, depth = np.arange(n), np.zeros(n, np.int16)
    at, group = np.arange(n), np.zeros(n, np.int64)
    for k in range(columns + len(last)):
        if len(at) == 0:
            break
        rows = order[at]
        v = words[rows, k].astype(np.uint64) if k < columns else last[k - columns][rows]
        o = np.lexsort((v, group)) if k else np.argsort(v, kind="quicksort")
        order[at], v = rows[o], v[o]
        same = np.append(False, (group[1:] == group[:-1]) & (v[1:] == v[:-1]))
        depth[at[same]] = k + 1
        tied = same | np.append(same[1:], False)
        at, group = at[tied], np.cumsum(~same)[tied]
    return order, depth


class Suffixes:
    """Rows of suffixes with their documents and starts, kept in order without repeats."""

    def __init__(self, rows: np.ndarray, doc: np.ndarray, at: np.ndarray) -> None:
        order, depth = multikey_quicksort(rows.view(">u8"), (doc, at))
        again, new = order[depth >= WORDS], depth < WORDS
        #: Intervals of those that an earlier suffix equals in all its windows.
        self.marks = merged(doc[again], at[again] - rows[again, PLACE_AT], at[again] - rows[again, PLACE_AT + 1] + WINDOW)
        order = order[new]
        self.rows, self.doc, self.at = rows[order], doc[order], at[order]
        #: One number for all suffixes that begin with the same GRAM bytes.
        self.gram = np.cumsum(depth < GRAM_WORDS)[new]

    def leading(self) -> np.ndarray:
        return np.ascontiguousarray(self.rows[:, RIGHT_AT : RIGHT_AT + WINDOW]).view(f"S{WINDOW}").reshape(-1)

    def pack(self, s: int, e: int) -> bytes:
        """The suffixes from s to e, compressed, without the zeros of their rows."""
        rows = self.rows[s:e]
        place = np.ascontiguousarray(rows[:, PLACE_AT : PLACE_AT + 2])
        parts = place.tobytes() + self.doc[s:e].astype("<i8").tobytes() + self.at[s:e].astype("<i4").tobytes() + rows[covered(place)].tobytes()
        return struct.pack("<IQ", e - s, len(parts)) + zstandard.ZstdCompressor(1).compress(parts)


def covered(place: np.ndarray) -> np.ndarray:
    """Which bytes of rows a window covers, given where windows lie."""
    out = np.zeros((len(place), ROW), bool)
    before, less = place[:, :1].astype(int), place[:, 1:].astype(int)
    out[:, RIGHT_AT : RIGHT_AT + WINDOW] = np.arange(WINDOW) < WINDOW - less
    out[:, LEFT_AT : LEFT_AT + LEFT] = np.arange(LEFT) >= LEFT - before
    return out


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, size = struct.unpack_from("<IQ", blob)
    data = zstandard.ZstdDecompressor().decompress(blob[12:], max_output_size=size)
    rows = np.zeros((n, ROW), np.uint8)
    rows[:, PLACE_AT : PLACE_AT + 2] = place = np.frombuffer(data, np.uint8, 2 * n).reshape(n, 2)
    rows[covered(place)] = np.frombuffer(data, np.uint8, offset=14 * n)
    return rows, np.frombuffer(data, "<i8", n, 2 * n), np.frombuffer(data, "<i4", n, 10 * n).astype(np.int64)


def chunk_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
    """The suffixes of texts (order key, text), those of about FLUSH bytes together."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for b in batches:
        for data, starts, order, place in pieces(b):
            lo, hi, at = anchors(data, starts)
            piece = np.searchsorted(starts, lo, "right") - 1
            held.append((suffix_rows(data, lo, hi, at), order[piece], at - starts[piece] + place[piece]))
            size += len(data)
            if size >= FLUSH:
                yield Suffixes(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
    if held:
        yield Suffixes(*(np.concatenate(x) for x in zip(*held)))


DEALT = "bucket int, data binary, ord long, lo int, end int"


def deal(batches: Iterator[pa.RecordBatch], splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packs of suffixes for each range, and marks (with no data) in any range."""
    names = ["bucket", "data", "ord", "lo", "end"]
    for s in chunk_suffixes(batches):
        bucket = np.searchsorted(splitters, s.leading(), "right")
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        packs = [s.pack(a, e) for a, e in zip(cuts[:-1], cuts[1:])]
        none = pa.nulls(len(packs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(packs, pa.binary()), none, none.cast(pa.int32()), none.cast(pa.int32())], names)
        doc, lo, end = s.marks
        bucket = (doc % (len(splitters) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.nulls(len(doc), pa.binary()), pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(end.astype(np.int32))], names)


def sampled_splitters(texts: DataFrame, n: int, total: int) -> np.ndarray:
    """Up to n leading bytes that cut the suffixes of a bounded sample of documents evenly."""
    wanted = max(SAMPLED, DOCS_EACH * n)
    sample = texts if total <= wanted else texts.sample(fraction=min(1.0, wanted / total), seed=7).limit(2 * wanted)

    size = sample.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    keys = KEYS_EACH * n + 1000
    step = max(1, 2 * size // (LEFT + 2) // keys)  # about every 35th byte starts a suffix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Evenly from the ordered suffixes of each pack."""
        for s in chunk_suffixes(batches):
            at = np.arange(len(s.doc) % step // 2, len(s.doc), step)
            yield pa.RecordBatch.from_arrays([pa.array(s.leading()[at].tolist(), pa.binary())], ["key"])

    keys = sample.mapInArrow(run, "key binary").limit(4 * keys).toArrow().column(0).to_pylist()
    keys = np.sort(np.array(keys, f"S{WINDOW}"))
    return np.unique(keys[(np.arange(1, n + 1) * len(keys)) // (n + 1)]) if len(keys) else keys


def shared_bytes(rows: np.ndarray, splitter: bytes) -> np.ndarray:
    """How many leading bytes of suffixes are those of a splitter."""
    same = rows[:, RIGHT_AT : RIGHT_AT + WINDOW] == np.frombuffer(splitter.ljust(WINDOW, b"\0"), np.uint8)
    return np.where(same.all(axis=1), WINDOW, same.argmin(axis=1))


def compare(s: Suffixes, edges: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of the suffixes of a range the later ones of equal windows (as intervals), and the first ones that may go on beyond its edges."""
    # A window reaches beyond a splitter only if it shares the splitter's bytes from its suffix to its own end.
    limit = np.max([shared_bytes(s.rows, e) for e in edges], axis=0) - GRAM if edges else np.full(len(s.doc), -1)
    open_ = (np.bincount(s.gram)[s.gram] > 1) | (limit >= 0)
    rows, doc, at, gram, limit = s.rows[open_], s.doc[open_], s.at[open_], s.gram[open_], limit[open_]
    o = np.lexsort((at, doc))
    rows, doc, at, gram, limit = rows[o], doc[o], at[o], gram[o], limit[o]
    around = np.concatenate([rows[:, LEFT_AT : LEFT_AT + LEFT], rows[:, RIGHT_AT : RIGHT_AT + WINDOW]], axis=1)
    first, last = LEFT - rows[:, PLACE_AT].astype(int), LEFT - rows[:, PLACE_AT + 1].astype(int)
    salt = mixed(gram.astype(np.uint64))
    up, down = powers()
    sums = np.zeros(len(doc), np.uint64)
    for p in range(WINDOW):
        sums += TABLE[around[:, p]] * up[p]
    marks, beyond = [], []
    for p in range(LEFT + 1):
        there = np.flatnonzero((first <= p) & (p <= last))
        key = mixed(sums[there] * down[p]) ^ salt[there]
        later = repeats(key, gram[there], around[there, p : p + WINDOW])
        start = at[there] + p - LEFT
        marks.append((doc[there[later]], start[later], start[later] + WINDOW))
        on = ~later & (limit[there] >= p)
        if on.any():
            beyond.append((np.ascontiguousarray(around[there[on], p : p + WINDOW]), doc[there[on]], start[on]))
        if p < LEFT:
            sums += TABLE[around[:, p + WINDOW]] * up[p + WINDOW] - TABLE[around[:, p]] * up[p]
    return merged(*(np.concatenate(x) for x in zip(*marks))), beyond


def repeats(key: np.ndarray, gram: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which rows equal an earlier one in gram and text; equal ones have equal keys."""
    o = np.argsort(key, kind="stable")
    new = np.append(True, key[o][1:] != key[o][:-1])[: len(o)]
    of = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
    i, f = o[~new], of[~new]
    later = np.zeros(len(key), bool)
    later[i] = (gram[i] == gram[f]) & (text[i] == text[f]).all(axis=1)
    odd = np.unique(key[i[~later[i]]])
    if len(odd):  # different rows with one key
        seen = set()
        for k in np.flatnonzero(np.isin(key, odd)):
            row = (int(gram[k]), text[k].tobytes())
            later[k] = row in seen
            seen.add(row)
    return later


FOUND = "ord long, lo int, end int, window binary"


def found(doc: np.ndarray, lo: np.ndarray, end: np.ndarray, window: np.ndarray | None = None) -> pa.RecordBatch:
    text = pa.nulls(len(doc), pa.binary()) if window is None else pa.array([w.tobytes() for w in window], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(end.astype(np.int32)), text], ["ord", "lo", "end", "window"])


def solve(batches: Iterator[pa.RecordBatch], splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ranges in order of their number to marks, and to windows (with their text) to compare with other ranges."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, bucket = 0, -1

    def joined() -> Suffixes:
        return Suffixes(*(np.concatenate(x) for x in zip(*held)))

    def close() -> Iterator[pa.RecordBatch]:
        s = joined()
        yield found(*s.marks)
        edges = [bytes(splitters[k]) for k in (bucket - 1, bucket) if 0 <= k < len(splitters)]
        marks, beyond = compare(s, edges)
        yield found(*marks)
        for window, doc, lo in beyond:
            yield found(doc, lo, lo + WINDOW, window)

    for b in batches:
        marks = np.array(b.column(1).is_null())
        if marks.any():
            yield found(*(b.column(k).filter(pa.array(marks)).to_numpy() for k in (2, 3, 4)))
        for k in np.flatnonzero(~marks).tolist():
            if held and b.column(0)[k].as_py() != bucket:
                yield from close()
                held, size = [], 0
            bucket = b.column(0)[k].as_py()
            held.append(unpack(b.column(1)[k].as_py()))
            size += len(held[-1][1])
            if size > HELD and len(held) > 1:
                s = joined()
                yield found(*s.marks)
                held, size = [(s.rows, s.doc, s.at)], 0
    if held:
        yield from close()


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order of text, document and start to marks for all but the first of equal ones."""
    before = None
    for b in batches:
        text = b.column(3).to_pylist()
        again = np.array([t == u for t, u in zip(text, [before, *text[:-1]])], bool)
        doc, lo, end = (b.column(k).to_numpy(zero_copy_only=False)[again] for k in (0, 1, 2))
        yield found(*merged(doc, lo.astype(np.int64), end.astype(np.int64)))
        before = text[-1] if text else before


def ordered(docs: DataFrame, work: Workspace) -> DataFrame:
    """Documents with ``ord``, unique and in order: the id itself where ids are unique and not null."""
    again = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not again:
        return docs.select("doc_id", F.col("doc_id").alias("ord"), "text", "record")
    sort = docs.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    return work.put(sort.select("doc_id", F.monotonically_increasing_id().alias("ord"), "text", "record"), "ordered")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans (removed runs of bytes as array<struct<start,end>>), kept (the bytes left) and record for each row.

    A byte is removed if a WINDOW-byte string that covers it also starts earlier:
    in a document with a smaller id, or before in the same document. Matches
    never cross documents, and are judged on the input. A null text is empty.
    Rows with null ids come first; rows with equal ids are documents of their
    own, ordered by a hash of their texts. All other columns are in the struct record.
    """
    spark = df.sparkSession
    small_batches(spark)
    work = Workspace(spark, "suffixes")
    others = [F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col)] or [F.lit(None).cast("string").alias("none")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = ordered(df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.struct(*others).alias("record")), work)
    texts = docs.select("ord", "text").where(F.octet_length("text") >= WINDOW)
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    ranges = max(PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), (size["bytes"] or 0) // RANGE_BYTES)
    cuts = spark.sparkContext.broadcast(sampled_splitters(texts, min(ranges, MOST_SPLITTERS), size["n"]))
    dealt = texts.mapInArrow(lambda b: deal((x for x in b if x.num_rows), cuts.value), DEALT)
    sorted_ = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: solve(b, cuts.value), FOUND)
    solved = work.put(sorted_, "found")
    beyond = solved.where("window is not null").repartition("window").sortWithinPartitions("window", "ord", "lo").mapInArrow(across, FOUND)
    marks = solved.where("window is null").unionByName(beyond).groupBy("ord").agg(F.collect_list(F.struct("lo", "end")).alias("marks"))
    joined = docs.join(marks, "ord", "left").select("doc_id", "text", "marks", "record")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans, kept = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode()
                m = np.array([(x["lo"], x["end"]) for x in found or []], np.int64).reshape(-1, 2)
                _, s, e = merged(np.zeros(len(m), np.int64), m[:, 0], m[:, 1])
                spans.append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist())])
                kept.append(b"".join(data[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(data)])))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(kept, pa.binary()), batch.column(3)], ["doc_id", "text", "spans", "kept", "record"])

        return run

    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("spans", spans), ("kept", T.BinaryType()), ("record", docs.schema["record"].dataType)]
    return map_batches(joined, T.StructType([T.StructField(n, t) for n, t in fields]), make)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from all documents, and a digest of what is left."""
    n = F.octet_length("text").cast("long")
    return repeated_spans(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id",
        n.alias("n_bytes"),
        (n - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
