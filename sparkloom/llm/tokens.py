"""Token ids as binary output, coded with static range asymmetric numeral systems.

A segment (one row of the written table) holds the ids of whole documents in
ascending id order: a header, one frequency table shared by all its blocks, a
checkpoint for each block (place of its words, its lanes' states, a checksum)
and the blocks' words. Blocks are independent, and each interleaves many lanes,
so all blocks of a segment are coded and decoded side by side as vectors.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm.bpe import byte_chars
from sparkloom.llm.common import documents, id_text, small_batches
from sparkloom.storage import Workspace

MAGIC, VERSION = b"RNSG", 1
SCALE = 20  # the frequencies of a table add up to 1 << SCALE
LOW = np.uint64(1 << 31)  # states are in [LOW, LOW << 32)
LANES, BLOCK = 128, 1 << 16
#: Ids after which a segment is closed (a longer document makes a longer one).
SEGMENT_IDS = 2_000_000
HEAD = struct.Struct("<4sHHIIQII")


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols there are and their scaled frequencies: each at least 1, together 1 << SCALE."""
    symbols, counts = np.unique(ids, return_counts=True)
    total, room = counts.sum(), (1 << SCALE) - len(symbols)
    if room < 0:
        raise ValueError("more symbols than the frequency scale has places")
    f = 1 + counts * room // total
    f[np.argmax(counts)] += (1 << SCALE) - f.sum()
    return symbols.astype("<u4"), f.astype("<u4")


def tables(symbols: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    freq = f.astype(np.uint64)
    return freq, np.cumsum(freq) - freq


def encode_blocks(index: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code an array (blocks, steps, lanes) of symbol indexes: final states, words, words of each block."""
    blocks, steps, lanes = index.shape
    x = np.full((blocks, lanes), LOW, dtype=np.uint64)
    words = np.empty((blocks, steps, lanes), dtype="<u4")
    sent = np.empty((blocks, steps, lanes), dtype=bool)
    for k in range(steps - 1, -1, -1):
        f, c = freq[index[:, k]], start[index[:, k]]
        full = x >= f << np.uint64(63 - SCALE)
        sent[:, k] = full
        words[:, k] = x.astype("<u4")
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + c
    return x, words[sent], sent.sum(axis=(1, 2))


def decode_blocks(x: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, freq: np.ndarray, start: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The inverse: states (blocks, lanes) and the place of each block's first word give (blocks, steps, lanes)."""
    blocks, lanes = x.shape
    out = np.empty((blocks, steps, lanes), dtype=place.dtype)
    at = at.astype(np.int64).copy()
    words = np.append(words, np.zeros(1, "<u4")).astype(np.uint64)
    mask = np.uint64((1 << SCALE) - 1)
    for k in range(steps):
        slot = x & mask
        s = place[slot]
        out[:, k] = s
        x = freq[s] * (x >> np.uint64(SCALE)) + slot - start[s]
        low = x < LOW
        n = np.cumsum(low, axis=1)
        x = np.where(low, x << np.uint64(32) | words[np.where(low, at[:, None] + n - 1, 0)], x)
        at += n[:, -1]
    return out


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One segment."""
    flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    n = len(flat)
    symbols, f = frequencies(flat) if n else (np.zeros(0, "<u4"), np.zeros(0, "<u4"))
    freq, start = tables(symbols, f)
    points, states, words = [], [], []
    lookup = np.zeros(int(symbols[-1]) + 1 if n else 1, dtype=np.int32)
    lookup[symbols] = np.arange(len(symbols))
    whole = n // BLOCK * BLOCK
    for lo, hi, size in ((0, whole, BLOCK), (whole, n, -(-(n - whole) // LANES) * LANES)):
        if lo == hi:
            continue
        index = lookup[flat[lo:hi]]
        index = np.append(index, np.full(-len(index) % size, np.argmax(f), dtype=np.int32)).reshape(-1, size // LANES, LANES)
        x, w, sizes = encode_blocks(index, freq, start)
        for b, k in enumerate(sizes):
            part = flat[lo + b * size : min(hi, lo + (b + 1) * size)]
            points.append((int(k), len(part), zlib.crc32(part.astype("<u4").tobytes())))
        states.append(x.astype("<u8").tobytes())
        words.append(w.tobytes())
    table = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + f.tobytes(), 1)
    docs = zlib.compress(
        np.array([d is not None for d in doc_ids], "u1").tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([len(i) for i in ids], "<u8").tobytes(), 1
    )
    head = HEAD.pack(MAGIC, VERSION, LANES, len(doc_ids), len(points), n, len(symbols), len(table))
    checkpoints = b"".join(struct.pack("<III", *p) for p in points) + b"".join(states)
    body = head + struct.pack("<I", len(docs)) + table + docs + checkpoints + b"".join(words)
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(segment: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Document ids and their token ids; a damaged segment raises ValueError."""
    if len(segment) < HEAD.size + 8 or zlib.crc32(segment[:-4]) != struct.unpack("<I", segment[-4:])[0]:
        raise ValueError("the segment's checksum is wrong")
    magic, version, lanes, n_docs, n_blocks, n, n_symbols, table_size = HEAD.unpack_from(segment)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of this format")
    (docs_size,) = struct.unpack_from("<I", segment, HEAD.size)
    at = HEAD.size + 4
    table = np.frombuffer(zlib.decompress(segment[at : at + table_size]), "<u4")
    docs = zlib.decompress(segment[at + table_size : at + table_size + docs_size])
    at += table_size + docs_size
    points = np.frombuffer(segment, "<u4", 3 * n_blocks, at).reshape(-1, 3)
    at += 12 * n_blocks
    states = np.frombuffer(segment, "<u8", n_blocks * lanes, at).reshape(-1, lanes)
    words = np.frombuffer(segment, "<u4", (len(segment) - 4 - at - 8 * n_blocks * lanes) // 4, at + 8 * n_blocks * lanes)
    symbols, f = np.cumsum(table[:n_symbols], dtype=np.uint32), table[n_symbols:]
    freq, start = tables(symbols, f)
    place = np.repeat(np.arange(n_symbols, dtype=np.int32), f)
    first = np.cumsum(points[:, 0], dtype=np.int64) - points[:, 0]
    parts: list[np.ndarray] = []
    b = 0
    while b < n_blocks:  # blocks of one length are decoded together
        e = b + 1
        while e < n_blocks and points[e, 1] == points[b, 1]:
            e += 1
        size = int(points[b, 1])
        got = symbols[decode_blocks(states[b:e], words, first[b:e], -(-size // lanes), freq, start, place)].reshape(e - b, -1)[:, :size]
        for k in range(b, e):
            if zlib.crc32(got[k - b].astype("<u4").tobytes()) != points[k, 2]:
                raise ValueError("a block's checksum is wrong")
        parts.append(got.reshape(-1))
        b = e
    flat = np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")
    known = np.frombuffer(docs, "u1", n_docs)
    ids = [int(d) if k else None for k, d in zip(known, np.frombuffer(docs, "<i8", n_docs, n_docs))]
    ends = np.cumsum(np.frombuffer(docs, "<u8", n_docs, 9 * n_docs)).astype(np.int64)
    return ids, np.split(flat, ends[:-1]) if n_docs else []


class TextEncoder:
    """Ids of whole texts as the tokenizers library has them for a file (no special tokens added).

    Where a file is a byte-level BPE without further steps and its tokens are
    numbered in the order of their merges, the numbers serve as ranks for
    tiktoken, which gives the same ids in a fifth of the time. Other files, and
    texts that tiktoken gives up (some hundred thousand blanks in a row), go
    through the library itself. Nothing is remembered between texts.
    """

    def __init__(self, spec: str) -> None:
        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        self.fast = ranked(json.loads(spec))

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except ValueError:  # its regular expression ran out of stack
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


#: How a byte-level tokenizer with its own pattern cuts texts (fixed by the library).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked(j: dict) -> tiktoken.Encoding | None:
    """The file's vocabulary as ranks, if ranks give what its merges give."""
    model, cut = j["model"], j.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or odd or j.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    if any(t[k] for t in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    vocab, byte_of = model["vocab"], {c: b for b, c in enumerate(byte_chars())}
    special = {t["content"]: t["id"] for t in j["added_tokens"]}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    plain = {s: i for s, i in vocab.items() if s not in special}
    if any(a >= b for a, b in zip(made, made[1:])) or any(c not in byte_of for s in plain for c in s) or not set(byte_of) <= set(plain):
        return None
    if len(plain) != 256 + len(made) or made and max(plain[c] for c in byte_of) > made[0]:
        return None
    return tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks={bytes(byte_of[c] for c in s): i for s, i in plain.items()}, special_tokens=special)


_made: dict[str, TextEncoder] = {}


def text_encoder(spec: str) -> TextEncoder:
    """One for each worker process and file."""
    if spec not in _made:
        _made.clear()
        _made[spec] = TextEncoder(spec)
    return _made[spec]


SEGMENTS = "part int, segment int, n_docs int, n_tokens long, data binary"


def write_token_segments(df: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Tokenize all texts and write segments to ``path`` in ascending order of the document ids.

    Returns the written table (part, segment, n_docs, n_tokens, data); (part,
    segment) is the order of the documents. A null text is an empty one, which
    has the end id alone. Rows with a null id come first; rows with equal ids
    stay rows of their own, in the order of a hash of their texts. An empty
    table writes no segment. Other columns are left out.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # the vocabulary file, whose size is fixed
    end = np.array([end_id] if end_id is not None else [], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, made = text_encoder(spec.value), TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            cols = [pa.array([part], pa.int32()), pa.array([made], pa.int32()), pa.array([len(docs)], pa.int32()), pa.array([held], pa.int64()), pa.array([pack(docs, ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "segment", "n_docs", "n_tokens", "data"])

        for b in batches:
            for d, text in zip(b.column(0).to_pylist(), b.column(1)):
                docs.append(d)
                ids.append(np.append(enc.encode(text.as_py()), end))
                held += len(ids[-1])
                if held >= segment_ids:
                    yield close()
                    docs, ids, held, made = [], [], 0, made + 1
        if docs:
            yield close()

    rows = id_text(df, id_col, text_col).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    out = ordered.mapInArrow(run, SEGMENTS)
    out.write.mode("overwrite").option("compression", "uncompressed").parquet(path)
    return spark.read.schema(SEGMENTS).parquet(path)


def read_token_segments(segments: DataFrame, ids: bool = True) -> DataFrame:
    """Decode segments: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if wanted, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, segment, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                docs, parts = unpack(data.as_py())
                n = np.array([len(p) for p in parts], np.int64)
                cols = [
                    pa.array([part] * len(docs), pa.int32()), pa.array([segment] * len(docs), pa.int32()), pa.array(docs, pa.int64()),
                    pa.array(np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()),
                ]
                names = ["part", "segment", "doc_id", "local", "n_tokens", "ids_crc32"]
                if ids:
                    offsets = np.append(0, np.cumsum(n)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "part int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    docs = segments.select("part", "segment", "data").mapInArrow(run, schema)
    # The ids before a segment: those of the parts before its own (one row for each part) and of the segments before it there.
    sizes = segments.select("part", "segment", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("whole"))
    parts = parts.select("part", (F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).alias("earlier"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_tokens")
    starts = sizes.select("part", "segment", inside.alias("inside")).join(parts, "part").select("part", "segment", (F.col("earlier") + F.col("inside")).alias("before"))
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as segments and read back."""
    work = Workspace(spark, "tokens")
    written = write_token_segments(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), work.path("segments"))
    return read_token_segments(written, ids=False)
