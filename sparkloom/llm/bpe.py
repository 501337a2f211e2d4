"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can come last in its encoding. The
vocabulary's automaton names the tokens that end at each position; a token is
the last one of a prefix if it is compatible with the last token of the prefix
before it, that is, if merging would leave the border between the two alone.
Following the stored tokens from the end gives the ids, in time linear in the
word, with no merge loop.
"""

from __future__ import annotations

import json
import math
import re
from array import array
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from sparkloom.llm.common import documents, id_text, map_batches, small_batches, tokens_digest

#: Entries that a worker remembers: chunks and words (in each of two generations) and token pairs.
CHUNKS_KEPT, WORDS_KEPT, PAIRS_KEPT = 100_000, 200_000, 300_000
#: White space as the tokenizer's regular expressions know it.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
END = "\0"


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


class PrefixModel:
    """The vocabulary and merges of a BPE tokenizer, ready for words in byte-level characters."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], word_end: str) -> None:
        self.word_end = word_end
        self.rank: dict[tuple[int, int], int] = {}
        self.made_at: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (left, right) in enumerate(merges):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = r
            if c not in self.parts:
                self.parts[c], self.made_at[c] = (a, b), r
                if max(self.made_at.get(a, -1), self.made_at.get(b, -1)) >= r:
                    raise ValueError("a merge comes before those that make its parts")
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.length: dict[int, int] = {}
        self.base = max(vocab.values()) + 1
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            if i not in self.parts or self.compatible(*self.parts[i], below=self.made_at[i]):
                text = s[: -len(word_end)] + END if word_end and s.endswith(word_end) and len(s) > len(word_end) else s
                self.length[i] = len(text)
                self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at one edge of a token (side 1: its right edge), smallest first, each with the rank of the merge that uses it up."""
        if (found := self.spines.get((token, side))) is None:
            found, until = [], math.inf
            while True:
                found.append((token, until))
                if token not in self.parts:
                    break
                token, until = self.parts[token][side], self.made_at[token]
            found.reverse()
            if len(self.spines) < PAIRS_KEPT:
                self.spines[found[-1][0], side] = found
        return found

    def compatible(self, a: int, b: int, below: float = math.inf) -> bool:
        """Whether merging leaves the border between tokens a and b alone (as far as merges below a rank go)."""
        left, right, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            r = self.rank.get((x, y), math.inf)
            # Of two merges of one rank the one further left comes first.
            if r < below and r < x_until and r <= y_until:
                return False
            if x_until == math.inf and y_until == math.inf:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def encode(self, word: str) -> list[int]:
        """The ids of a word in byte-level characters, its end marked if the vocabulary marks it."""
        text = word + END if self.word_end else word
        n = len(text)
        last = [-1] * (n + 1)
        pairs, base = self.pairs, self.base
        for at, (size, token) in self.automaton.iter(text):
            at += 1
            if last[at] >= 0:
                continue  # the last token of a prefix is unique
            if size < at:
                if (before := last[at - size]) < 0:
                    continue
                key = before * base + token
                if (ok := pairs.get(key)) is None:
                    if len(pairs) >= PAIRS_KEPT:
                        pairs.clear()
                    ok = pairs[key] = self.compatible(before, token)
                if not ok:
                    continue
            last[at] = token
        ids = []
        while n:
            if (token := last[n]) < 0:
                raise ValueError("a character has no token")
            ids.append(token)
            n -= self.length[token]
        return ids[::-1]


class WordCache(dict):
    """Values by chunk in two generations, so that what it holds stays bounded."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if (v := self.old.get(chunk)) is None:
            v = self.make(chunk)
        if len(chunk) < 64:
            self[chunk] = v
        return v


class PrefixEncoder:
    """Texts to ids and back, as the tokenizers library has them for the same file (no special tokens added)."""

    def __init__(self, spec: str) -> None:
        j = json.loads(spec)
        model = j["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or j.get("decoder"):
            raise ValueError("only plain BPE files without a decoder are read")
        library = Tokenizer.from_str(spec)
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        self.model = PrefixModel(model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.specials = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        tokens = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.tokens = np.array([tokens.get(i, "") for i in range(max(tokens) + 1)], dtype=object)
        self.chars = byte_chars()
        self.words = WordCache(self.of_word, WORDS_KEPT)
        self.chunks = WordCache(self.of_chunk, CHUNKS_KEPT)

    def of_word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join([self.chars[b] for b in word.encode()])
        return array("I", self.model.encode(word)).tobytes()

    def of_chunk(self, chunk: str) -> bytes:
        """The ids of a piece of text without white space, as bytes of unsigned 32-bit integers."""
        if m := PLAIN.fullmatch(chunk):
            word, marks = m.groups()
            return self.words[word.lower()] + self.words[marks] if marks else self.words[word.lower()]
        ids: list[int] = []
        for k, part in enumerate(self.specials.split(chunk) if self.specials else [chunk]):
            if k % 2:
                ids.append(self.special[part])
            elif part:
                for piece, _ in self.split.pre_tokenize_str(self.normal.normalize_str(part)):
                    ids += self.model.encode(piece)
        return array("I", ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks = [c for c in SPACE.split(text) if c] if ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces: what the library gives where the file names no decoder."""
        return " ".join(self.tokens[ids])


_made: dict[str, PrefixEncoder] = {}


def encoder(spec: str) -> PrefixEncoder:
    """One for each worker process and file."""
    if spec not in _made:
        _made.clear()
        _made[spec] = PrefixEncoder(spec)
    return _made[spec]


def encode_and_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each whole text and the text decoded from them: doc_id, ids (array<int>), decoded.

    ``tokenizer`` is the path of a file of the tokenizers library. A null text
    is an empty one (no ids, empty text); null and repeated doc_ids and repeated
    rows stay as they are, one row out for each row in; other columns are left
    out. Each document is encoded alone, word by word, so a very long text needs
    memory in proportion to its own length only.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # the vocabulary file, whose size is fixed

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        enc = encoder(spec.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = [enc.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(coded) + 1, dtype="int32")
            np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))
            decoded = pa.array([enc.decode(np.frombuffer(c, dtype="<u4")) for c in coded], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], ["doc_id", "ids", "decoded"])

        return run

    return map_batches(id_text(df, id_col, text_col), "doc_id long, ids array<int>, decoded string", make)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and decoded texts of all documents."""
    coded = encode_and_decode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", *tokens_digest())
