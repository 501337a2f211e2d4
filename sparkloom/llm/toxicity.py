"""Toxicity of whole texts after noisy-channel restoration.

Words written with look-alike signs, letters three times or more in a row, or
spaces between letters are decoded by Viterbi search over a lattice of what each
sign may stand for, under a character language model; other words stay as they are. The restored words join those of the text,
and a logistic regression over a few chosen words and word beginnings follows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import annotate, documents, id_text, small_batches
from sparkloom.operators.index import checked
from sparkloom.storage import Workspace

#: A feature needs so many toxic rows and this share of them among its rows.
LEAST_TOXIC, PRECISION = 5, 0.6
THRESHOLD = 0.7
#: Lengths of word beginnings (with more letters after them) that are features; characters of context of the language model.
BEGINNINGS, ORDER = (4, 5, 6, 7, 8), 3
WORD = re.compile(r"[^\W\d_]+")

#: What a sign may stand for, beside itself.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "*": "aeiou", "€": "e",
}
#: Costs (negative natural logarithms) of the channel.
SUBSTITUTED, DOUBLED, SIGN_LEFT = 0.7, 1.5, 6.0

_letter, _sign = np.zeros(256, bool), np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_sign[[ord(c) for c in LOOKS_LIKE if ord(c) < 128]] = True


@dataclass
class CharModel:
    """Interpolated character n-grams of words (Witten-Bell), with ^ before and $ after a word."""

    counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.total: Counter[str] = Counter()
        self.kinds: Counter[str] = Counter()
        self.gram: Counter[str] = Counter()
        for g, n in self.counts.items():
            self.gram[g] += n
            self.total[g[:-1]] += n
            self.kinds[g[:-1]] += 1
        self.known: dict[str, float] = {}

    def cost(self, context: str, c: str) -> float:
        key = context + c
        if (found := self.known.get(key)) is None:
            p = 1 / 64
            for k in range(len(context) + 1):
                h = context[len(context) - k :]
                if t := self.total[h]:
                    p = (self.gram[h + c] + self.kinds[h] * p) / (t + self.kinds[h])
            found = self.known[key] = -math.log(p)
        return found


def char_grams(word: str) -> Iterator[str]:
    padded = "^" * ORDER + word + "$"
    for i in range(ORDER, len(padded)):
        for k in range(ORDER + 1):
            yield padded[i - k : i + 1]


def options(sign: str, n: int) -> list[tuple[str, float]]:
    """What a run of n equal signs may stand for, with costs."""
    if sign.isalpha():
        return [(sign, 0.0)] + ([(sign * 2, 0.0 if n == 2 else DOUBLED)] if n > 1 else [])
    out = [(c, SUBSTITUTED) for c in LOOKS_LIKE.get(sign, "")]
    if sign == "*":
        out = [(c, 2.0) for c, _ in out] + [("", SUBSTITUTED)]
    return out or [("", 0.0)]


def breaks(letters: str) -> list[str]:
    """The letters with and without an end of a word before each."""
    out = [""]
    for x in letters:
        out = [a + b for a in out for b in (x, " " + x)]
    return out


def restore(written: str, model: CharModel, words: bool = False) -> str:
    """The likeliest word (or words, if there may be several) behind a written form (lower case, separators left out).

    The lattice has a column for each run of equal signs and a state for each
    context of the language model; back-pointers lead from the cheapest end.
    """
    states: dict[str, float] = {"^" * ORDER: 0.0}
    back: list[dict[str, tuple[str, str]]] = []
    i = 0
    while i < len(written):
        j = i
        while j < len(written) and written[j] == written[i]:
            j += 1
        after: dict[str, float] = {}
        came: dict[str, tuple[str, str]] = {}
        for context, cost in sorted(states.items()):
            for read, more in options(written[i], j - i):
                for letters in breaks(read) if words and i else (read,):
                    at, c = context, cost + more
                    for x in letters:
                        c += model.cost(at, "$" if x == " " else x)
                        at = "^" * ORDER if x == " " else (at + x)[-ORDER:]
                    if at not in after or c < after[at]:
                        after[at], came[at] = c, (context, letters)
        states, i = after, j
        back.append(came)
    at = min((cost + model.cost(context, "$"), context) for context, cost in states.items())[1]
    out = []
    for came in reversed(back):
        at, letters = came[at]
        out.append(letters)
    return "".join(reversed(out))


def suspicious(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where a word looks disguised: signs among letters or stretched letters; letters one by one."""
    if len(data) < 5:
        data = np.append(data, np.full(5 - len(data), 32, np.uint8))
    letter, sign = _letter[data], _sign[data]
    touch = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    stretched = letter[:-2] & (data[:-2] == data[1:-1]) & (data[1:-1] == data[2:])
    edge = np.concatenate([[False], letter, [False]])
    alone = (letter | sign) & ~edge[:-2] & ~edge[2:]
    spaced = alone[:-4] & alone[2:-2] & alone[4:] & ~(letter | sign)[1:-3] & ~(letter | sign)[3:-1]
    mixed = np.flatnonzero(touch)
    return np.union1d(mixed, np.flatnonzero(stretched)), np.flatnonzero(spaced)


TOKEN = re.compile(r"\S+")
#: Letters and signs one by one, up to three separators between them; the two classes share no character, so matching is linear.
SPACED = re.compile(r"(?<![\w@$!|+€])(?:[^\W_]|[@$!|+€])(?:[\s._\-*/]{1,3}(?:[^\W_]|[@$!|+€])){2,}(?![\w@$!|+€])")


def disguised(text: str, model: CharModel, cache: dict[str, str]) -> tuple[list[str], int]:
    """The restored words of a text (of letters set apart, the letters joined to one word and to likely words), and the blanks inside these."""
    mixed, spaced = suspicious(np.frombuffer(text.encode(), np.uint8))
    out, inside = [], 0
    if len(mixed):
        for m in TOKEN.finditer(text):
            t = m[0].lower().strip(".,;:?!\"'()[]{}<>")
            if looks_disguised(t):
                if t not in cache:
                    if len(cache) > 50_000:
                        cache.clear()
                    cache[t] = restore("".join(c for c in t if c.isalpha() or c in LOOKS_LIKE), model)
                out.append(cache[t])
    if len(spaced):
        for m in SPACED.finditer(text):
            t = "".join(c for c in m[0].lower() if c.isalpha() or c in LOOKS_LIKE)
            if len(t) > 2 and any(c.isalpha() for c in t):
                out.append(restore(t, model))
                if len(parts := restore(t, model, words=True).split()) > 1:
                    out += parts
                inside += max(0, m[0].count(" ") - len(parts) + 1)
    return out, inside


def looks_disguised(t: str) -> bool:
    kinds = [c.isalpha() for c in t]
    if not any(kinds):
        return False
    if any(c in LOOKS_LIKE for c in t):
        return True
    return any(a == b == c and a.isalpha() for a, b, c in zip(t, t[1:], t[2:]))


class FeatureCounter:
    """How often each of some features (=word or ^beginning) stands in a text, and its number of words."""

    def __init__(self, chosen: list[str], chars: dict[str, int]) -> None:
        self.chosen = chosen
        self.finder = ahocorasick.Automaton()
        self.by_text: dict[str, list[int]] = defaultdict(list)
        for i, f in enumerate(chosen):
            self.by_text[f[1:]].append(i)
        for t in self.by_text:
            self.finder.add_word(t, t)
        if chosen:
            self.finder.make_automaton()
        self.model, self.cache = CharModel(chars), {}

    def found(self, text: str, anywhere: bool = False) -> list[int]:
        out = []
        for end, t in self.finder.iter(text):
            begins = end < len(t) or not text[end - len(t)].isalpha()
            ends = end + 1 == len(text) or not text[end + 1].isalpha()
            for i in self.by_text[t]:
                if anywhere or begins and (self.chosen[i][0] == "=") == ends:
                    out.append(i)
        return out

    def vector(self, text: str) -> np.ndarray:
        """The logarithms of one more than the counts, and of their share of the words."""
        x, inside = np.zeros(len(self.chosen) + 1), 0
        if self.chosen:
            np.add.at(x, self.found(text.lower()), 1)
            words, inside = disguised(text, self.model, self.cache)
            for word in words:
                hits = set(self.found(word)) | {i for i in self.found(word, True) if len(self.chosen[i]) > 5}
                x[list(hits)] += 1
        x[-1] = 1000 * x.sum() / (1 + text.count(" ") - inside)
        return np.log1p(x)


@dataclass
class Classifier:
    """Weights of features, of the share of words that they make up (last but one), and the bias (last)."""

    chosen: list[str]
    weights: list[float]
    chars: dict[str, int]

    def scorer(self) -> Callable[[str], float]:
        count, w, bias = FeatureCounter(self.chosen, self.chars), np.array(self.weights[:-1]), self.weights[-1]

        def score(text: str) -> float:
            return float(1 / (1 + np.exp(-np.clip(count.vector(text) @ w + bias, -500, 500))))

        return score


def logistic(rows: DataFrame, size: int, penalty: float = 0.1) -> list[float]:
    """Ridge logistic regression of rows (toxic, x) by Newton steps, each summed over all of them: the weights, then the bias."""
    w, ridge = np.zeros(size + 1), np.full(size + 1, penalty)
    ridge[-1] = 1e-3
    for _ in range(30):

        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(w) + 1, len(w)))
            for b in batches:
                if b.num_rows:
                    x = np.hstack([b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), np.ones((b.num_rows, 1))])
                    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                    total[:-1] += (x * (p * (1 - p))[:, None]).T @ x
                    total[-1] += x.T @ (b.column(0).to_numpy() - p)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "value"])

        found = rows.select("toxic", "x").mapInArrow(sums, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        total = np.zeros(len(w) * (len(w) + 1))
        total[found.column(0).to_numpy()] = found.column(1).to_numpy()
        total = total.reshape(-1, len(w))
        step = np.linalg.solve(total[:-1] + np.diag(ridge), total[-1] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in BEGINNINGS if len(word) > k)]


def words_of(df: DataFrame) -> DataFrame:
    """(word, toxic, clean): in how many rows of (toxic, text) of each class a word stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            w = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array([counts[x][1] for x in w], pa.int64()), pa.array([counts[x][0] for x in w], pa.int64())], ["word", "toxic", "clean"])

        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in set(WORD.findall(text.lower())):
                    counts.setdefault(w, [0, 0])[toxic] += 1
            if len(counts) > 200_000:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return df.select("toxic", "text").mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(candidates: dict[str, tuple[int, int]], patterns: DataFrame, least: int, times: int = 4) -> list[str]:
    """Features that together cover each toxic row ``times`` times if they can: always the one that adds most, until little is added.

    ``patterns`` has the features of toxic rows and n, how many have just these; each choice is a count over all of them.
    """
    alive, chosen = set(candidates), []
    while alive:
        left = patterns.where(F.size(F.array_intersect("features", F.array(*[F.lit(c) for c in chosen]).cast("array<string>"))) < times)
        counts = left.select(F.explode("features").alias("f"), "n").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
        holds = {r["f"]: r["n"] for r in counts if r["f"] in alive}
        if not holds:
            break
        best = max(holds, key=lambda f: (holds[f] * (candidates[f][0] / sum(candidates[f])) ** 4, -len(f), f))
        chosen.append(best)
        # Of a word and its beginnings that stand in the same rows one is enough.
        alive -= {f for f in alive if f[1:].startswith(best[1:]) or best[1:].startswith(f[1:])}
    return chosen


def fit(df: DataFrame, labels: DataFrame, train: Callable[[str], object], id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Learn from all labelled rows that ``train`` (a Column of the id) admits.

    Of repeated labels the highest counts; null labels and texts teach nothing;
    equal texts of one class teach once. Without toxic or clean rows the score
    is the same for all texts.
    """
    spark = df.sparkSession
    small_batches(spark)
    work = Workspace(spark, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").where(train(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    texts = id_text(df, id_col, text_col).where("text is not null").join(checked(known), "doc_id").select("toxic", "text").dropDuplicates(["toxic", "text"])
    texts = work.put(texts, "texts")
    size = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        return Classifier([], [0.0, 20.0 if n_toxic else -20.0], {})
    vocabulary = work.put(words_of(texts), "vocabulary")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter[str] = Counter()
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for g in char_grams(w):
                    c[g] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["gram", "n"])

    frequent = vocabulary.withColumn("n", F.expr("toxic + clean")).where("n >= 2").select("word", "n")
    chars = frequent.mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n >= 3").toArrow()

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: dict[str, list[int]] = {}
            for w, t, n in zip(*(x.to_pylist() for x in b.columns)):
                for f in features(w):
                    e = c.setdefault(f, [0, 0])
                    e[0] += t
                    e[1] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([e[0] for e in c.values()], pa.int64()), pa.array([e[1] for e in c.values()], pa.int64())], ["feature", "toxic", "clean"])

    by_feature = vocabulary.mapInArrow(stats, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # What stands in fewer rows is never chosen, so those that may be are bounded by the words of a hundred rows.
    least = max(3, n_toxic // 100)
    good = by_feature.where(f"toxic >= {max(LEAST_TOXIC, least)} and toxic >= {PRECISION} * (toxic + clean)").collect()
    candidates = {r["feature"]: (r["toxic"], r["clean"]) for r in good}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sorted({f for w in set(WORD.findall(t.lower())) for f in features(w) if f in candidates}) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["features"])

    rows = texts.where("toxic = 1").select("text").mapInArrow(held, "features array<string>").where(F.size("features") > 0)
    chosen = choose(candidates, work.put(rows.groupBy("features").agg(F.count(F.lit(1)).alias("n")), "patterns"), least)
    grams_known = dict(zip(chars.column(0).to_pylist(), chars.column(1).to_pylist()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = FeatureCounter(chosen, grams_known)
        for b in batches:
            x = [count.vector(t).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    weights = logistic(work.put(texts.select("toxic", "text").mapInArrow(counted, "toxic int, x array<double>"), "vectors"), len(chosen) + 1)
    work.drop()
    return Classifier(chosen, weights, grams_known)


def with_score(df: DataFrame, model: Classifier, name: str = "score", text_col: str = "text") -> DataFrame:
    """``df`` with the score (0 to 1) of each row's text under ``name``; a null text is an empty one. All rows and columns stay."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few features, and sequences of four letters

    def make() -> Callable[[list[str | None]], pa.Array]:
        score = shared.value.scorer()
        return lambda texts: pa.array([score(t or "") for t in texts], pa.float64())

    return annotate(df, name, "double", make, text_col)


def score_texts(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for each row, repeated ones too; other columns are left out."""
    return with_score(id_text(df, id_col, text_col), model).select("doc_id", "score")


def remainder(doc_id: object, n: int) -> object:
    """crc32 of the id's decimal text modulo n; a null id has remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % n


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Classifier:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit(docs, labels, lambda c: remainder(c, 3) != 1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that has seen none of the held-out labels."""
    docs = documents(spark, sf_dir)
    return score_texts(docs, trained(spark, docs, sf_dir)).select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
