"""A persisted lexical index: postings with places, vocabulary, document lengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import questions as Q
from sparkloom.functions import text as T
from sparkloom.operators.search import top
from sparkloom.storage import Workspace

#: Rows up to which a small side is broadcast; beyond it Spark joins by a shuffle.
BROADCAST_ROWS = 200_000


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A side of a join, to be broadcast if it has been counted and is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@dataclass
class Index:
    """postings (term, doc_id, dl, tf, places), vocabulary (term, df, cf) and the two numbers of the corpus."""

    postings: DataFrame
    vocabulary: DataFrame
    n_docs: int
    avgdl: float


#: Documents in a batch that is tokenised, its bytes, and tokens (a longer document is alone) that are sorted at once.
POST_ROWS, POST_BYTES, POST_TOKENS = 1024, "8mb", 1 << 18


def slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (doc_id, tokens) in runs of documents with POST_TOKENS tokens at most."""
    ends, start = b.column(1).offsets.to_numpy(), 0
    while start < b.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + POST_TOKENS, "right")) - 1)
        yield b.slice(start, stop - start)
        start = stop


def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, tokens) to postings: all of a document's tokens are in its row, so nothing is shuffled to count them."""
    for b in (part for whole in batches for part in slices(whole)):
        tokens = b.column(1)
        sizes = np.diff(tokens.offsets.to_numpy())
        words = tokens.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(b.num_rows), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        o = np.lexsort((place, codes, doc))
        doc, codes, place = doc[o], codes[o], place[o]
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (codes[1:] != codes[:-1]))) if len(doc) else np.zeros(0, np.int64)
        ends = np.append(first, len(doc)).astype(np.int32)
        cols = [
            words.dictionary.take(pa.array(codes[first])), b.column(0).take(pa.array(doc[first])), pa.array(sizes[doc[first]].astype(np.int64)),
            pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32))),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["term", "doc_id", "dl", "tf", "places"])


def build_index(docs: DataFrame, work: Workspace, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Write the index of ``docs``. A null text has no tokens but counts as a document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(T.index_tokens(F.col(text)), F.array().cast("array<string>")).alias("tokens"))
    found = rows.mapInArrow(post, "term string, doc_id long, dl long, tf long, places array<int>")
    # In order of term and document: a term's postings lie together, and a frequent term's are cut into several files.
    postings = work.put(found.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), "postings")
    vocabulary = work.put(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), "vocabulary")
    n = docs.count()
    total = vocabulary.agg(F.sum("cf").alias("n")).first()["n"] or 0
    return Index(postings, vocabulary, n, max(1e-9, total / max(1, n)))


def weight(n_docs: int, df: Column) -> Column:
    raw = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)


def saturated(f: Column, dl: Column, avgdl: float) -> Column:
    return f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))


def scored_terms(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score of all documents that hold a term (whole) of a query (query_id, terms)."""
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    wanted = wanted.join(index.vocabulary.select("term", "df"), "term")
    hits = index.postings.select("term", "doc_id", "dl", "tf").join(checked(wanted), "term")
    part = weight(index.n_docs, F.col("df")) * saturated(F.col("tf"), F.col("dl"), index.avgdl)
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def beginnings(wanted: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (token, ...) joined with the terms that begin with their token, by up to three first characters."""
    keys = F.explode(F.array_distinct(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring("term", F.lit(1), n))))
    by_key = vocabulary.select("term", keys.alias("key"))
    asked = wanted.withColumn("key", F.substring("token", 1, 3))
    return by_key.join(checked(asked), "key").where(F.startswith("term", "token")).drop("key")


def units(queries: DataFrame) -> DataFrame:
    """query_id, unit, kind (phrase, term or gone) and tokens of what questions (query_id, question) ask for."""
    q = F.col("question")
    kind = lambda words, name: F.transform(words, lambda w: F.struct(F.lit(name).alias("kind"), Q.wanted_tokens(w).alias("tokens")))
    parts = F.concat(kind(Q.phrases(q), "phrase"), kind(Q.terms(q), "term"), kind(Q.excluded(q), "gone"))
    found = queries.select("query_id", F.posexplode(parts).alias("unit", "u")).select("query_id", "unit", "u.kind", "u.tokens")
    return found.where(F.size("tokens") > 0)


def lexical_hits(index: Index, queries: DataFrame, work: Workspace) -> DataFrame:
    """query_id, doc_id, score of the documents that answer questions (query_id, question).

    A document holds every phrase, one term at least if there are terms (the
    last token of a term may go on), and no excluded word. Scores are sums of
    BM25 over phrases and terms, where a phrase or beginning counts all its places.
    """
    found = work.put(units(queries), "units")
    tokens = found.select("query_id", "unit", "kind", F.size("tokens").alias("size"), F.posexplode("tokens").alias("k", "token"))
    open_end = (F.col("kind") == "term") & (F.col("k") == F.col("size") - 1)
    whole = tokens.where(~open_end).withColumnRenamed("token", "term").join(index.vocabulary.select("term"), "term").select("query_id", "unit", "kind", "size", "k", "term")
    begun = beginnings(tokens.where(open_end), index.vocabulary.select("term")).select("query_id", "unit", "kind", "size", "k", "term")
    asked = work.put(whole.unionByName(begun), "asked")
    hits = index.postings.join(checked(asked), "term")
    unit = ["query_id", "unit", "kind", "doc_id"]
    single = hits.where("size = 1").groupBy(*unit).agg(F.sum("tf").alias("f"), F.first("dl").alias("dl"))
    # A phrase starts where all its tokens stand one after the other.
    starts = hits.where("size > 1").select(*unit, "size", "dl", "k", F.explode("places").alias("place")).withColumn("start", F.col("place") - F.col("k"))
    starts = starts.groupBy(*unit, "start").agg(F.count_distinct("k").alias("n"), F.first("size").alias("size"), F.first("dl").alias("dl")).where("n = size")
    matched = work.put(single.unionByName(starts.groupBy(*unit).agg(F.count(F.lit(1)).alias("f"), F.first("dl").alias("dl"))), "matched")
    df = matched.groupBy("query_id", "unit").agg(F.count(F.lit(1)).alias("df"))
    part = weight(index.n_docs, F.col("df")) * saturated(F.col("f"), F.col("dl"), index.avgdl)
    per = matched.where("kind <> 'gone'").join(checked(df), ["query_id", "unit"]).groupBy("query_id", "doc_id")
    per = per.agg(F.round(F.sum(part), 6).alias("score"), F.count_if(F.col("kind") == "phrase").alias("phrases"), F.count_if(F.col("kind") == "term").alias("terms"))
    asks = found.groupBy("query_id").agg(F.count_if(F.col("kind") == "phrase").alias("all_phrases"), F.count_if(F.col("kind") == "term").alias("any_terms"))
    fits = per.join(checked(asks), "query_id").where("phrases = all_phrases and (terms > 0 or any_terms = 0)")
    return fits.join(matched.where("kind = 'gone'").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "score")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    return top(hits, k, ["query_id"], [F.desc("score"), F.asc("doc_id")]).select("query_id", "rank", "doc_id", "score")


def holders(index: Index, docs: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, doc_id of documents (doc_id, text) that contain a passage (query_id, passage) literally.

    Only documents with the rarest inner token of a passage are compared with
    it; passages of two tokens or fewer, which have none, are compared with all.
    """
    tokens = T.index_tokens(F.col("passage"))
    rows = passages.select("query_id", "passage", tokens.alias("tokens"))
    inner = rows.where(F.size("tokens") > 2).select("query_id", "passage", F.explode(F.slice("tokens", F.lit(2), F.size("tokens") - 2)).alias("term"))
    rarest = inner.join(index.vocabulary.select("term", "df"), "term", "left").groupBy("query_id", "passage").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"))
    near = index.postings.select("term", "doc_id").join(checked(rarest.select("query_id", "passage", F.col("r.term").alias("term"))), "term").select("doc_id", "query_id", "passage")
    sure = docs.join(near, "doc_id").where(F.contains("text", "passage")).select("query_id", "doc_id")
    short = rows.where(F.size("tokens") <= 2).select("query_id", "passage")
    if short.limit(1).count():
        sure = sure.unionByName(docs.join(checked(short), F.contains("text", "passage")).select("query_id", "doc_id"))
    return sure.distinct()
