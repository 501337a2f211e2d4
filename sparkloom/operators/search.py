"""Lexical and vector search, rank fusion and reranking, for many questions at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType as T_StructType

from sparkloom.functions import text as T
from sparkloom.storage import Workspace

#: Weights of the ranked lists, the rank constant, and the caps of input lists and output.
WEIGHTS = {"lex_raw": 1.0, "vec_raw": 0.9, "lex_exp": 0.6, "vec_exp": 0.6, "vec_hyde": 0.7}
RRF_K, LIST_CAP, FUSED_CAP = 60, 100, 40
#: What an unconfirmed support costs a hit.
DEMOTION = {"verified": 1.0, "unchecked": 0.85, "uncertain": 0.80, "failed": 0.70}


def top(df: DataFrame, k: int, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


#: Queries that one pass over the vectors answers: they are broadcast, a larger set is taken in blocks.
QUERY_BLOCK = 8192
#: Cosines that a task holds at once: a batch of vectors meets so many queries at a time as give no more.
CELLS = 1 << 20


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors at length one as a matrix; zero vectors stay, and mixed dimensions are an error."""
    sizes = np.unique(np.diff(column.offsets.to_numpy()))
    if len(sizes) > 1:
        raise ValueError("vectors of different dimensions")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def similarities(vectors: DataFrame, queries: DataFrame, keep: Callable[[np.ndarray, pa.RecordBatch], np.ndarray], schema: str) -> DataFrame:
    """Cosines of each query (query_id, v) with the vectors that ``keep`` picks from a matrix product of a batch."""
    numbered = queries.withColumn("block", F.floor((F.row_number().over(Window.orderBy("query_id")) - 1) / QUERY_BLOCK))
    out: DataFrame | None = None
    for block in [r["block"] for r in numbered.select("block").distinct().collect()]:
        part = numbered.where(F.col("block") == block).select("query_id", "v").toArrow().combine_chunks()
        ids, q = part.column("query_id").to_numpy(), unit_rows(part.column("v").combine_chunks()) if part.num_rows else None
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q))  # at most QUERY_BLOCK vectors

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for b in batches:
                if b.num_rows:
                    x = unit_rows(b.column("v"))
                    if x.shape[1] != q.shape[1]:
                        raise ValueError("vectors of different dimensions")
                    some = max(1, CELLS // len(x))
                    for at in range(0, len(q), some):
                        s = np.round(q[at : at + some] @ x.T, 6) + 0.0
                        i, j = keep(s, b)
                        others = [b.column(k).take(pa.array(j)) for k, n in enumerate(b.schema.names) if n != "v"]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[at + i]), *others, pa.array(s[i, j])], [f.name for f in shape])

        shape = T_StructType.fromDDL(schema).fields
        found = vectors.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else vectors.sparkSession.createDataFrame([], schema)


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact cosine neighbours of a set of queries (query_id, v) among vectors (vec_id, v): query_id, rank, vec_id, score.

    Each batch of vectors gives its k best (and ties of the last) for every query.
    """

    def keep(s: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        n = s.shape[1]
        least = np.partition(s, max(0, n - k), axis=1)[:, max(0, n - k)]
        return np.nonzero(s >= least[:, None])

    sims = similarities(vectors.select("vec_id", "v"), queries, keep, "query_id long, vec_id long, score double")
    return top(sims, k, ["query_id"], [F.desc("score"), F.asc("vec_id")]).select("query_id", "rank", "vec_id", "score")


def best_chunks(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """The best vector of each record (vec_id, record, v) for each query: query_id, record, score, vec_id."""

    def keep(s: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        """In a batch the first best of each record."""
        ids, record = b.column("vec_id").to_numpy(), b.column("record").to_numpy()
        i, j = [], []
        for r in np.unique(record):
            at = np.flatnonzero(record == r)
            at = at[np.argsort(ids[at], kind="stable")]
            i.append(np.arange(len(s)))
            j.append(at[s[:, at].argmax(axis=1)])
        return np.concatenate(i), np.concatenate(j)

    kind = dict(vectors.dtypes)["record"]
    sims = similarities(vectors.select("vec_id", "record", "v"), queries, keep, f"query_id long, vec_id long, record {kind}, score double")
    best = sims.groupBy("query_id", "record").agg(F.min_by(F.struct("score", "vec_id"), F.struct(-F.col("score"), F.col("vec_id"))).alias("b"))
    return best.select("query_id", "record", "b.score", "b.vec_id")


def rrf(lists: DataFrame) -> DataFrame:
    """Fuse ranked lists (query_id, list, doc_id, rank): weight / (60 + rank), half a step more for a first place."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("list"))
    part = weight / (RRF_K + F.col("rank")) + F.when(F.col("rank") == 1, F.lit(0.5 / (RRF_K + 1))).otherwise(F.lit(0.0))
    fused = lists.where(F.col("rank") <= LIST_CAP).groupBy("query_id", "doc_id").agg(
        F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("lists"), F.array_join(F.array_sort(F.collect_list(F.concat("list", F.lit(":"), F.col("rank").cast("string")))), ",").alias("trace")
    )
    return top(fused, FUSED_CAP, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def demote(hits: DataFrame, status: str = "status") -> DataFrame:
    """Multiply scores by the factor of their support's status (1 if it has none) and rank anew."""
    factor = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DEMOTION.items() for x in kv]), F.col(status)), F.lit(1.0))
    out = hits.withColumn("score", F.round(F.col("score") * factor, 6)).drop("rank")
    return top(out, FUSED_CAP, ["query_id"], [F.desc("score"), F.asc("doc_id")])


def minmax(score: Column, keys: list[str]) -> Column:
    """Scores of each key between 0 and 1; all 1 where they are equal."""
    w = Window.partitionBy(*keys)
    span = F.max(score).over(w) - F.min(score).over(w)
    return F.when(span == 0, F.lit(1.0)).otherwise((score - F.min(score).over(w)) / span)


def lexical_score(text: Column, query: str, terms: list[str]) -> Column:
    """Five for each place of the whole query, one for each place of a term."""
    count = lambda t: (F.length(F.lower(text)) - F.length(F.replace(F.lower(text), F.lit(t), F.lit("")))) / len(t)
    return (5 * count(query) + sum((count(t) for t in terms), F.lit(0))).cast("long")


def snippet(text: Column, query: str, width: int = 320) -> Column:
    """A window around the first place of the query, a third of it before; dots where text is left out."""
    at = F.greatest(F.instr(F.lower(text), query) - 1 - width // 3, F.lit(0))
    cut = F.substring(text, at + 1, F.lit(width))
    return F.concat(F.when(at > 0, F.lit("…")).otherwise(F.lit("")), cut, F.when(at + width < F.length(text), F.lit("…")).otherwise(F.lit("")))


def routes(asked: DataFrame, graph: DataFrame, explore: str, overview: str) -> DataFrame:
    """``asked`` (text, mode, source_key, intent, allows_global, allows_explore) with the route that is wanted and the one that is taken."""
    low = F.lower("text")
    explored = F.col("allows_explore") & F.col("has_relations")
    wanted = (
        F.when(F.col("mode") != "auto", F.col("mode")).when(F.col("source_key").isNotNull(), "source-section")
        .when((F.col("intent") == "discovery") & explored, "explore").when((F.col("intent") == "synthesis") & F.col("has_reports"), "global").when(F.col("intent") == "lookup", "local")
        .when(low.rlike(explore) & explored, "explore").when(low.rlike(overview) & F.col("has_reports"), "global").otherwise("local")
    )
    rows = asked.crossJoin(F.broadcast(graph)).withColumn("wanted", wanted)  # the graph's state is one row
    refused = (F.col("wanted") == "global") & ~F.col("allows_global") | (F.col("wanted") == "explore") & ~F.col("allows_explore")
    return rows.withColumn("route", F.when(refused, "local").otherwise(F.col("wanted")))


def admitted(asked: DataFrame, route: str, known: list[str], disabled: list[str]) -> DataFrame:
    """The route that is served, and the one it replaces; the plain route is never switched off."""
    down = F.col(route).isin([d for d in disabled if d != "local"]) | ~F.col(route).isin(known)
    return asked.withColumn("served", F.when(down, "local").otherwise(F.col(route))).withColumn("downgraded_from", F.when(down, F.col(route)))


def hybrid(lex: DataFrame, vec: DataFrame, terms: DataFrame, status: DataFrame, docs: DataFrame, work: Workspace, limit: int = 8) -> DataFrame:
    """Whole answers from ranked lists (query_id, doc_id, rank): fusion, demotion by ``status`` (doc_id, status), reranking by the share of ``terms`` (query_id, terms) that a document holds.

    fallback_mode is "lex" for a question without vectors. Gives query_id, rank, doc_id, score, fallback_mode, text.
    """
    name = lambda df, n: df.select("query_id", F.lit(n).alias("list"), "doc_id", "rank")
    vec = work.put(vec.select("query_id", "doc_id", "rank"), "vectors")  # read twice, made once
    hits = work.put(demote(rrf(name(lex, "lex_raw").unionByName(name(vec, "vec_raw"))).join(status, "doc_id", "left")).select("query_id", "doc_id", "score", "rank"), "fused")
    rows = hits.withColumn("m", minmax(F.col("score"), ["query_id"])).join(docs, "doc_id").join(terms, "query_id")
    c = F.size(F.array_intersect("terms", T.index_tokens(F.col("text")))) / F.greatest(F.size("terms"), F.lit(1))
    best = top(rows.select("query_id", "doc_id", F.round(0.7 * c + 0.3 * F.col("m"), 6).alias("score"), "text"), limit, ["query_id"], [F.desc("score"), F.asc("doc_id")])
    seen = vec.select("query_id").distinct().withColumn("seen", F.lit(True))
    return best.join(seen, "query_id", "left").withColumn("fallback_mode", F.when(F.col("seen"), "").otherwise("lex")).drop("seen")
