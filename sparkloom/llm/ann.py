"""Approximate nearest neighbours: an inverted file with product-quantised residuals.

Coarse centroids cut the vectors into lists; what is left of a vector after its
centroid is coded by its length and, for its direction, one byte for every two
dimensions, so that the error is in proportion to what is left, be it small or
large. A query looks into the lists of its nearest centroids and estimates
distances to the coded vectors (asymmetric: the query itself isn't coded); the
best of all its lists are measured exactly. How many lists and how many exact
distances that takes is measured with queries of the table against the sample
that centroids are fitted on: few where vectors lie in clusters, many where they
lie at random.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.storage import Workspace

#: Vectors, chosen by a hash of their ids, that centroids and codes are fitted on at most.
FIT_ROWS = 20_000
#: Vectors of a list on average, vectors of the sample for each list, and lists at least (fewer vectors than that are one list).
LIST_ROWS, FIT_EACH = 256, 40
#: The share of true neighbours whose lists a query should look into, queries that this is measured with, and what is added to it.
COVERED, MEASURED, SPARE = 0.97, 400, 1.1
#: Dimensions of a subspace, codes of one, and vectors of the sample that these are fitted on at most.
WIDTH, CODES, FIT_CODES = 2, 256, 4096
#: Candidates of a query that are measured exactly, for each of its k neighbours, at least; the list of its nearest centroid may give them all, the second half of them, and so on (each list k at least). Equal estimates go by the smaller id, so copies of one vector, however many, give the few that can be among the nearest.
RERANKED = 40
#: Estimates that a task holds at once.
CELLS = 1 << 22
#: Vectors (as codes) and queries that meet in one task's group: larger lists and query sets are dealt out in blocks.
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 8192


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids; an empty cluster takes the vector farthest from its centroid."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near, d = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        empty = np.flatnonzero(n == 0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if len(empty):
            c[empty] = x[np.argsort(-d, kind="stable")[: len(empty)]]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector and the squared distance to it, in blocks."""
    near, d = np.empty(len(x), np.int64), np.empty(len(x))
    for s in range(0, len(x), 4096):
        q = ((c * c).sum(1) - 2 * x[s : s + 4096] @ c.T) + (x[s : s + 4096] ** 2).sum(1)[:, None]
        near[s : s + 4096] = q.argmin(1)
        d[s : s + 4096] = q.min(1)
    return near, d


@dataclass
class Index:
    centroids: np.ndarray
    books: np.ndarray  # (subspaces, codes, dimensions of one), padded with zeros

    def parts(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), self.books.shape[0] * WIDTH))
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), -1, WIDTH)

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each vector, and its code: four bytes of length and a byte for each subspace."""
        near, _ = nearest(x, self.centroids)
        left, length = directions(x - self.centroids[near])
        left = self.parts(left)
        codes = np.stack([nearest(left[:, j], self.books[j])[0] for j in range(left.shape[1])], 1).astype(np.uint8)
        return near, np.hstack([length.astype("<f4")[:, None].view(np.uint8), codes])

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """What is left of coded vectors after their centroids."""
        length = np.ascontiguousarray(codes[:, :4]).view("<f4")
        x = self.books[np.arange(self.books.shape[0]), codes[:, 4:]].reshape(len(codes), -1)[:, : self.centroids.shape[1]]
        return x * length

    def estimates(self, queries: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded vectors of list ``of``; equal codes have equal distances."""
        kinds, kind = np.unique(np.ascontiguousarray(codes).view(f"V{codes.shape[1]}").ravel(), return_inverse=True)
        x, q = self.decode(kinds.view(np.uint8).reshape(len(kinds), -1)), queries - self.centroids[of]
        return ((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1))[:, kind]


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length one, and their lengths; zero vectors stay."""
    length = np.sqrt((x * x).sum(1))
    return x / np.where(length == 0, 1, length)[:, None], length


def fit(sample: np.ndarray, lists: int) -> Index:
    centroids = kmeans(sample, lists)
    near, _ = nearest(sample, centroids)
    index = Index(centroids, np.zeros((-(-sample.shape[1] // WIDTH), 1, WIDTH)))
    some = slice(None, None, max(1, len(sample) // FIT_CODES))
    left = index.parts(directions((sample - centroids[near])[some])[0])
    index.books = np.stack([kmeans(left[:, j], CODES, 8, j) for j in range(left.shape[1])])
    return index


def true_neighbours(sample: np.ndarray, k: int, queries: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each query with the places of its nearest in the sample; ``own`` is its own place there, or -1."""
    norms = (sample * sample).sum(1)
    for q, at in zip(queries, own):
        d = norms - 2 * sample @ q
        if at >= 0:
            d[at] = np.inf
        n = min(k, len(d) - (at >= 0))
        yield q, np.argpartition(d, min(n, len(d) - 1))[:n]


def spread(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the sample as queries, and their places."""
    own = np.arange(0, len(sample), max(1, len(sample) // MEASURED))
    return sample[own], own


def lists_needed(sample: np.ndarray, index: Index, k: int, queries: np.ndarray | None = None, own: np.ndarray | None = None) -> int:
    """How many lists a query must look into for COVERED of its true neighbours in the sample, by these queries (else by vectors of the sample)."""
    if queries is None or not len(queries):
        queries, own = spread(sample)
    near, _ = nearest(sample, index.centroids)
    n = len(index.centroids)
    found = np.zeros(n, np.int64)
    for q, best in true_neighbours(sample, k, queries, own):
        place = np.empty(n, np.int64)
        place[np.argsort(((index.centroids - q) ** 2).sum(1), kind="stable")] = np.arange(n)
        np.add.at(found, place[near[best]], 1)
    enough = int(np.searchsorted(np.cumsum(found), COVERED * found.sum())) + 1
    return min(n, int(np.ceil(SPARE * enough)))


def exact_needed(sample: np.ndarray, index: Index, k: int, queries: np.ndarray, own: np.ndarray) -> float:
    """The share of all vectors that must be measured exactly for COVERED of the true neighbours, by their places among the estimates in the sample."""
    near, codes = index.code(sample)
    x = index.centroids[near] + index.decode(codes)
    norms, places = (x * x).sum(1), []
    for q, best in true_neighbours(sample, k, queries, own):
        d = norms - 2 * x @ q
        places.append(np.searchsorted(np.sort(d), d[best], "left") + 1)
    places = np.concatenate([*places, np.ones(1, np.int64)])
    return SPARE * float(np.quantile(places, COVERED)) / max(1, len(sample))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Ids and vectors that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["dims"] if sizes else 0))


def neighbours(df: DataFrame, is_query: Callable[[F.Column], F.Column], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query vector among all other vectors: query_id, rank, vec_id, score.

    The score is the Euclidean distance in double precision; ties go to the
    smaller id. Vectors that are null, all zero, or hold a null or a non-finite
    number take no part, nor do those of another length than most, nor null ids.
    Rows with one id are vectors of their own: each is a query if the id is one,
    and a candidate for all but itself. Rows of a query with one id follow each
    other by a hash of the query's vector. Other columns are left out.
    """
    spark = df.sparkSession
    work = Workspace(spark, "ann")
    rows = work.put(usable(df, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    # A sample of at most FIT_ROWS vectors is fitted on the driver.
    by_hash = [F.xxhash64("id"), F.col("id"), F.xxhash64("v"), F.col("row")]
    queries = rows.where(is_query(F.col("id")))
    held_by, asked_by = (df.select("row", "v").toArrow().combine_chunks() for df in (rows.orderBy(*by_hash).limit(FIT_ROWS), queries.orderBy(*by_hash).limit(MEASURED)))
    sample, trial = matrix(held_by.column("v").combine_chunks()), matrix(asked_by.column("v").combine_chunks())
    if not len(trial):
        return empty
    places = {r: i for i, r in enumerate(held_by.column("row").to_pylist())}
    own = np.array([places.get(r, -1) for r in asked_by.column("row").to_pylist()])
    index = fit(sample, max(1, min(len(sample) // FIT_EACH, n // LIST_ROWS)))
    lists = len(index.centroids)
    probed = lists_needed(sample, index, k, trial, own)
    reranked = max(RERANKED * k, int(np.ceil(n * exact_needed(sample, index, k, trial, own))))
    shared = spark.sparkContext.broadcast(index)  # at most FIT_ROWS / FIT_EACH centroids and a book of CODES for each subspace

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, codes = shared.value.code(matrix(b.column(2)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near), pa.array([c.tobytes() for c in codes], pa.binary())], ["row", "id", "list", "code"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value.centroids
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                d = (c * c).sum(1) - 2 * x @ c.T
                best = np.argsort(d, axis=1, kind="stable")[:, :probed]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best.tolist(), pa.list_(pa.int64()))], ["row", "v", "lists"])

    coded = work.put(rows.select("row", "id", "v").mapInArrow(code, "row long, id long, list long, code binary"), "index")
    blocks = F.ceil(F.col("count") / BLOCK_ROWS).cast("int")
    sizes = F.broadcast(coded.groupBy("list").count().select("list", blocks.alias("blocks")))  # one row for each list, of which FIT_ROWS bounds the number
    slices = max(1, -(-queries.count() * probed // lists // BLOCK_QUERIES))
    asked = queries.select("row", "v").mapInArrow(probe, "row long, v array<double>, lists array<long>").select("row", "v", F.posexplode("lists").alias("place", "list")).join(sizes, "list")
    asked = asked.select("row", "v", "list", "place", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"))
    # Codes alone, of some bytes each, are copied for each slice of the queries; vectors stay where they are.
    held = coded.join(sizes, "list").select("row", "id", "code", "list", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """The rows of a list that look nearest to each query that looks into it, and estimates."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            ix, of = shared.value, left.column("list")[0].as_py()
            rows_, ids = right.column("row").to_numpy(), right.column("id").to_numpy()
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            asking_, gives = left.column("row").to_numpy(), np.maximum(k, -(-reranked // (left.column("place").to_numpy() + 1)))
            x, some = matrix(left.column("v").combine_chunks()), max(1, CELLS // len(ids))
            for s in range(0, len(x), some):
                for q, most, d in zip(asking_[s : s + some], gives[s : s + some], ix.estimates(x[s : s + some], of, codes)):
                    near = np.flatnonzero(d <= np.partition(d, most)[most]) if len(d) > most + 1 else np.arange(len(d))
                    near = near[rows_[near] != q]
                    near = near[np.lexsort((rows_[near], ids[near], d[near]))[:most]]
                    out.append((np.full(len(near), q), rows_[near], ids[near], d[near]))
        none = np.zeros(0, np.int64)
        cols = [np.concatenate(c) for c in zip(*out)] if out else [none, none, none, np.zeros(0)]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query", "row", "id", "estimate"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))})

    keys = ["list", "block", "slice"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(meet, "query long, row long, id long, estimate double")
    shortlist = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("estimate", "id", "row"))).where(F.col("place") <= reranked).select("query", "row")
    vectors = rows.select("row", "id", "v")
    asking = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("q"))
    pairs = shortlist.join(vectors, "row").join(asking, "query")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                exact = np.sqrt(((matrix(b.column(4)) - matrix(b.column(3))) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(exact)], ["query", "query_id", "vec_id", "score"])

    pairs = pairs.select("query", "query_id", F.col("id").alias("vec_id"), "q", "v").mapInArrow(measure, "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every vector whose id is divisible by 100."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda c: c % 100 == 0)
