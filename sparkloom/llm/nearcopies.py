"""Near copies by exact Jaccard similarity of five-word shingles.

Two sets whose similarity reaches 0.8 share one of the rarest shingles of each:
those that are left when a set may miss a fifth of its members (prefix filter).
So only these are indexed, rarest first by counts of a sample; the order decides
how many candidates there are, never which pairs are found. Candidates are
verified on their whole sets. In buckets over SMALL members all are first judged
against one of them, then each against the one whose sketch is nearest, then only
what is in different components so far; of buckets with the same members one is
read. Pairs are let go before their sets are read
where sketches show that too much differs: a sketch holds, for each of its cells,
whether the set has an odd number of shingles there, and two sketches differ in no
more cells than there are shingles in only one of the sets. Cells grow with the
set, so that at any size up to MOST_CELLS most of what differs shows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import id_text, labelled, map_batches, small_batches
from sparkloom.operators.components import connected_components
from sparkloom.storage import Workspace

SHINGLE, SEED = 5, 42
#: Least similarity, as a fraction.
NUM, DEN = 4, 5
#: Counters of the sample and rows in it; both only order shingles.
SLOTS, SAMPLE = 1 << 20, 200_000
#: Members up to which all pairs of a bucket are candidates at once.
SMALL = 32
#: Cells of a sketch (a power of two, two for each shingle), and the words of 64 cells that are compared at once.
LEAST_CELLS, MOST_CELLS, AT_ONCE = 512, 8192, 1 << 20


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingles as sorted hashes; under five words the whole text is one."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    parts = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)])) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], np.uint64))


def sketch(s: np.ndarray) -> bytes:
    """Whether the number of a set's shingles in each cell is odd, a bit for each."""
    m = min(MOST_CELLS, max(LEAST_CELLS, 1 << (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s >> np.uint64(32) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(grid: np.ndarray, words: int) -> np.ndarray:
    """Sketches with so many words of 64 cells: halves are added, since a cell's number loses its highest bit."""
    while grid.shape[1] > words:
        half = grid.shape[1] // 2
        grid = grid[:, :half] ^ grid[:, half:]
    return grid


def cells(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length as rows of words."""
    return np.frombuffer(b"".join(sketches), "<u8").reshape(len(sketches), -1)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many cells these sketches differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def may_be_near(cells_apart: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets whose sketches differ in so many cells, which hold ``both`` shingles together, can be similar enough."""
    return (NUM + DEN) * cells_apart <= (DEN - NUM) * both


def slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(SLOTS, np.int64)
    for b in batches:
        for t in b.column(0).to_pylist():
            np.add.at(n, (shingles(t) & np.uint64(SLOTS - 1)).astype(np.int64), 1)
    at = np.flatnonzero(n)
    for k in range(0, len(at), 1 << 16):
        part = at[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], ["slot", "n"])


def sets(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, node (a hash of the set), n (its size), sketch and prefix (the shingles to index)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # SLOTS numbers at any size

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        often = shared.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sizes, sketches, prefixes = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t)
                order = np.lexsort((s, often[(s & np.uint64(SLOTS - 1)).astype(np.int64)]))
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                sizes.append(len(s))
                sketches.append(sketch(s))
                prefixes.append(s[order[: len(s) - -(-NUM * len(s) // DEN) + 1]].view(np.int64))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "node", "n", "sketch", "prefix"],
            )

        return run

    return map_batches(docs, "doc_id long, node long, n long, sketch binary, prefix array<long>", make)


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with one first column."""
    held: list[np.ndarray] | None = None
    for b in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
        if len(held[0]) == 0:
            continue
        cuts = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
        for i, j in zip(np.append(0, cuts[:-1]), cuts):
            if j - i > 1:
                yield [c[i:j] for c in held]
        if len(cuts):
            held = [c[cuts[-1] :] for c in held]
    if held is not None and len(held[0]) > 1:
        yield held


def near_size(n: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)


def pairs_out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of buckets (shingle, node, part, n) in different parts: all pairs of small buckets, one member with all others of large ones.

    Each large bucket is named as well: its shingle and a hash of its members, with their number as ``large`` (0: a pair).
    """
    for shingle, node, part, n in buckets(batches):
        if (part == part[0]).all():
            continue
        for i in range(len(node) - 1 if len(node) <= SMALL else 1):
            near = near_size(n[i + 1 :], n[i]) & (part[i + 1 :] != part[i])
            if near.any():
                out = pairs_out(np.full(int(near.sum()), node[i]), node[i + 1 :][near])
                yield out.append_column("large", pa.array(np.zeros(out.num_rows, np.int64)))
        if len(node) > SMALL:
            name = np.array([xxhash.xxh64_intdigest(np.sort(node).tobytes(), SEED)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shingle[:1]), pa.array(name), pa.array([len(node)], pa.int64())], ["a", "b", "large"])


def nearest_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the candidates that each member of a large bucket has, the one with the nearest sketch."""
    return other_pairs(batches, nearest=True)


def other_pairs(batches: Iterator[pa.RecordBatch], nearest: bool = False) -> Iterator[pa.RecordBatch]:
    """Candidates of large buckets (shingle, node, n, part, sketch) whose members are in different parts so far.

    Members are taken by size: only the next ones, up to a quarter larger, can be near.
    With ``nearest`` each member has the likeliest of them only.
    """
    for _, node, n, part, sketches in buckets(batches):
        if len(node) <= SMALL or (part == part[0]).all():
            continue
        order = np.argsort(n, kind="stable")
        node, n, part, sketches = node[order], n[order], part[order], [sketches[i] for i in order]
        ends = np.searchsorted(n, n * DEN // NUM, "right")
        # Longer sketches belong to larger sets, so sketches of one length stand together.
        words = np.array([len(s) // 8 for s in sketches])
        starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        levels = [(int(at), int(end), cells(sketches[at:end])) for at, end in zip(starts, np.append(starts[1:], len(node)))]
        of = np.searchsorted(starts, np.arange(len(node)), "right") - 1
        for at, end, own in levels:
            first = int(of[at])
            grids = {first: own}
            for i in range(at, end):
                best = (MOST_CELLS + 1, -1)
                for level in range(first, int(of[ends[i] - 1]) + 1):
                    begin, stop, grid = levels[level]
                    if level not in grids:
                        grids[level] = folded(grid, own.shape[1])
                    stop, step = min(stop, int(ends[i])), AT_ONCE // own.shape[1]
                    for j in range(max(begin, i + 1), stop, step):
                        k = slice(j, min(stop, j + step))
                        near = np.flatnonzero(part[k] != part[i])
                        apart = differing(grids[level][j - begin + near], own[i - at])
                        ok = may_be_near(apart, n[k][near] + n[i])
                        near, apart = near[ok], apart[ok]
                        if nearest and len(near):
                            best = min(best, (int(apart.min()), j + int(near[apart.argmin()])))
                        elif len(near):
                            yield pairs_out(np.full(len(near), node[i]), node[k][near])
                if best[1] >= 0:
                    yield pairs_out(node[i : i + 1], node[best[1] : best[1] + 1])


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that can be near by their sizes and sketches (n, m, x, y)."""
    for b in batches:
        x, y, both = b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(2).to_numpy() + b.column(3).to_numpy()
        sizes = np.array([[len(s) for s in x], [len(s) for s in y]]).reshape(2, -1)
        ok = np.zeros(b.num_rows, bool)
        for size in np.unique(sizes, axis=1).T:
            at = np.flatnonzero((sizes == size[:, None]).all(axis=0))
            words = int(size.min()) // 8
            ok[at] = may_be_near(differing(folded(cells([x[i] for i in at]), words), folded(cells([y[i] for i in at]), words)), both[at])
        if b.num_rows:
            yield b.select(["a", "b"]).filter(pa.array(ok))


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links (a, b) in each batch as many as its components need."""
    for batch in batches:
        root: dict[int, int] = {}
        kept = []

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:  # noqa: B023
                root[x] = x = root.setdefault(up, up)  # noqa: B023
            return x

        for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64()))


def near_copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """doc_id and component_id (the smallest doc_id linked to it, directly or not) for each row.

    Rows are linked when the Jaccard similarity of their sets of shingles is 0.8
    or more; null and empty texts are equal. Ids must be unique and not null.
    ``known`` (doc_id, component_id: one of the group's ids) names groups that are
    linked as well, whatever their similarity; no pair within one is looked at.
    """
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    work = Workspace(spark, "nearcopies")
    docs = id_text(df, id_col, text_col)
    every = max(1, -(-docs.count() // SAMPLE))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    counts = np.zeros(SLOTS, np.int64)
    found = sample.mapInArrow(slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()

    member = work.put(sets(docs, counts), "sets")
    named_by = work.put(member.select("doc_id", "node"), "members")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    links = named_by.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"))
    if known is not None:
        root = named_by.select(F.col("doc_id").alias("component_id"), F.col("node").alias("a"))
        others = known.where("doc_id <> component_id").join(named_by, "doc_id").select("component_id", F.col("node").alias("b"))
        links = work.put(others.join(root, "component_id").where("a <> b").select("a", "b").distinct(), "links-known")
    grouped = member.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "prefix")], F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))

    def parted(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """``nodes`` with the component that the links put each in."""
        parts = connected_components(links.mapInArrow(forest, "a long, b long"), work, name=name).withColumnRenamed("node", "of")
        return nodes.join(parts, F.col("node") == F.col("of"), "left").select(*nodes.columns, F.coalesce("component", "node").alias("part"))

    classes = work.put(parted(grouped, links, "known"), "classes")
    work.drop("sets")
    postings = classes.select(F.explode("prefix").alias("shingle"), "node", "part", "n")

    def verified(found: DataFrame, name: str) -> DataFrame:
        """The candidates whose similarity is enough."""
        pairs = work.put(found.distinct(), f"candidates-{name}")
        end = lambda c, n, x: classes.select(F.col("node").alias(c), F.col("n").alias(n), F.col("sketch").alias(x))
        both = pairs.join(end("a", "n", "x"), "a").join(end("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
        pairs = work.put(both.mapInArrow(sketched, "a long, b long"), f"likely-{name}")
        work.drop(f"candidates-{name}")
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = classes.select("node", "rep").join(nodes, "node", "left_semi")
        small_batches(spark)

        def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
            def run(b: pa.RecordBatch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).view(np.int64) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["node", "s"])

            return run

        whole = work.put(map_batches(docs.join(wanted, docs["doc_id"] == F.col("rep")).select("node", "text"), "node long, s array<long>", make), f"whole-{name}")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
        both = pairs.join(whole.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(whole.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        links = work.put(both.where((NUM + DEN) * common >= NUM * (F.size("x") + F.size("y"))).select("a", "b"), f"links-{name}")
        work.drop(f"likely-{name}", f"whole-{name}")
        return links

    first = postings.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(first_pairs, "a long, b long, large long")
    first = work.put(first, "first")
    links = links.unionByName(verified(first.where("large = 0").select("a", "b"), "first"))
    # Of buckets with the same members one will do.
    large = first.where("large > 0").groupBy("large", "b").agg(F.min("a").alias("shingle")).select("shingle")
    members = work.put(postings.select("shingle", "node", "n").join(large, "shingle"), "large")
    for name, pairs in ("second", nearest_pairs), ("third", other_pairs):
        of = parted(classes.select("node", "sketch"), links, f"parts-{name}")
        rest = members.join(of, "node").select("shingle", "node", "n", "part", "sketch")
        found = rest.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(pairs, "a long, b long")
        links = links.unionByName(verified(found, name))
    named = parted(classes.select("node", "rep", "members"), links, "components")
    least = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = work.put(named.join(least, "part").select("node", "component_id", "members"), "named")
    work.drop("first", "large", "classes", "links-known", "links-first", "links-second", "links-third")
    return labelled(named_by, named, "node", "members").select("doc_id", "component_id")
