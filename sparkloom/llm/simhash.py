"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments. Of two fingerprints that
differ in three bits or fewer, one segment differs in at most one bit, so the
two share that segment with one bit wildcarded. Every fingerprint is indexed
under its 64 one-wildcard variants, equal variants are joined, and distances are
verified. Each pair is judged under one variant only. Buckets too large to be
compared pair by pair are cut again in the same way by their other segment;
what remains then has at most 18 free bits and is solved by table look-up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import documents, id_text, labelled, map_batches, small_batches
from sparkloom.operators.components import connected_components
from sparkloom.storage import Workspace

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Members up to which a bucket is compared pair by pair.
PAIRWISE = 2048
SLICE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The SimHash of a text, unsigned."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)])) if len(words) >= SHINGLE else iter([b" ".join(words)])
    h, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    while part := [h(s, SEED) for s in islice(shingles, SLICE)]:
        ones += np.unpackbits(np.array(part, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) for each row; a null text has fingerprint zero."""
    small_batches(df.sparkSession)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

        return run

    return map_batches(id_text(df, id_col, text_col), "doc_id long, fp long", make)


def groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows (key, fp) in order of key as whole groups: keys, fps and whether the group is over ``most``.

    Groups of up to ``most`` rows come many at a time; a larger one comes in parts, each marked.
    """
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    large = None
    for b in batches:
        keys = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, b.column(1).to_numpy(zero_copy_only=False)])
        if len(keys) == 0:
            continue
        if large is not None:
            if end := np.searchsorted(keys, large, "right"):
                yield keys[:end], fps[:end], True
            keys, fps = keys[end:], fps[end:]
            if len(keys) == 0:
                continue
            large = None
        open_at = np.searchsorted(keys, keys[-1], "left")  # the last group may go on in the next batch
        if open_at:
            yield from closed(keys[:open_at], fps[:open_at], most)
            keys, fps = keys[open_at:], fps[open_at:]
        if len(keys) > most:
            large = keys[0]
            yield keys, fps, True
            keys, fps = keys[:0], fps[:0]
    if len(keys):
        yield from closed(keys, fps, most)


def closed(keys: np.ndarray, fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    for s, n in zip(starts[sizes > most], sizes[sizes > most]):
        yield keys[s : s + n], fps[s : s + n], True
    keep = np.repeat((sizes > 1) & (sizes <= most), sizes)
    if keep.any():
        yield keys[keep], fps[keep], False


def first_variant(diff: np.ndarray, width: int) -> np.ndarray:
    """The variant under which a pair with these differing bits is judged: segment * width + wildcard, or -1.

    The first of the two segments that differs in one bit at most decides; equal segments have wildcard 0.
    """
    mask = np.uint64((1 << width) - 1)
    out = np.full(diff.shape, -1, np.int64)
    for seg in (1, 0):
        part = diff >> np.uint64(seg * width) & mask
        bit = np.bitwise_count(np.maximum(part, np.uint64(1)) - np.uint64(1)).astype(np.int64)
        out = np.where(np.bitwise_count(part) <= 1, seg * width + bit, out)
    return out


def linked(diff: np.ndarray, variant: int, sub: int) -> np.ndarray:
    """Whether pairs with these differing bits are links that are judged under this variant."""
    ok = (np.bitwise_count(diff) <= DISTANCE) & (first_variant(diff, 32) == variant)
    if sub >= 0:
        other = diff >> np.uint64(0 if variant >= 32 else 32) & np.uint64(0xFFFFFFFF)
        ok &= first_variant(other, 16) == sub
    return ok


def spanning(fps: np.ndarray, variant: int, sub: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked in one bucket of up to PAIRWISE members."""
    u = fps.view(np.uint64)
    left = np.arange(len(u))
    a, b = [], []
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            i = frontier.pop()
            hit = linked(u[left] ^ u[i], variant, sub)
            if hit.any():
                new = left[hit]
                a.append(np.full(len(new), fps[i]))
                b.append(fps[new])
                frontier += new.tolist()
                left = left[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def by_table(fps: np.ndarray, variant: int, sub: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a bucket of any size whose members differ in 18 known bits only."""
    fps = np.unique(fps)
    seg, p = divmod(variant, 32)
    half, q = divmod(sub, 16)
    shift = 32 * (1 - seg)
    free = [seg * 32 + p, shift + half * 16 + q, *range(shift + (1 - half) * 16, shift + (1 - half) * 16 + 16)]
    u = fps.view(np.uint64)
    code = np.zeros(len(u), np.int64)
    for k, bit in enumerate(free):
        code |= ((u >> np.uint64(bit)).astype(np.int64) & 1) << k
    at = np.full(1 << len(free), -1, np.int64)
    at[code] = np.arange(len(u))
    diffs = [sum(1 << k for k in c) for n in range(1, DISTANCE + 1) for c in combinations(range(len(free)), n)]
    spread = np.array([sum(1 << free[k] for k in range(len(free)) if d >> k & 1) for d in diffs], np.uint64)
    diffs = [d for d, ok in zip(diffs, linked(spread, variant, sub)) if ok]
    label, before = np.arange(len(u)), None
    while before is None or (label != before).any():
        before = label.copy()
        for d in diffs:
            other = at[code ^ d]
            label = np.where(other >= 0, np.minimum(label, label[other]), label)
        label = label[label]
    moved = label != np.arange(len(u))
    return fps[label[moved]], fps[moved]


def judge(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of buckets in order of key; members of too large ones come back as (key, fp), marked."""

    def out(a: np.ndarray, b: np.ndarray, again: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), again))], ["a", "b", "again"])

    def variant_of(key: int) -> tuple[int, int]:
        return (key >> 32, -1) if level == 1 else (key >> 53, key >> 16 & 31)

    held: list[np.ndarray] = []
    held_key = 0
    for keys, fps, large in groups(batches, PAIRWISE):
        if held and (not large or keys[0] != held_key):
            yield out(*by_table(np.concatenate(held), *variant_of(held_key)), False)
            held = []
        if large and level == 1:
            yield out(keys, fps, True)
            continue
        if large:
            held, held_key = [*held, fps], int(keys[0])
            continue
        # Groups of up to eight are compared all at once, by the distance of their places.
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        small = np.repeat(sizes <= 8, sizes)
        k, f = keys[small], fps[small]
        for d in range(1, 8):
            same = np.flatnonzero(k[d:] == k[:-d])
            if len(same) == 0:
                break
            diff = f[same].view(np.uint64) ^ f[same + d].view(np.uint64)
            at = k[same]
            near = np.bitwise_count(diff) <= DISTANCE
            same, diff, at = same[near], diff[near], at[near]
            if level == 1:
                ok = first_variant(diff, 32) == at >> 32
            else:
                other = np.where(at >> 53 >= 32, diff, diff >> np.uint64(32)) & np.uint64(0xFFFFFFFF)
                ok = (first_variant(diff, 32) == at >> 53) & (first_variant(other, 16) == (at >> 16 & 31))
            if ok.any():
                yield out(f[same[ok]], f[same[ok] + d], False)
        for s, n in zip(starts[sizes > 8], sizes[sizes > 8]):
            a, b = spanning(fps[s : s + n], *variant_of(int(keys[s])))
            if len(a):
                yield out(a, b, False)
    if held:
        yield out(*by_table(np.concatenate(held), *variant_of(held_key)), False)


def links(fps: DataFrame, work: Workspace) -> DataFrame:
    """Edges (a, b) whose components are those of all links among the distinct fingerprints ``fp``."""
    i = F.col("i")
    part = F.expr("shiftrightunsigned(fp, int(32 * (i div 32))) & 4294967295L")
    key = F.expr("shiftleft(i, 32)").bitwiseOR(part.bitwiseAND(F.expr("~shiftleft(1L, int(i % 32))")))
    schema = "a long, b long, again boolean"
    variants = fps.select("fp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("i")).select(key.alias("key"), "fp")
    first = work.put(variants.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: judge(b, 1), schema), "links-1")
    # What is left of large buckets, cut by the other segment: key is variant, sub-variant, that half's other bits.
    again = first.where("again").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    other = F.expr("shiftrightunsigned(fp, int(if(shiftright(key, 37) = 1, 0, 32))) & 4294967295L")
    half = F.expr("shiftrightunsigned(other, int(16 * (i div 16))) & 65535L & ~shiftleft(1L, int(i % 16))")
    # The masked segment of the bucket's key enters the new key whole: 38 bits, then 5, then 16.
    key2 = F.expr("shiftleft(key, 21) | shiftleft(i, 16)").bitwiseOR(half)
    finer = again.select("key", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("i")).withColumn("other", other).select(key2.alias("key"), "fp")
    second = finer.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: judge(b, 2), schema)
    return first.where("not again").select("a", "b").unionByName(second.select("a", "b"))


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id linked to it, directly or not) for each row.

    Fingerprints are linked when they differ in three bits or fewer. Null and
    empty texts have fingerprint zero and are linked like others. A null doc_id
    never names a component; where a component has no other, its id is null.
    Repeated rows stay and share a component. Other columns are left out.
    """
    spark = df.sparkSession
    work = work or Workspace(spark, "simhash")
    docs = work.put(fingerprints(df, id_col, text_col), "fingerprints")
    classes = work.put(docs.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    parts = connected_components(links(classes.select("fp"), work), work)
    member = classes.join(parts, classes["fp"] == parts["node"], "left")
    least = member.where("component is not null").groupBy("component").agg(F.min("rep").alias("least")).withColumnRenamed("component", "root")
    component = F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least"))
    named = member.join(least, F.col("component") == F.col("root"), "left").select("fp", component.alias("component_id"), "members")
    return labelled(docs, work.put(named, "named"), "fp", "members").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash_groups(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
