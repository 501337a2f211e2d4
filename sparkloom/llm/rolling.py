"""Distinct and frequent users over trailing windows, by bitsets that slide.

Clicks are counted once for each kind, minute and user, which makes a hot user as
short as others. Time is cut into blocks, and the users of a kind's block are
dealt out by hash to shards; within a shard each user is a bit. A shard's minutes
are bitsets, and a window is the OR of its minutes: a queue of two stacks slides
it, where the front stack holds the ORs of what is still to leave and the back
stack the OR of what has come since. For frequent users a minute has a bit-plane
for each count up to the least asked for (plane k: k clicks or more), and OR
becomes addition that saturates. Bits are counted for each minute, and the counts
of the shards add up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from sparkloom.storage import Workspace

#: Minutes of a block, and rows (kind, minute, user) that a shard of it has on average at most; a shard is a task's memory.
BLOCK, SHARD_ROWS = 1440, 50_000


@dataclass(frozen=True)
class Windows:
    """Lengths in minutes, and the least number of clicks in the longest that makes a user hot."""

    short: int = 10
    middle: int = 60
    long: int = 720
    hot: int = 5

    def __post_init__(self) -> None:
        if not 0 < self.short <= self.middle <= self.long or self.hot < 1:
            raise ValueError("windows must be positive and in order")


COUNTS = ["users_short", "users_middle", "users_long", "hot_users"]


def stacked(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Front and back stack of a queue of ``length`` rows after each push, for ORs.

    The queue turns over each time that it is full: what lies in the back stack
    becomes the front stack, whose entries hold the OR from themselves to its
    end. So the front of a row is that of the row after the one that leaves.
    """
    n, words = rows.shape
    turns = -(-n // length)
    filled = np.zeros((turns, length, words), rows.dtype)
    filled.reshape(-1, words)[:n] = rows
    back = np.bitwise_or.accumulate(filled, axis=1).reshape(-1, words)[:n]
    suffix = np.bitwise_or.accumulate(filled[:, ::-1], axis=1)[:, ::-1].reshape(-1, words)
    front = np.zeros((turns * length, words), rows.dtype)
    if turns > 1:
        front[length:] = suffix[1 : 1 + (turns - 1) * length]
    # A row that ends a turn fills the queue with the back stack alone.
    front[length - 1 :: length] = 0
    return front[:n], back


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of two thermometers (..., planes, words), saturated at the last plane."""
    out, planes = a | b, a.shape[-2]
    for i in range(planes - 1):
        out[..., i + 1 :, :] |= a[..., i : i + 1, :] & b[..., : planes - 1 - i, :]
    return out


def running_sums(x: np.ndarray) -> np.ndarray:
    """Sums of thermometers (turns, length, planes, words) up to each along the length: in runs, over the runs' ends, and both together."""
    turns, length, *shape = x.shape
    run = math.isqrt(length - 1) + 1
    runs = -(-length // run)
    y = np.zeros((turns, runs * run, *shape), x.dtype)
    y[:, :length] = x
    y = y.reshape(turns, runs, run, *shape)
    for i in range(1, run):
        y[:, :, i] = added(y[:, :, i - 1], y[:, :, i])
    ends = y[:, :, -1].copy()
    for j in range(1, runs):
        ends[:, j] = added(ends[:, j - 1], ends[:, j])
    y[:, 1:] = added(ends[:, :-1, None], y[:, 1:])
    return y.reshape(turns, runs * run, *shape)[:, :length]


def stacked_sums(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``stacked`` for thermometers (minutes, planes, words): addition in place of OR."""
    n, shape = len(rows), rows.shape[1:]
    turns = -(-n // length)
    filled = np.zeros((turns, length, *shape), rows.dtype)
    filled.reshape(-1, *shape)[:n] = rows
    both = np.concatenate([filled, filled[:, ::-1]])  # the back stacks of all turns, then the front stacks from their ends
    both = running_sums(both)
    back, suffix = both[:turns].reshape(-1, *shape), both[turns:, ::-1].reshape(-1, *shape)
    front = np.zeros_like(back)
    if turns > 1:
        front[length:] = suffix[1 : 1 + (turns - 1) * length]
    front[length - 1 :: length] = 0
    return front[:n], back[:n]


def bitsets(minute: np.ndarray, user: np.ndarray, n: int, users: int) -> np.ndarray:
    """A row of bits for each of ``n`` minutes."""
    out = np.zeros((n, -(-users // 64)), np.uint64)
    np.bitwise_or.at(out, (minute, user >> 6), np.left_shift(np.uint64(1), (user & 63).astype(np.uint64)))
    return out


def window_counts(minute: np.ndarray, user: np.ndarray, clicks: np.ndarray, n: int, windows: Windows) -> np.ndarray:
    """The four counts (n, 4) of the windows that end at each of ``n`` minutes; minute, user and clicks are one row for each pair."""
    out = np.zeros((n, 4), np.int64)
    known, code = np.unique(user, return_inverse=True)
    bits = bitsets(minute, code, n, len(known))
    for k, length in enumerate((windows.short, windows.middle, windows.long)):
        front, back = stacked(bits, length)
        np.bitwise_or(front, back, out=back)
        out[:, k] = np.bitwise_count(back).sum(axis=1, dtype=np.int64)
    # Users with fewer clicks in all can't be hot and get no bit in the planes.
    able = np.bincount(code, clicks, len(known)) >= windows.hot
    if able.any():
        may = able[code]
        minute, code, clicks = minute[may], (np.cumsum(able) - 1)[code[may]], clicks[may]
        planes = np.stack([bitsets(minute[clicks > p], code[clicks > p], n, int(able.sum())) for p in range(windows.hot)], axis=1)
        front, back = stacked_sums(planes, windows.long)
        last = windows.hot - 1
        hot = front[:, last] | back[:, last]
        for i in range(last):
            hot |= front[:, i] & back[:, last - 1 - i]
        out[:, 3] = np.bitwise_count(hot).sum(axis=1, dtype=np.int64)
    return out


def minute_of(df: DataFrame, ts: str) -> Column:
    """Minutes since 1970, floored; times without a zone are UTC."""
    if isinstance(df.schema[ts].dataType, TimestampType):
        return F.expr(f"(unix_micros(`{ts}`) - pmod(unix_micros(`{ts}`), 60000000L)) div 60000000L")
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def rolling_users(clicks: DataFrame, windows: Windows = Windows(), block: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """kind, minute and the counts of users in the windows that end there, for each kind and minute with a click.

    ``clicks`` has click_id, ts, client_id and kind; other columns don't matter.
    Rows without a time or kind take no part. Rows with one click_id are one
    click, of copies that differ the one with the least minute, kind and client;
    rows without a click_id are each a click. A null client_id is no user, but
    its minute counts. An empty table gives no rows.
    """
    spark = clicks.sparkSession
    if block < windows.long:
        raise ValueError("a block must be as long as the longest window")
    work = Workspace(spark, "rolling")
    rows = clicks.where(F.col("ts").isNotNull() & F.col("kind").isNotNull())
    rows = rows.select(F.col("click_id").alias("id"), minute_of(clicks, "ts").alias("minute"), F.col("kind").cast("string").alias("kind"), F.col("client_id").cast("long").alias("user"))
    once = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("minute", "kind", F.col("user").isNull().alias("none"), "user")).alias("c")).select("c.minute", "c.kind", "c.user")
    once = once.unionByName(rows.where("id is null").select("minute", "kind", "user"))
    start = F.floor(F.col("minute") / block).cast("long")
    # A user counts once for each kind and minute from here on, so that a hot one has no more rows than minutes.
    pairs = work.put(once.groupBy("kind", "minute", "user").agg(F.least(F.count(F.lit(1)), F.lit(windows.hot)).cast("int").alias("n")).withColumn("block", start), "pairs")
    most = pairs.groupBy("kind", "block").count().agg(F.max("count").alias("n")).first()["n"] or 0
    shards = max(1, -(-most // shard_rows))
    # Each block also gets the minutes before it that its first windows hold.
    late = F.col("minute") - F.col("block") * block >= block - windows.long + 1
    dealt = pairs.where("user is not null").withColumn("block", F.explode(F.when(late, F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array("block"))))
    dealt = dealt.select("kind", "block", F.pmod(F.xxhash64("user"), F.lit(shards)).alias("shard"), "minute", "user", "n")

    def slide(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        first = key[1].as_py() * block - windows.long + 1
        minute, user, n = (group.column(c).to_numpy() for c in ("minute", "user", "n"))
        counts = window_counts(minute - first, user, n, block + windows.long - 1, windows)[windows.long - 1 :]
        steps = np.diff(counts, axis=0, prepend=0)
        at = np.flatnonzero(steps.any(axis=1))
        kind = pa.array([key[0].as_py()] * len(at), pa.string())
        return pa.table([kind, pa.array(at + key[1].as_py() * block), *(pa.array(steps[at, k]) for k in range(4))], names=["kind", "minute", *COUNTS])

    # A shard tells where its counts change, and by how much; changes add up over the shards.
    steps = dealt.groupBy("kind", "block", "shard").applyInArrow(slide, "kind string, minute long, " + ", ".join(f"{c} long" for c in COUNTS))
    held = pairs.select("kind", "minute").distinct().select("kind", "minute", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit(True).alias("held"))
    all_steps = steps.withColumn("held", F.lit(False)).unionByName(held).groupBy("kind", "minute").agg(*[F.sum(c).alias(c) for c in COUNTS], F.max("held").alias("held"))
    to_here = Window.partitionBy("kind", F.floor(F.col("minute") / block)).orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    return all_steps.select("kind", "minute", "held", *[F.sum(c).over(to_here).alias(c) for c in COUNTS]).where("held").drop("held")


def op12_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of all clicks over windows of 10, 60 and 720 minutes, and those with five clicks or more in the last."""
    return rolling_users(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


ROLLING_SQL = """
WITH c AS (SELECT DISTINCT click_id, kind, client_id, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS minute FROM clicks WHERE ts IS NOT NULL AND kind IS NOT NULL),
p AS (SELECT kind, minute, client_id, count(*) AS n FROM c GROUP BY ALL), m AS (SELECT DISTINCT kind, minute FROM c),
w AS (SELECT m.kind, m.minute, client_id, max(p.minute) AS last, sum(n) AS n FROM m JOIN p ON p.kind = m.kind AND p.minute BETWEEN m.minute - 719 AND m.minute WHERE client_id IS NOT NULL GROUP BY ALL)
SELECT m.kind, m.minute, count(*) FILTER (WHERE last > m.minute - 10) AS users_short, count(*) FILTER (WHERE last > m.minute - 60) AS users_middle, count(client_id) AS users_long, count(*) FILTER (WHERE n >= 5) AS hot_users
FROM m LEFT JOIN w ON w.kind = m.kind AND w.minute = m.minute GROUP BY ALL"""
