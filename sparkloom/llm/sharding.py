"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records uniformly, by a seeded hash, into buckets that fit
in a task's memory, one bucket for each partition; Spark's ``shuffle``, which is a
Fisher-Yates shuffle, orders each bucket, and it is written. The buckets end to
end are one random order of all records. Pass two reads them, gives each record
its place by the sizes of the buckets before, and writes it to its shard; row
counts of shards differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import documents
from sparkloom.storage import Workspace

#: Bytes of text that one bucket holds on average, and the share of them that equal records may fill before they are dealt out.
BUCKET_BYTES, SAME_SHARE = 32 << 20, 0.25
#: Rows of 16 bytes that are broadcast at most; larger tables are joined by a shuffle.
BROADCAST_ROWS = 4_000_000
#: Buckets whose sizes one task adds up.
BLOCK = 1024


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A table of that many short rows, to be broadcast if they are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def shard_records(
    df: DataFrame, n_shards: int, path: str, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Write ``df`` to ``path`` as ``shard=<n>/`` folders and return what was written.

    The result has shard, slot (gapless from 0 in each shard) and record, a
    struct with every input column, so extra columns with any name are kept.
    Law ``rows``: shard sizes differ by one row at most. Null ids and texts are
    records like others (a null text has no bytes), repeated rows each get a
    slot, an empty table gives empty shards. A record's bucket depends on its id
    and text; records equal in both that would fill a good part of a bucket are
    dealt out to all buckets by their places. Columns need an order (no maps).
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = df.sparkSession
    work = Workspace(spark, "sharding-passes")
    text, key = F.col(text_col).cast("string"), F.col(id_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(8)).cast("long")
    keyed = df.select(F.xxhash64(F.lit(seed), key, text).alias("h"), size.alias("size"), F.monotonically_increasing_id().alias("place"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"))
    same = work.put(keyed.groupBy("h").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).groupBy(F.when((F.col("bytes") > SAME_SHARE * bucket_bytes) & (F.col("rows") > 1), F.col("h")).alias("h")).agg(F.sum("bytes").alias("bytes")), "same")
    hot = same.where("h is not null").select(F.col("h").alias("hot"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(same.agg(F.sum("bytes").alias("b")).first()["b"] or 0) // bucket_bytes))
    placed = keyed.withColumn("hot", F.lit(None).cast("long"))
    if n_hot := hot.count():
        placed = keyed.join(bounded(hot, n_hot), F.col("h") == F.col("hot"), "left")
    salt = F.when(F.col("hot").isNull(), F.lit(0).cast("long")).otherwise(F.col("place"))
    bucket = F.pmod(F.xxhash64("h", salt, F.lit(seed + 1)), F.lit(buckets)).cast("int")
    scattered = placed.select(bucket.alias("bucket"), "h", "record").repartitionById(buckets, "bucket")
    # One bucket is one partition and one group: its size is that of a task's memory.
    shuffled = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("h", "record"))).alias("rows"))
    shuffled = work.put(shuffled.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("pos", "row")).select("bucket", "pos", F.col("row.record").alias("record")), "buckets")
    counts = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).withColumn("block", F.expr(f"bucket div {BLOCK}"))
    n = max(1, counts.agg(F.sum("rows").alias("n")).first()["n"] or 0)
    # The records before a bucket: those of the blocks before its own (one row for each block) and of the buckets before it there.
    blocks = counts.groupBy("block").agg(F.sum("rows").alias("whole"))
    blocks = blocks.select("block", (F.sum("whole").over(Window.orderBy("block")) - F.col("whole")).alias("earlier"))
    inside = F.sum("rows").over(Window.partitionBy("block").orderBy("bucket")) - F.col("rows")
    starts = counts.select("bucket", "block", inside.alias("inside")).join(blocks, "block").select("bucket", (F.col("earlier") + F.col("inside")).alias("start"))
    shard = F.expr(f"int((start + pos) * {n_shards}L div {n}L)")
    slot = F.expr(f"start + pos - (shard * {n}L + {n_shards - 1}L) div {n_shards}L")
    out = shuffled.join(bounded(starts, buckets), "bucket").withColumn("shard", shard).select("shard", slot.alias("slot"), "record")
    out.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(path)
    work.drop()
    schema = out.select("slot", "record", "shard").schema
    return spark.read.schema(schema).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23; the digest is read back from the written shards. A null text has the checksum of no bytes, 0."""
    work = Workspace(spark, "sharding")
    out = shard_records(documents(spark, sf_dir), 24, work.path("shards"))
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return out.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
