"""Job events and landed documents as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def landed(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    """Parquet files as they land in a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def latest_state(events: DataFrame, job: str, order: list[str], state: str) -> DataFrame:
    """The state that each job's last event leaves it in; the same on a table and on a stream (output mode complete or update)."""
    return events.groupBy(job).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count(F.lit(1)).alias("events"))


def windowed_counts(events: DataFrame, at: str, kind: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in windows of event time; later ones than the watermark are left out. An addition to the engine."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.window("_at", length), kind).agg(F.count(F.lit(1)).alias("n"))


def ingest(stream: DataFrame, target: str, checkpoint: str, step) -> StreamingQuery:  # noqa: ANN001
    """Run ``step`` (DataFrame to DataFrame) on each batch and append the result; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
