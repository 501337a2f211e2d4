"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` and reading it
back, so that a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting that removes the shuffle files of a command when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where none is set, a temporary one on the one machine of a local master.

    On a cluster each executor would write to its own disk, so there a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_already.get() if set_already.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def partitions(df: DataFrame, rows_each: int) -> int:
    """How many partitions hold the rows of ``df`` by so many each, so that a task's memory does not grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_each))


class Workspace:
    """Scratch tables of one run: ``put`` writes and rereads, ``drop`` deletes. What is left goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.named: dict[str, str] = {}
        root, files = self._open(self.root)
        files.mkdirs(root)
        files.deleteOnExit(root)

    def _open(self, path: str) -> tuple[object, object]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def put(self, df: DataFrame, table: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
        """The rows of ``df`` from a written table, in folders by the values of a column if one is named.

        Once it is written, Spark removes the shuffle files that led to it.
        """
        was = self.spark.conf.get(CLEAN_UP, "false")
        writer = df.write.mode("overwrite").option("compression", codec)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            (writer.partitionBy(by) if by else writer).parquet(self.path(table))
        finally:
            self.spark.conf.set(CLEAN_UP, was)
        return self.spark.read.schema(df.schema).parquet(self.path(table)).select(df.columns)

    def bucket(self, df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
        """The rows of ``df`` from a table in buckets of a column: a join by it with ``shuffle_hash`` on the other side neither shuffles nor sorts them."""
        name = self.named[table] = f"{table}_{uuid.uuid4().hex}".replace("-", "_")
        was = self.spark.conf.get(CLEAN_UP, "false")
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", self.path(table)).option("compression", "zstd").saveAsTable(name)
        finally:
            self.spark.conf.set(CLEAN_UP, was)
        return self.spark.table(name)

    def drop(self, *tables: str) -> None:
        """Delete these tables (all of the run's if none is named)."""
        for t in tables or tuple(self.named):
            if t in self.named:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.named.pop(t)}")
        for t in tables or ("",):
            p, files = self._open(self.path(t) if t else self.root)
            files.delete(p, True)
