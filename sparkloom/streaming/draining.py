"""A queue of jobs that is drained as they land: attempts, deferral by capacity, and a global step once nothing is left.

The queue is a table whose versions are published with the number of the batch
that made them. A batch that is run again after a failure finds its number there
and does nothing, so a stream that is stopped and started gives what one run gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.storage import Workspace
from sparkloom.versions import Versions

QUEUE = "job long, place long, tries int, state string, error string"
#: Attempts that a job has.
TRIES = 3


class Drain:
    """The queue under a folder that all executors share.

    ``run`` takes due jobs (job) and gives a row (job, error) for each, the error
    null where it went well; a job that it doesn't name has failed. ``capacity``
    says how many jobs may start now, none if 0. ``finish`` is given all done jobs
    once no job waits, and only after some were done since it was last called.
    """

    def __init__(self, spark: SparkSession, root: str, run: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], None], capacity: Callable[[], int], tries: int = TRIES) -> None:
        self.spark, self.run, self.finish, self.capacity, self.tries = spark, run, finish, capacity, tries
        self.versions = Versions(spark, root)

    def jobs(self) -> DataFrame:
        """job, place, tries, state (queued, done or failed) and the last error of every job so far."""
        folder = self.versions.latest()[1].get("jobs")
        return self.versions.read(folder, QUEUE) if folder else self.spark.createDataFrame([], QUEUE)

    def take(self, batch: DataFrame, number: int) -> None:
        """Queue a batch's jobs (job, place) and work on the queue while there is capacity. Jobs that are known are not queued again; null ones are left out."""
        seen, state = self.versions.latest()
        if state.get("batch", -1) >= number:
            return
        work = Workspace(self.spark, "drain")
        old = self.jobs()
        new = batch.where("job is not null").groupBy("job").agg(F.min("place").cast("long").alias("place")).select(F.col("job").cast("long").alias("job"), "place")
        new = new.join(old.select("job"), "job", "left_anti").select("job", "place", F.lit(0).alias("tries"), F.lit("queued").alias("state"), F.lit(None).cast("string").alias("error"))
        now, fresh, turn = work.put(old.unionByName(new), "turn-0"), bool(state.get("fresh", False)), 0
        while (room := self.capacity()) > 0:
            # Fewest tries first, then in the order of their places: a job that failed waits behind those that have not been tried.
            due = work.put(now.where("state = 'queued'").orderBy("tries", "place", "job").limit(room).select("job"), f"due-{turn}")
            if due.limit(1).count() == 0:
                break
            told = work.put(self.run(due).select("job", F.col("error").alias("told"), F.lit(True).alias("named")), f"told-{turn}")
            told = due.join(told, "job", "left").select("job", F.lit(True).alias("due"), F.when(F.col("named"), F.col("told")).otherwise("no answer").alias("told"))
            tries = F.col("tries") + F.when(F.col("due"), 1).otherwise(0)
            after = F.when(F.col("due").isNull(), F.col("state")).when(F.col("told").isNull(), "done").when(tries >= self.tries, "failed").otherwise("queued")
            joined = now.join(told, "job", "left")
            now = work.put(joined.select("job", "place", tries.cast("int").alias("tries"), after.alias("state"), F.when(F.col("due"), F.col("told")).otherwise(F.col("error")).alias("error")), f"turn-{turn + 1}")
            fresh = fresh or told.where("told is null").limit(1).count() > 0
            turn += 1
        if fresh and now.where("state = 'queued'").limit(1).count() == 0:
            self.finish(now.where("state = 'done'"))
            fresh = False
        folder = self.versions.write(now, "jobs")
        self.versions.publish(seen, {"jobs": folder, "batch": number, "fresh": fresh})
        work.drop()

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Drain what a stream of jobs (job, place) brings; the stream ends when all that has landed is taken."""
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
