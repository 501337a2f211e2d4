"""A stream that is stopped and started drains a queue as one run does."""

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import jobs
from sparkloom.streaming.draining import Drain


def states(drain):
    return sorted((r["job"], r["tries"], r["state"], r["error"]) for r in drain.jobs().collect())


def test_a_restarted_stream_gives_what_one_run_gives(spark, tmp_path):
    rows = spark.range(12).select(F.col("id").alias("job"), F.col("id").alias("place"))
    for k in range(3):
        rows.where(f"job % 3 = {k} or job = 0").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    tried = {}

    def run(due):
        out = []
        for r in due.collect():
            n = tried[r["job"]] = tried.get(r["job"], 0) + 1
            if r["job"] != 7:  # which is never answered for
                out.append((r["job"], "busy" if r["job"] % 4 == 1 and n == 1 else "bad" if r["job"] % 5 == 3 else None))
        return spark.createDataFrame(out, "job long, error string")

    want = sorted((j, 3 if j == 7 or j % 5 == 3 else 2 if j % 4 == 1 else 1, "failed" if j == 7 or j % 5 == 3 else "done", "no answer" if j == 7 else "bad" if j % 5 == 3 else None) for j in range(12))
    finished = []
    one = Drain(spark, f"file://{tmp_path}/one", run, lambda done: finished.append(done.count()), lambda: 5)
    one.take(rows, 0)
    assert states(one) == want and finished == [len([w for w in want if w[2] == "done"])]

    # The same as a stream with a file at a time; the first run is out of capacity and then breaks.
    tried.clear()
    rooms = iter([2, 0])
    stream = lambda: jobs.landed(spark, f"{tmp_path}/in/*", rows.schema, 1)
    ends = []
    broken = Drain(spark, f"file://{tmp_path}/two", run, lambda done: ends.append(done.count()), lambda: next(rooms))
    with pytest.raises(Exception):
        broken.start(stream(), f"{tmp_path}/ck").awaitTermination(200)
    assert sum(s == "queued" for _, _, s, _ in states(broken)) and not ends
    whole = Drain(spark, f"file://{tmp_path}/two", run, lambda done: ends.append(done.count()), lambda: 50)
    whole.start(stream(), f"{tmp_path}/ck").awaitTermination(200)
    assert states(whole) == want and ends[-1] == finished[0]
    before = whole.versions.latest()
    whole.take(rows, before[1]["batch"])
    assert whole.versions.latest() == before
