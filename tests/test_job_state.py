"""Retention by timers and job events by entry of state: streams against their batch twins, across restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexweave.operators import lifecycle
from lexweave.streaming import events, job_state


def run(spark, make, source, shape, tmp_path, clock=False):
    stream = make(spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source))
    with job_state.rocks_store(spark):
        out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        if not clock:
            out.trigger(availableNow=True).start().awaitTermination()
            return
        running = out.trigger(processingTime="1 second").start()
        running.awaitTermination(10)  # it has no end; the files are read in the first seconds
        running.stop()


def test_timers_equal_the_sweep(spark, tmp_path):
    r, began = random.Random(6), datetime(2024, 1, 1)
    rows = sorted(((f"j{r.randrange(30)}", r.choice(["enriching", "matching", "completed", "failed", "pending"]), began + timedelta(minutes=r.randrange(6 * 1440), milliseconds=k)) for k in range(160)), key=lambda x: x[2])
    shape, source = "job_id string, status string, updated_at timestamp", str(tmp_path / "in")
    make = lambda s: job_state.retention_stream(s, 30, 3)
    for part in (rows[:70], rows[70:]):  # two starts of the stream; timers of the first fire in the second
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(source)
        run(spark, make, source, shape, tmp_path)
    out = spark.read.schema("job_id string, status string, at_ms bigint").parquet(str(tmp_path / "out"))
    got = {x.job_id: x.status for x in out.groupBy("job_id").agg(F.max_by("status", F.struct("at_ms", "status")).alias("status")).collect()}
    last = {}
    for job, status, at in rows:
        last[job] = (job, status, at)
    jobs = spark.createDataFrame(list(last.values()), shape)
    want = {x.job_id: x.status for x in lifecycle.job_sweep(jobs, F.lit(rows[-1][2]), 30, 3).collect()}
    assert {k: v for k, v in got.items() if v != "expired"} == want
    assert set(got) - set(want) == {k for k, v in got.items() if v == "expired"} and len(want) < len(got) and "failed" in want.values()
    stale = out.where("status = 'failed'").count()
    assert stale > sum(1 for v in want.values() if v == "failed")  # some were stale for a while, then went on


@pytest.mark.parametrize("forget", [None, 600])
def test_job_events_by_entry_equal_batch(spark, tmp_path, forget):
    rows, r = [], random.Random(5)
    for job in ("a", "b", "c"):
        for seq in range(5):
            rows.append((job, seq, "status", "", "completed" if job == "a" and seq == 3 else "running" if seq else "pending"))
            rows += [(job, seq, "annotation", f"n{i}", r.choice(["preliminary", "confirmed"])) for i in range(4) if r.random() < 0.6]
            rows += [(job, seq, "triple", f"t{i}", "") for i in range(3) if r.random() < 0.5]
    shape, source = "job_id string, seq bigint, entity string, entity_id string, state string", str(tmp_path / "in")
    for part in ("seq < 2", "seq >= 2"):
        spark.createDataFrame(rows, shape).where(part).coalesce(1).write.mode("append").parquet(source)
        run(spark, lambda s: job_state.job_events_by_entry(s, forget), source, shape, tmp_path, clock=bool(forget))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, events.job_events(spark.createDataFrame(rows, shape)).collect())) and len(got) > 20
