"""State of jobs on a stream: retention by event-time timers, and job events with an entry of state for each thing seen.

State lives in the RocksDB store, entry by entry, so a batch rewrites what it changes and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexweave.streaming.events import ADDED, ENDED

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DONE = ("completed", "failed", "pending")
MINUTE_MS, DAY_MS = 60_000, 86_400_000


@contextmanager
def rocks_store(spark: SparkSession):
    """The state store that these operators need, for streams that start inside; the session's own setting comes back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


class Retention(StatefulProcessor):
    """Keeps a job's last status; timers tell when a running one is stale and when any is too old."""

    def __init__(self, stale_minutes: int, retention_days: int):
        self.stale, self.kept = stale_minutes * MINUTE_MS, retention_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", "status string, at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.job.get() if self.job.exists() else None
        at, status = max((r.at_ms, r.status) for r in rows)
        if known is None or at >= known[1]:
            self.job.update((status, at))
            if status not in DONE:
                self.handle.registerTimer(at + self.stale)
            self.handle.registerTimer(at + self.kept)
            yield Row(job_id=key[0], status=status, at_ms=at)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if not self.job.exists():
            return
        status, at = self.job.get()
        if due == at + self.kept:
            self.job.clear()
            yield Row(job_id=key[0], status="expired", at_ms=due)
        elif due == at + self.stale and status not in DONE:  # a timer of an earlier change has nothing to say
            self.job.update(("failed", at))
            yield Row(job_id=key[0], status="failed", at_ms=due)

    def close(self) -> None:
        pass


def retention_stream(changes: DataFrame, stale_minutes: int, retention_days: int, late: str = "0 seconds") -> DataFrame:
    """(job_id, status, at_ms): each change of a stream of jobs (job_id, status, updated_at), ``failed`` when a running job has had none for too
    long and ``expired`` when it is dropped. The last row of a job is its state at the watermark; changes that come later than ``late`` are left out."""
    timed = changes.select("job_id", "status", F.col("updated_at").cast("timestamp").alias("updated_at")).withWatermark("updated_at", late)
    keyed = timed.withColumn("at_ms", F.unix_millis("updated_at")).groupBy("job_id")
    return keyed.transformWithState(Retention(stale_minutes, retention_days), "job_id string, status string, at_ms bigint", "Append", "EventTime")


class JobEvents(StatefulProcessor):
    """What changes from one snapshot of a job to the next; an entry of state for each annotation and each thing that has been told."""

    def __init__(self, forget_ms: int | None):
        self.forget = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string", self.forget)
        self.notes = handle.getMapState("notes", "id string", "state string", self.forget)
        self.seen = handle.getMapState("seen", "entity string, id string", "told boolean", self.forget)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        turns: dict[int, list[Row]] = {}
        for r in rows:
            turns.setdefault(r.seq, []).append(r)
        status = self.status.get()[0] if self.status.exists() else None
        tell = lambda seq, event, i: Row(job_id=key[0], seq=seq, event=event, entity_id=i)
        for seq in sorted(turns):
            if status in ENDED:
                return
            now = turns[seq]
            new = min((r.state for r in now if r.entity == "status"), default=None)
            if new != status:
                yield tell(seq, "status", new)
            current: dict[str, str] = {}
            for r in now:
                if r.entity == "annotation":
                    current[r.entity_id] = min(current.get(r.entity_id, r.state), r.state)
            for (i,) in list(self.notes.keys()):
                if i not in current:
                    self.notes.removeKey((i,))
                    yield tell(seq, "annotation_removed", i)
            for i, state in current.items():
                old = self.notes.getValue((i,))[0] if self.notes.containsKey((i,)) else None
                if old != state:
                    self.notes.updateValue((i,), (state,))
                    yield tell(seq, "annotation_update" if old is not None else "preliminary_annotation" if state == "preliminary" else "annotation", i)
            for entity, i in dict.fromkeys((r.entity, r.entity_id) for r in now if r.entity in ADDED):
                if not self.seen.containsKey((entity, i)):
                    self.seen.updateValue((entity, i), (True,))
                    yield tell(seq, ADDED[entity], i)
            if new in ENDED:
                yield tell(seq, "complete", new)
            if new is not None:
                self.status.update((new,))
            status = new

    def close(self) -> None:
        pass


def job_events_by_entry(snapshots: DataFrame, forget_minutes: int | None = None) -> DataFrame:
    """(job_id, seq, event, entity_id) of a stream of snapshots (job_id, seq, entity, entity_id, state) that arrive whole and in order, as ``job_events``
    tells them. With ``forget_minutes``, what has not changed for so long is forgotten; such a stream goes on until it is stopped, as clocks do."""
    forget = forget_minutes * MINUTE_MS if forget_minutes else None
    return snapshots.groupBy("job_id").transformWithState(JobEvents(forget), "job_id string, seq bigint, event string, entity_id string", "Append", "ProcessingTime" if forget else "None")
