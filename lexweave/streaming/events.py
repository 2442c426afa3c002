"""Job event streams, rate limits and windowed counts.

The rate limiter counts accepted requests only, so it is sequential by key: a keyed state operator on streams, a fold over
each key's sorted events in batch. Both use ``admit``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


def admit(accepted: deque, at: float, most: int, window: float) -> bool:
    """Whether a request at ``at`` passes; ``accepted`` holds the times of those that did within the window."""
    while accepted and accepted[0] <= at - window:
        accepted.popleft()
    if len(accepted) >= most:
        return False
    accepted.append(at)
    return True


def rate_limit(events: DataFrame, most: int, window_s: float) -> DataFrame:
    """(event_id, user_id, allowed) of (event_id, user_id, ts): streams through sorted partitions, state of one key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, accepted = object(), deque()
        for batch in batches:
            out = []
            for user, at in zip(batch.column("user_id").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if user != key:
                    key, accepted = user, deque()
                out.append(admit(accepted, at, most, window_s))
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("user_id"), pa.array(out, pa.bool_())], ["event_id", "user_id", "allowed"])

    timed = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at")).withColumn("at", F.col("at") / 1e6)
    return timed.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInArrow(run, "event_id bigint, user_id bigint, allowed boolean")


def rate_limit_stream(events: DataFrame, most: int, window_s: float) -> DataFrame:
    """The same on a stream: state by user holds accepted times within the window, so it is bounded by ``most``."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        rows["allowed"] = [admit(accepted, at, most, window_s) for at in rows["at"]]
        state.update((list(accepted),))
        yield rows[["event_id", "user_id", "allowed"]]

    timed = events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "event_id bigint, user_id bigint, allowed boolean", "accepted array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total): event-time windows; ``late`` sets a watermark on streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(job_id, entity, entity_id, change) between two snapshots (job_id, entity, entity_id, state): the batch twin of the job event stream."""
    keys = ["job_id", "entity", "entity_id"]
    both = old.withColumnRenamed("state", "was").join(new.withColumnRenamed("state", "now"), keys, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select(*keys, change.alias("change")).where("change IS NOT NULL")


#: The event of a new entity, by kind; an annotation's depends on its state.
ADDED = {"individual": "individual_added", "property": "property_added", "triple": "triple_added", "document_type": "document_type", "pos": "pos_ready", "activity": "activity"}
ENDED = ("completed", "failed")


def job_events(snapshots: DataFrame) -> DataFrame:
    """(job_id, seq, event, entity_id): what changes from one snapshot of a job to the next, up to its first ended one.

    snapshots (job_id, seq, entity, entity_id, state) hold all rows of a job at each seq, among them one of entity ``status``.
    An annotation is new when the snapshot before lacks it, so one that comes back is new again; other entities are added once.
    """
    status = snapshots.where("entity = 'status'").groupBy("job_id", "seq").agg(F.min("state").alias("status"))
    order = Window.partitionBy("job_id").orderBy("seq")
    ended = F.max(F.col("status").isin(*ENDED).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    turns = status.withColumns({"prev": F.lag("seq").over(order), "was": F.lag("status").over(order), "ended": F.coalesce(ended, F.lit(0))}).where("ended = 0")  # a row a snapshot
    of_status = F.array_compact(F.array(F.when(~F.col("status").eqNullSafe(F.col("was")), F.lit("status")), F.when(F.col("status").isin(*ENDED), F.lit("complete"))))
    out = turns.select("job_id", "seq", F.explode(of_status).alias("event"), F.col("status").alias("entity_id"))
    rows = snapshots.join(turns.select("job_id", "seq", "prev"), ["job_id", "seq"])
    notes = rows.where("entity = 'annotation'").groupBy("job_id", "seq", "prev", "entity_id").agg(F.min("state").alias("state"))
    after = notes.join(turns.select("job_id", F.col("seq").alias("next"), F.col("prev").alias("seq")), ["job_id", "seq"], "left")
    old = after.where("next IS NOT NULL").select("job_id", F.col("next").alias("seq"), "entity_id", F.col("state").alias("old"))
    both = notes.select("job_id", "seq", "entity_id", "state").join(old, ["job_id", "seq", "entity_id"], "full_outer")
    change = (
        F.when(F.col("state").isNull(), "annotation_removed").when(F.col("old").isNull(), F.when(F.col("state") == "preliminary", "preliminary_annotation").otherwise("annotation"))
        .when(F.col("state") != F.col("old"), "annotation_update")
    )
    out = out.unionByName(both.select("job_id", "seq", change.alias("event"), "entity_id").where("event IS NOT NULL"))
    name = F.coalesce(*[F.when(F.col("entity") == kind, F.lit(event)) for kind, event in ADDED.items()])
    first = rows.where(F.col("entity").isin(*ADDED)).groupBy("job_id", "entity", "entity_id").agg(F.min("seq").alias("seq"))
    return out.unionByName(first.select("job_id", "seq", name.alias("event"), "entity_id"))


def job_events_stream(snapshots: DataFrame) -> DataFrame:
    """The same on a stream of snapshots that arrive whole and in order: state by job holds the last states and the ids seen."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, notes, seen = state.get if state.exists else (None, [], [])
        notes, seen, out = dict(notes), set(seen), []
        for seq, now in pd.concat(list(frames)).sort_values("seq").groupby("seq"):
            if status in ENDED:
                break
            current = dict(now[now["entity"] == "annotation"].groupby("entity_id")["state"].min())
            new_status = now[now["entity"] == "status"]["state"].min()
            if new_status != status:
                out.append((seq, "status", new_status))
            out += [(seq, "annotation_removed", i) for i in notes if i not in current]
            out += [(seq, "preliminary_annotation" if s == "preliminary" else "annotation", i) for i, s in current.items() if i not in notes]
            out += [(seq, "annotation_update", i) for i, s in current.items() if i in notes and notes[i] != s]
            for entity, i in now[now["entity"].isin(ADDED)][["entity", "entity_id"]].drop_duplicates().itertuples(index=False):
                if f"{entity}:{i}" not in seen:
                    seen.add(f"{entity}:{i}")
                    out.append((seq, ADDED[entity], i))
            if new_status in ENDED:
                out.append((seq, "complete", new_status))
            status, notes = new_status, current
        state.update((status, list(notes.items()), sorted(seen)))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["job_id", "seq", "event", "entity_id"])

    kept = "status string, notes array<struct<id: string, state: string>>, seen array<string>"
    return snapshots.groupBy("job_id").applyInPandasWithState(step, "job_id string, seq bigint, event string, entity_id string", kept, "append", GroupStateTimeout.NoTimeout)
