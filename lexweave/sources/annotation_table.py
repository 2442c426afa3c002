"""A versioned table of annotations: a change rewrites the buckets that it touches, and a log names each bucket's files.

Rows are (ann_id, concepts, state, dismissed_seq): concepts are iris by rank, the first is the primary one. Changes are rows
(seq, ann_id, action, k): ``promote`` concept k, ``reject`` or ``restore``; each has an outcome, errors included, which is
kept as the annotation's lineage. A writer whose buckets another one has changed in between begins again; one whose buckets
are its own only takes the next number of the log.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources import commit_log

BUCKETS = 16
TRIES = 20
ROWS = "ann_id string, concepts array<string>, state string, dismissed_seq bigint"
OUTCOMES = "seq bigint, ann_id string, action string, outcome string"


def bucket_of(column: str = "ann_id"):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def step(row: list, action: str, k: int | None, seq: int) -> str:
    """Change ``row`` [concepts, state, dismissed_seq] in place; the outcome."""
    concepts, state, _ = row
    if action == "promote":
        if k is None or not 0 <= k < len(concepts):
            return "bad_index"
        if k == 0:
            return "already_primary"
        concepts[0], concepts[k] = concepts[k], concepts[0]
        return "promoted"
    if action == "reject":
        if state == "rejected":
            return "already_rejected"
        row[1:] = ["rejected", seq]
        return "rejected"
    if action == "restore":
        if state != "rejected":
            return "not_rejected"
        row[1:] = ["confirmed", None]
        return "restored"
    return "unknown_action"


def fold(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """(kind, bucket, ROWS, seq, action, outcome): each row after its actions in order of seq, and the outcomes; kind is row or outcome.

    Partitions are sorted and streamed through, so a task holds one annotation, however many its actions.
    """
    first = rows.select("ann_id", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("int").alias("k"), "concepts", "state", "dismissed_seq")
    then = actions.select("ann_id", F.col("seq").cast("long").alias("seq"), "action", F.col("k").cast("int").alias("k"), *[F.lit(None).cast(t).alias(c) for c, t in (("concepts", "array<string>"), ("state", "string"), ("dismissed_seq", "long"))])
    both = first.unionByName(then).withColumn("bucket", bucket_of())
    names = ["kind", "bucket", "ann_id", "concepts", "state", "dismissed_seq", "seq", "action", "outcome"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, where = None, None, None  # the annotation that is being changed
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["ann_id"] != key or where is None:
                    if held is not None:
                        out.append(("row", where, key, *held, None, None, None))
                    held, key, where = None, x["ann_id"], x["bucket"]
                if x["seq"] is None:
                    held = [list(x["concepts"] or []), x["state"], x["dismissed_seq"]]
                else:
                    outcome = "not_found" if held is None else step(held, x["action"], x["k"], x["seq"])
                    out.append(("outcome", x["bucket"], x["ann_id"], None, None, None, x["seq"], x["action"], outcome))
            if out:
                yield pack(out)
        if held is not None:
            yield pack([("row", where, key, *held, None, None, None)])

    dealt = both.repartition("ann_id").sortWithinPartitions("ann_id", F.asc_nulls_first("seq"))
    return dealt.mapInArrow(run, "kind string, bucket int, ann_id string, concepts array<string>, state string, dismissed_seq bigint, seq bigint, action string, outcome string")


def _files(base: str, mapping: dict[str, str], buckets: list[int] | None = None) -> list[str]:
    return [f"{base}/data/{w}/kind=row/bucket={b}" for b, w in sorted(mapping.items()) if w and (buckets is None or int(b) in buckets)]


def _read(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths) if paths else spark.createDataFrame([], schema)


def create(spark: SparkSession, base: str, rows: DataFrame) -> int:
    """The first version: of repeated ann_ids one row stays."""
    write, empty = uuid.uuid4().hex, spark.createDataFrame([], "seq bigint, ann_id string, action string, k int")
    fold(rows.dropDuplicates(["ann_id"]), empty).write.partitionBy("kind", "bucket").parquet(f"{base}/data/{write}")
    found = [r.bucket for r in spark.read.parquet(f"{base}/data/{write}").select("bucket").distinct().collect()] if not rows.isEmpty() else []
    commit_log.append(spark, base, 0, {"write": write, "touched": found, "buckets": {str(b): write for b in found}})
    return 0


def read(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The rows of the last version, or of an earlier one."""
    entry = commit_log.last(spark, base) if version is None else next((e for e in commit_log.entries(spark, base, version - 1) if e[0] == version), None)
    if entry is None:
        raise ValueError(f"no version {version if version is not None else ''} of {base}")
    return _read(spark, _files(base, entry[1]["buckets"]), ROWS)


def change(spark: SparkSession, base: str, make: Callable[[DataFrame], DataFrame]) -> int:
    """Apply the changes that ``make`` derives from the current rows; the new version's number.

    ``make`` is called again where another writer has changed a bucket that these changes touch.
    """
    for _ in range(TRIES):
        number, seen = commit_log.last(spark, base)
        actions = make(_read(spark, _files(base, seen["buckets"]), ROWS)).withColumn("bucket", bucket_of())
        touched = sorted(r.bucket for r in actions.select("bucket").distinct().collect())
        if not touched:
            return number
        write = uuid.uuid4().hex
        fold(_read(spark, _files(base, seen["buckets"], touched), ROWS), actions).write.partitionBy("kind", "bucket").parquet(f"{base}/data/{write}")
        made = {r.bucket for r in spark.read.parquet(f"{base}/data/{write}").where("kind = 'row'").select("bucket").distinct().collect()}
        while True:
            buckets = seen["buckets"] | {str(b): write if b in made else "" for b in touched}
            try:
                commit_log.append(spark, base, number + 1, {"write": write, "touched": touched, "buckets": buckets})
                return number + 1
            except commit_log.Conflict:
                later = commit_log.entries(spark, base, number)
                if not later or any(set(e["touched"]) & set(touched) for _, e in later):
                    break  # those buckets are not what these changes were made from
                number, seen = later[-1]
    raise commit_log.Conflict(f"{base} has changed {TRIES} times")


def outcomes(spark: SparkSession, base: str) -> DataFrame:
    """OUTCOMES of all changes of all versions: the lineage of the annotations."""
    paths = [f"{base}/data/{e['write']}/kind=outcome" for n, e in commit_log.entries(spark, base) if n]
    return _read(spark, paths, OUTCOMES) if paths else spark.createDataFrame([], OUTCOMES)


def promote_everywhere(old_iri: str, new_iri: str, seq: int, ann_ids: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """For ``change``: where ``old_iri`` is primary and ``new_iri`` a backup, the two swap; in the listed annotations only, if there is a list."""

    def make(rows: DataFrame) -> DataFrame:
        hit = rows.where((F.get("concepts", F.lit(0)) == old_iri) & (F.col("ann_id").isin(ann_ids) if ann_ids is not None else F.lit(True)))
        at = F.array_position(F.slice("concepts", 2, F.greatest(F.size("concepts"), F.lit(1))), new_iri)
        return hit.withColumn("k", at.cast("int")).where("k > 0").select(F.lit(seq).cast("long").alias("seq"), "ann_id", F.lit("promote").alias("action"), "k")

    return make


def reject_everywhere(iri: str, seq: int) -> Callable[[DataFrame], DataFrame]:
    """For ``change``: all annotations of a primary concept that are not rejected yet."""
    return lambda rows: rows.where((F.get("concepts", F.lit(0)) == iri) & (F.col("state") != "rejected")).select(F.lit(seq).cast("long").alias("seq"), "ann_id", F.lit("reject").alias("action"), F.lit(None).cast("int").alias("k"))
