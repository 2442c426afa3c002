"""Versions of the ontology's tables in a shared folder, with a log that names the current one.

A version is written before the log names it, so a job that dies leaves the version before it in force. An entry of the log
is created only if it is absent: of two publishers one is first, the other looks again and comes after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.sources import commit_log

TRIES = 20


def content_version(tables: dict[str, DataFrame]) -> str:
    """A hash of the tables' rows, whatever their order."""
    parts = []
    for name, df in sorted(tables.items()):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("a"), F.sum(F.hash(*sorted(df.columns)).cast("decimal(38,0)")).alias("b")).first()
        parts.append(f"{name}:{','.join(sorted(df.columns))}:{row.n}:{row.a}:{row.b}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


def log(spark: SparkSession, base: str) -> list[tuple[int, str, str]]:
    """Entries of the log in order: one for each publication or rollback. Reading writes nothing."""
    return [(n, e["version"], e["action"]) for n, e in commit_log.entries(spark, base)]


def current(spark: SparkSession, base: str) -> str | None:
    entries = log(spark, base)
    return entries[-1][1] if entries else None


def _append(spark: SparkSession, base: str, action: str, decide: Callable[[list[tuple[int, str, str]]], str]) -> str:
    """The version that ``decide`` picks from the log, named by the log; decided anew where another writer was first."""
    for _ in range(TRIES):
        entries = log(spark, base)
        version = decide(entries)
        if action == "publish" and entries and entries[-1][1] == version:
            return version
        try:
            commit_log.append(spark, base, entries[-1][0] + 1 if entries else 0, {"version": version, "action": action})
            return version
        except commit_log.Conflict:
            continue
    raise commit_log.Conflict(f"{base} has changed {TRIES} times")


def publish(spark: SparkSession, base: str, tables: dict[str, DataFrame]) -> str:
    """The version of ``tables``, now in force; the same content as the current version writes nothing. Without concepts it is an error."""
    if tables["concepts"].isEmpty():
        raise ValueError("an ontology without concepts")
    version = content_version(tables)
    if version == current(spark, base):
        return version
    if version not in {v for _, v, _ in log(spark, base)}:  # what the log names is whole, and may be read right now
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{base}/version={version}/{name}")
    return _append(spark, base, "publish", lambda entries: version)


def rollback(spark: SparkSession, base: str) -> str:
    """The version before the current one, in force again; a second rollback returns to the later one."""

    def earlier(entries: list[tuple[int, str, str]]) -> str:
        found = [v for _, v, _ in entries if v != entries[-1][1]]
        if not found:
            raise ValueError("no earlier version")
        return found[-1]

    return _append(spark, base, "rollback", earlier)


def load(spark: SparkSession, base: str, name: str, version: str | None = None) -> DataFrame:
    version = version or current(spark, base)
    if version is None:
        raise ValueError("no version is published")
    return spark.read.parquet(f"{base}/version={version}/{name}")
