"""Joins of ranges with spans within documents, by buckets of offsets, so that a long document is no single group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters in a bucket of offsets.
BUCKET = 2048


def _bucket(c: Column) -> Column:
    return F.floor(c / BUCKET).cast("int")


def overlapping(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """Ranges (doc_id, lo, hi, ...) with the spans (doc_id, start, end, ...) that share a character with them.

    Both are dealt to all buckets that they touch; a pair is taken in the first bucket that both touch, so it comes once.
    Empty ranges and spans meet nothing.
    """
    r = ranges.where("lo < hi").withColumn("_b", F.explode(F.sequence(_bucket(F.col("lo")), _bucket(F.col("hi") - 1))))
    s = spans.where("start < end").withColumn("_b", F.explode(F.sequence(_bucket(F.col("start")), _bucket(F.col("end") - 1))))
    both = r.join(s, ["doc_id", "_b"]).where("lo < end AND start < hi")
    return both.where(F.col("_b") == F.greatest(_bucket(F.col("lo")), _bucket(F.col("start")))).drop("_b")


def inside(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """Ranges with the spans that lie within them; a span meets the ranges of its first bucket only. Empty spans count where they stand."""
    r = ranges.withColumn("_b", F.explode(F.sequence(_bucket(F.col("lo")), _bucket(F.greatest("lo", "hi")))))
    return r.join(spans.withColumn("_b", _bucket(F.col("start"))), ["doc_id", "_b"]).where("start >= lo AND end <= hi").drop("_b")
