"""The dictionary ruler: which labels become patterns, a scan without overlaps, preliminary annotations, property spans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators import match

#: The shortest label that is looked for, and words that are no concepts however they are labelled.
SHORTEST = 3
STOP = """
    a an the to of in on at by for or
    and is it be as do no so up if my
    me he we am us go re al de la le
    mr ms dr st vs id ie eg etc per via
    not but has had was are its may can did
    she his her him our who how all any new
    one two out own set use way day get see
    now old end put run let say too yet off
    try ask got met cut pay due add
""".split()


def patterns(winners: DataFrame) -> DataFrame:
    """(label_key, iri, label_type, n_words) of the labels (label_key, iri, label_type) that are long enough and no stop word."""
    some = winners.where((F.length("label_key") >= SHORTEST) & ~F.lower("label_key").isin(*STOP))
    return some.select("label_key", "iri", "label_type", F.size(F.filter(F.split("label_key", r"\s+"), lambda w: w != "")).alias("n_words"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, start, end, label_key): matches of the patterns without overlaps, those of most words first, then from the left."""
    hits = match.match(docs, known).join(F.broadcast(known.select("label_key", "n_words")) if _small(known) else known.select("label_key", "n_words"), "label_key")
    return match.longest_first(hits, ["doc_id"], [-F.col("n_words")], ["label_key"]).drop("n_absorbed")


def _small(known: DataFrame) -> bool:
    """Whether the dictionary is of the size that also goes to executors as an automaton."""
    return known.agg(F.coalesce(F.sum(F.octet_length("label_key")), F.lit(0))).first()[0] <= match.AUTOMATON_BYTES


def preliminary(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(ann_id, doc_id, start, end, text, iri, match_type, confidence, state): an annotation for each match of the scan."""
    found = scan(docs, known).join(known, "label_key")
    key = F.substring(F.sha2(F.concat_ws("|", "doc_id", "start", "end", "iri"), 256), 1, 16)
    return found.select(
        key.alias("ann_id"), "doc_id", "start", "end", F.col("label_key").alias("text"), "iri", F.col("label_type").alias("match_type"),
        match.confidence(F.col("label_type"), F.col("label_key")).alias("confidence"), F.lit("preliminary").alias("state"),
    )


def keep_properties(spans: list[tuple[int, int, float, int]]) -> list[int]:
    """Numbers of the spans (start, end, confidence, number) that stay: of equal ones the surest, nested ones all, of crossing ones the longer."""
    kept: list[tuple[int, int, float, int]] = []
    for span in sorted(spans, key=lambda s: (s[0], s[0] - s[1], -s[2], s[3])):
        a, b, sure, _ = span
        for k, (c, d, other, _) in enumerate(kept):
            if a >= d or b <= c:
                continue
            same = (a, b) == (c, d)
            if not same and ((a >= c and b <= d) or (c >= a and d <= b)):
                continue
            if (sure > other) if same else (b - a > d - c):
                kept[k] = span
            break
        else:
            kept.append(span)
    return [s[3] for s in kept]


def dedup_properties(spans: DataFrame) -> DataFrame:
    """Property spans (doc_id, start, end, iri, confidence) after overlap resolution, island by island."""
    isles = match.islands(spans, ["doc_id"])
    grouped = isles.groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(F.struct("start", "end", "iri", "confidence"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, spans in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                for k in keep_properties([(s["start"], s["end"], s["confidence"], i) for i, s in enumerate(spans)]):
                    rows.append((doc, *spans[k].values()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "end", "iri", "confidence"])

    return grouped.select("doc_id", "spans").mapInArrow(run, "doc_id bigint, start int, end int, iri string, confidence double")
