"""Annotation by document and the progressive pipeline: brute force, stops between stages, repeated batches."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lexweave import catalog_progress
from lexweave.operators import document_patterns, match, reconcile
from lexweave.streaming import progressive

DOC = "doc_id bigint, text string"


def test_match_by_document_equals_a_finder_for_each(spark):
    r = random.Random(4)
    words = ["a", "ab", "b-c", "c", "é_1", "İx", "d's", "e.", "(f"]
    docs = [(k, r.choice([" ", "  ", "-", "\n"]).join(r.choice(words) for _ in range(r.randint(0, 60)))) for k in range(20)] + [(50, None), (51, "")]
    labels = []
    for k, t in docs:
        low = (t or "").lower()
        for _ in range(25):
            a = r.randrange(len(low)) if low else 0
            labels.append((k, low[a : a + r.choice([1, 2, 3, 5, 8, 13, 21, 34, 60])]))
        labels += [(k, " a"), (k, "- "), (k, "a"), (k, "zzz"), (k, ""), (k, None), (k, "a")]
    got = match.match_by_document(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(labels, "doc_id bigint, label_key string"))
    want = {(k, a, b, v) for k, t in docs for a, b, v in match.Finder(sorted({v for d, v in labels if d == k and v})).hits((t or "").lower())}
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 300


def test_match_anchor_with_a_very_long_label(spark):
    text = " ".join(f"w{k % 7}" for k in range(300))
    labels = [" ".join(f"w{k % 7}" for k in range(200)), "w1 w2", "w6 w0 w1 w2 w3", "w6 w0 w1 w2 w3-", "w0 w1 w2 w3 w4 w5 w6 w0 w2"]
    got = match.match_anchor(spark.createDataFrame([(1, text)], DOC), spark.createDataFrame([(v,) for v in labels], "label_key string"))
    assert sorted(map(tuple, got.collect())) == sorted((1, a, b, v) for a, b, v in match.Finder(labels).hits(text))


def test_patterns_of_resolved_concepts(spark):
    resolved = [(1, "Rule", "x", 0.5, 0), (1, "rule", "x", 0.9, 1), (1, "rule", "y", 0.4, 2), (1, "Other", "z", 0.3, 3), (1, "more", "z", 0.8, 4), (2, "rule", None, 0.7, 0), (2, "", "x", 0.7, 1)]
    labels = [("z", "rule of law", 1), ("z", "act", 2), ("z", "Trust", 3), ("z", "the trust", 4), ("z", "more", 5), ("x", "deed", 1)]
    got = document_patterns.concept_patterns(spark.createDataFrame(resolved, "doc_id bigint, concept_text string, iri string, confidence double, ord int"), spark.createDataFrame(labels, "iri string, label string, seq int"))
    assert sorted(map(tuple, got.collect())) == [
        (1, "more", "z", "more", 0.8), (1, "other", "z", "Other", 0.3), (1, "rule", "x", "rule", 0.9), (1, "rule", "y", "rule", 0.4), (1, "rule of law", "z", "Other", 0.3), (1, "the trust", "z", "Other", 0.3),
        (2, "rule", "", "rule", 0.7),
    ]


def test_attached_annotations(spark):
    docs = spark.createDataFrame([(1, "the rule of law is a rule"), (2, "rule")], DOC)
    resolved = spark.createDataFrame([(1, "rule", "x", 0.5, 0), (1, "rule", "y", 0.6, 1), (1, "rule of law", "x", 0.7, 2)], "doc_id bigint, concept_text string, iri string, confidence double, ord int")
    shape = "doc_id bigint, ann_id string, start int, end int, text string, iri string, confidence double, state string"
    existing = [(1, "a", 4, 8, "rule", "x", 0.1, "preliminary"), (1, "b", 21, 25, "RULE", None, 0.1, "rejected"), (1, "c", 0, 3, "the", "t", 0.1, "rejected"), (1, "d", 9, 11, "of", "o", 0.1, "preliminary")]
    got = document_patterns.annotate(docs, resolved, spark.createDataFrame([], "iri string, label string, seq int"), spark.createDataFrame(existing, shape)).collect()
    shown = sorted((r.ann_id if len(r.ann_id) == 1 else "new", r.start, r.end, r.iri, r.state) for r in got)
    # "rule" as x lies in "rule of law" as x, so the longer stays; as y it stays beside it, under the id of its text.
    assert shown == [("a", 4, 8, "y", "confirmed"), ("b", 21, 25, "x", "confirmed"), ("b", 21, 25, "y", "confirmed"), ("c", 0, 3, "t", "rejected"), ("new", 4, 15, "x", "confirmed")]


def test_annotation_states(spark):
    shape = "doc_id bigint, text string, iri string, state string"
    a = [(1, "A", "x", "preliminary"), (1, "a", None, "preliminary"), (1, "b", "", "preliminary"), (1, "b", "q", "preliminary"), (1, "c", "", "preliminary"), (1, "c", "", "rejected"), (2, "a", "x", "preliminary")]
    c = [(1, "a", "x", "ruler_only"), (1, "a", "y", "both_agree"), (1, "b", "z", "llm_only")]
    got = reconcile.annotation_states(spark.createDataFrame(a, shape), spark.createDataFrame(c, "doc_id bigint, text string, iri string, category string")).collect()
    assert sorted((r.doc_id, r.text, r.iri or "", r.state) for r in got) == [
        (1, "A", "x", "preliminary"), (1, "a", "", "confirmed"), (1, "b", "", "preliminary"), (1, "b", "q", "rejected"), (1, "c", "", "rejected"), (1, "c", "", "rejected"), (2, "a", "x", "rejected"),
    ]


class Stopped(Exception):
    pass


def test_progressive_stream_equals_its_batch_twin_after_a_stop_between_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 40").select("doc_id", "text").repartition(2, "doc_id")
    docs.write.parquet(str(tmp_path / "in"))
    stages = catalog_progress.stages(spark)
    source = lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    base, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def stop(docs, made):
        raise Stopped

    broken = [(name, stop if name == "states" else make) for name, make in stages]
    with pytest.raises(Exception, match="Stopped"):
        progressive.start(source(), base, cp, broken).awaitTermination()
    first = {p: os.stat(f"{base}/preliminary/batch=0/{p}").st_mtime_ns for p in os.listdir(f"{base}/preliminary/batch=0") if p.endswith(".parquet")}
    assert first and not os.path.exists(f"{base}/states")
    assert {r.state for r in progressive.table(spark, base, "preliminary").select("state").distinct().collect()} == {"preliminary"}  # a reader sees them already
    progressive.start(source(), base, cp, stages).awaitTermination()
    assert first == {p: os.stat(f"{base}/preliminary/batch=0/{p}").st_mtime_ns for p in first}  # what was complete has not been written again
    progressive.run_batch(docs, 0, str(tmp_path / "whole"), stages)  # the batch twin: all documents as one batch
    rows = lambda df: sorted(map(str, (r.asDict().items() for r in df.select(sorted(df.columns)).withColumn("confidence", F.round("confidence", 6)).collect())))
    for name in ("preliminary", "annotations"):
        assert rows(progressive.table(spark, base, name)) == rows(progressive.table(spark, str(tmp_path / "whole"), name))
    progressive.run_batch(docs.where("false"), 0, base, stages)  # a repeated batch changes nothing
    assert rows(progressive.table(spark, base, "annotations")) == rows(progressive.table(spark, str(tmp_path / "whole"), "annotations"))


def test_progressive_stage_that_was_half_written_is_written_anew(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], DOC)
    stages = [("one", lambda d, made: d), ("two", lambda d, made: made["one"].where("doc_id = 2"))]
    base = str(tmp_path / "out")
    os.makedirs(f"{base}/two/batch=7")
    docs.where("doc_id = 1").write.mode("overwrite").parquet(f"{base}/two/batch=7")
    os.remove(f"{base}/two/batch=7/_SUCCESS")
    progressive.run_batch(docs, 7, base, stages)
    assert [r.doc_id for r in progressive.table(spark, base, "two").collect()] == [2]
