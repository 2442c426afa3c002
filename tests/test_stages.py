"""Job events as a stream, versions of the ontology, cached vectors, joins of spans, links of individuals, workbooks."""

import io
import random
import zipfile

import pandas as pd
import pytest

from lexweave.functions.spans import BUCKET, inside, overlapping
from lexweave.operators import entities, model_stages, models, vectors
from lexweave.sinks import export
from lexweave.sources import ontology_store
from lexweave.streaming import events


def test_span_joins_equal_all_pairs(spark):
    rnd = random.Random(3)
    spans = [(d, a := rnd.randrange(4 * BUCKET), a + rnd.choice([0, 1, 50, 3 * BUCKET])) for d in (1, 2) for _ in range(60)]
    ranges = [(d, a := rnd.randrange(4 * BUCKET), a + rnd.choice([1, 2000, 2 * BUCKET])) for d in (1, 2) for _ in range(30)]
    s = spark.createDataFrame([(*x, k) for k, x in enumerate(spans)], "doc_id long, start int, end int, s int")
    r = spark.createDataFrame([(*x, k) for k, x in enumerate(ranges)], "doc_id long, lo int, hi int, r int")
    pairs = [(i, j) for i, (d, lo, hi) in enumerate(ranges) for j, (e, a, b) in enumerate(spans) if d == e]
    want = sorted((i, j) for i, j in pairs if ranges[i][1] < spans[j][2] and spans[j][1] < ranges[i][2] and spans[j][1] < spans[j][2])
    assert sorted(map(tuple, overlapping(r, s).select("r", "s").collect())) == want
    want = sorted((i, j) for i, j in pairs if ranges[i][1] <= spans[j][1] and spans[j][2] <= ranges[i][2])
    assert sorted(map(tuple, inside(r, s).select("r", "s").collect())) == want


def test_entity_offsets_with_marks_and_wide_characters(spark):
    text = "😀\u0001 5% \u0002 and 7%"
    d = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(map(tuple, entities.extract(d, entities.BY_KIND["percentage"]).select("doc_id", "start", "end", "mention").collect()))
    assert got == sorted([(1, text.index(x), text.index(x) + 2, x) for x in ("5%", "7%")] * 2)


def test_job_events_stream_equals_batch(spark, tmp_path):
    rows, rnd = [], random.Random(5)
    for job in ("a", "b", "c"):
        for seq in range(5):
            rows.append((job, seq, "status", "", "completed" if job == "a" and seq == 3 else "running" if seq else "pending"))
            rows += [(job, seq, "annotation", f"n{i}", rnd.choice(["preliminary", "confirmed"])) for i in range(4) if rnd.random() < 0.6]
            rows += [(job, seq, "triple", f"t{i}", "") for i in range(3) if rnd.random() < 0.5]
    shape = "job_id string, seq bigint, entity string, entity_id string, state string"
    spark.createDataFrame(rows, shape).where("seq < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: (
        events.job_events_stream(spark.readStream.schema(shape).parquet(str(tmp_path / "in")))
        .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    )
    run()
    spark.createDataFrame(rows, shape).where("seq >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, events.job_events(spark.createDataFrame(rows, shape)).collect())) and len(got) > 20


def test_ontology_versions(spark, tmp_path):
    base = str(tmp_path / "store")
    one = {"concepts": spark.createDataFrame([("x", "a"), ("y", "b")], "iri string, label string")}
    two = {"concepts": spark.createDataFrame([("x", "a")], "iri string, label string")}
    with pytest.raises(ValueError):
        ontology_store.load(spark, base, "concepts")
    v1 = ontology_store.publish(spark, base, one)
    assert ontology_store.publish(spark, base, {"concepts": one["concepts"].orderBy("label", ascending=False)}) == v1 and len(ontology_store.log(spark, base)) == 1
    with pytest.raises(ValueError):
        ontology_store.rollback(spark, base)
    v2 = ontology_store.publish(spark, base, two)
    assert v2 != v1 and ontology_store.load(spark, base, "concepts").count() == 1
    assert ontology_store.rollback(spark, base) == v1 and ontology_store.load(spark, base, "concepts").count() == 2
    assert ontology_store.load(spark, base, "concepts", v2).count() == 1
    with pytest.raises(ValueError):
        ontology_store.publish(spark, base, {"concepts": two["concepts"].where("false")})


def test_cached_vectors_are_made_once(spark, tmp_path):
    path = str(tmp_path / "v")
    t = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, None), (4, "")], "id long, text string")
    first = {r.id: r.embedding for r in vectors.cached_vectors(t, path, "m").collect()}
    assert first[1] == first[2] and first[3] is None and len(first[4]) == 64
    stored = spark.read.parquet(path).count()
    assert {r.id: r.embedding for r in vectors.cached_vectors(t, path, "m").collect()} == first and spark.read.parquet(path).count() == stored == 2
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    k = spark.createDataFrame([("x", [0.5, 0.5])], "iri string, embedding array<double>")
    assert vectors.score_candidates(q, spark.createDataFrame([(1, "x"), (1, "gone")], "query_id long, iri string"), k).collect() == [(1, "x", 0.5)]


def linking():
    def answer(prompt):
        if "fail" in prompt:
            raise RuntimeError("no")
        return '{"individuals": [{"name": "ACME", "mention_text": "x", "class_labels": ["Company"], "is_new": false}, {"mention_text": "bob", "confidence": -1}, {"mention_text": "absent"}, {"mention_text": ""}]}'

    return answer


def test_individuals_and_links(spark):
    models.register_provider("linking", linking)
    chunks = spark.createDataFrame([(1, 0, 0, 20, "Acme met Bob today."), (1, 1, 20, 40, "then fail happened"), (2, 0, 0, 5, "bob")], "doc_id long, chunk_index int, start_offset int, end_offset int, text string")
    none = spark.createDataFrame([], "doc_id long, ann_id string, start int, end int, text string")
    existing = spark.createDataFrame([(1, "Acme", "Acme", 0, 4), (1, "acme", "ACME", 30, 34)], "doc_id long, name string, mention string, start int, end int")
    new, links = model_stages.individuals(chunks, none, existing, "linking")
    assert sorted((r.doc_id, r.start, r.end, r.name, r.confidence, r.label) for r in new.collect()) == [(1, 9, 12, "bob", 0.0, None), (2, 0, 3, "bob", 0.0, None)]
    assert [(r.doc_id, r.start, r.name, r.label, r.confidence) for r in links.collect()] == [(1, 0, "Acme", "Company", 0.5)]


def test_routes():
    assert model_stages.route({"branch": "echo"})["branch"] == "echo" and len(model_stages.route({})) == 9
    with pytest.raises(ValueError):
        model_stages.route({"unknown": "echo"})


def test_graph_bulk_and_workbook(spark):
    a = spark.createDataFrame([(1, "a1", 0, 3, "law", "confirmed")], "doc_id long, ann_id string, start int, end int, text string, state string")
    c = spark.createDataFrame([("a1", 0, "lex:law", "law", "Rules", 0.95, "confirmed")], "ann_id string, rank int, iri string, label string, branch string, confidence double, state string")
    i = spark.createDataFrame([(1, "i1", "Acme", 0.5)], "doc_id long, id string, name string, confidence double")
    k = spark.createDataFrame([("i1", "lex:law"), ("i1", "lex:none")], "id string, iri string")
    t = spark.createDataFrame([("i1", "is a", "lex:law"), (None, "x", "y")], "subject string, predicate string, object string")
    p = spark.createDataFrame([("p1", "has", "lex:law", "lex:gone")], "id string, name string, domain_iri string, range_iri string")
    nodes, relations = export.to_property_graph(a, c, i, k, p, t)
    assert sorted(r.id for r in nodes.collect()) == ["a1", "i1", "lex:law", "p1"]
    assert sorted((r.src, r.dst, r.kind) for r in relations.collect()) == [("a1", "lex:law", "REFERS_TO"), ("i1", "lex:law", "INSTANCE_OF"), ("i1", "lex:law", "IS_A"), ("p1", "lex:law", "HAS_DOMAIN")]
    assert export.to_bulk(a, c, i).count() == 4
    book = pd.DataFrame(export.get_exporter("excel")(a, c, i).collect())[1][0]
    z = zipfile.ZipFile(io.BytesIO(bytes(book)))
    assert b"high" in z.read("xl/worksheets/sheet1.xml") and b"weak" not in z.read("xl/worksheets/sheet1.xml") and b"Acme" in z.read("xl/worksheets/sheet2.xml")
