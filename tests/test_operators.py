"""Literal cases of the operators."""

import base64
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import entities, lifecycle, match, ontology, reconcile, ruler, search, triples, vectors
from lexweave.sinks import export, markup
from lexweave.sources import ingest
from lexweave.streaming import events as streams


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_normalize_whitespace_keeps_rule_order(spark):
    assert column(spark, [" hello \t world \n\n\n next ", "a\n \n \n b", None], T.normalize_whitespace) == ["hello world\n\nnext", "a\n\n\nb", None]


def test_match_forms_agree(spark):
    keys = ["act", "duty of care owed to minors", "non-compete clause", "u.s. code", "d'oeuvre", ".net", "inc.", "§"]
    texts = ["The duty of care owed to minors, a Non-Compete clause", "U.S. Code and inc. of hors d'oeuvre § act", "asp.net, x .NET inc.x act's .net", "(duty of care owed to minors) inc.", ".net act", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got, want = (sorted(map(tuple, x.collect())) for x in (match.match_anchor(docs, spark.createDataFrame([(k,) for k in keys], "label_key string")), match.match_automaton(docs, keys)))
    assert got == want and {x[3] for x in got} == set(keys)


def test_sentences(spark):
    assert column(spark, ["One. Two! Three? four", "no split. here"], T.sentences_of) == [["One.", "Two!", "Three? four"], ["no split. here"]]


def test_detect_format(spark):
    rows = [("a.md", "x"), ("b.HTML", "x"), ("", "JVBERi0"), ("", "UEsDBx"), ("", "{\\rtf1"), ("", "From: a"), ("", " <!DOCTYPE"), ("", "# T"), ("", "plain"), ("x.unknown", "a\n## b")]
    df = spark.createDataFrame(rows, "f string, c string")
    assert [r[0] for r in df.select(T.detect_format(F.col("f"), F.col("c"))).collect()] == ["markdown", "html", "pdf", "word", "rtf", "email", "html", "markdown", "plain_text", "markdown"]


def test_chunks_overlap():
    sentences = [f"Sentence number {k} is here." for k in range(30)]
    plan = T.chunk_plan(sentences, 100, 40)
    assert len(plan) > 1 and all(b > a for a, b, _ in plan) and all(len(t) <= 100 for *_, t in plan)
    assert all(x[2].split(". ")[-1].rstrip(".") in y[2] for x, y in zip(plan, plan[1:], strict=False))


def test_ingest_formats(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:document>')
    rows = [
        (1, base64.b64encode(buffer.getvalue()).decode(), "a.docx"), (2, "{\\rtf1\\b Bold\\b0  text\\par next}", "a.rtf"), (3, "From: a@x\nTo: b@x\nSubject: s\nDate: Mon, 5 Jan 2026 10:00:00 +0000\n\nBody", "a.eml"),
        (4, "<html><head><title>t</title></head><body><h1>A</h1><p>b &amp; c</p></body></html>", "a.html"), (5, "broken", "b.docx"),
    ]
    got = {r.doc_id: r for r in ingest.ingest(spark.createDataFrame(rows, "doc_id bigint, content string, filename string")).collect()}
    assert got[1].text == "One\n\nTwo" and got[2].text.split("\n")[0].split() == ["Bold", "text"] and got[3].text.startswith("From: a@x\nTo: b@x") and got[3].text.endswith("\n\nBody")
    assert got[4].text == "A\nb & c" and got[5].text is None and got[5].error
    with pytest.raises(ValueError):
        ingest.get_ingestor("tape")


def test_html_elements_have_paths():
    out = ingest.html_parts("<h1>A</h1><p>x</p><h2>B</h2><ul><li>y</li></ul><h1>C</h1><table><tr><td>z</td></tr></table>")[1]
    assert out == [("A", "heading", ["A"], 1), ("x", "paragraph", ["A"], None), ("B", "heading", ["A", "B"], 2), ("y", "list_item", ["A", "B"], None), ("C", "heading", ["C"], 1), ("z", "table_cell", ["C"], None)]


def test_owl_tables():
    xml = '<r xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:skos="http://www.w3.org/2004/02/skos/core#"><owl:Class rdf:about="x"><rdfs:label>X</rdfs:label><skos:altLabel>ex</skos:altLabel><rdfs:subClassOf rdf:resource="y"/></owl:Class></r>'
    concepts, labels, edges = ingest.owl_tables(xml)
    assert concepts[0][:2] == ("x", "X") and labels == [("x", "ex", "alternative")] and edges == [("x", "y", 0)]


def test_finder_boundaries():
    assert sorted(match.Finder(["contract", "breach of contract"]).hits("breach of contract, contractual pre-contract")) == [(0, 18, "breach of contract"), (10, 18, "contract"), (36, 44, "contract")]


def test_keep_spans():
    assert match.keep_spans([(0, 18, 0), (10, 18, 1)]) == [0, 1]
    assert match.keep_spans([(0, 8, 0), (4, 15, 1)]) == [1]
    assert match.keep_spans([(0, 8, 0), (4, 12, 1)]) == [0]
    assert match.keep_spans([(3, 5, 0), (3, 5, 1)]) == [0]


def test_islands_equal_whole_fold(spark):
    r = random.Random(3)
    spans = sorted({(a, a + r.randint(1, 9), f"k{r.randint(0, 99)}") for a in (r.randint(0, 200) for _ in range(60))})
    spans = list({(a, b): (a, b, k) for a, b, k in spans}.values())
    got = match.resolve_overlaps(spark.createDataFrame([(1, *s) for s in spans], match.MATCHES)).collect()
    assert sorted((x.start, x.end, x.label_key) for x in got) == sorted(spans[k] for k in match.keep_spans([(a, b, i) for i, (a, b, _) in enumerate(spans)]))


def test_reconcile(spark):
    side = "doc_id bigint, concept_text string, iri string, confidence double, ord int"
    ruler = spark.createDataFrame([(1, "Court", "a", 0.9, 0), (1, "bare", "", 0.7, 1), (1, "weak", "w", 0.5, 2), (1, "two", "x", 0.8, 3)], side)
    llm = spark.createDataFrame([(1, "court", "a", 0.8, 0), (1, "Bare", "b", 0.85, 1), (1, "new", "n", 0.3, 2), (1, "two", "y", 0.8, 3)], side)
    got = {(r.text, r.iri): (round(r.confidence, 4), r.category) for r in reconcile.reconcile(ruler, llm).collect()}
    assert got == {("court", "a"): (0.905, "both_agree"), ("bare", "b"): (0.8575, "both_agree"), ("new", "n"): (0.3, "llm_only"), ("two", "x"): (0.8, "ruler_only"), ("two", "y"): (0.8, "llm_only")}


def test_relevance(spark):
    rows = [("breach of contract", "breach of contract", None, None, []), ("trade mark", "trade mark", None, None, []), ("lease", "lease", None, None, []), ("contract", "breach of contract", None, None, []), ("x", "", None, None, [])]
    df = spark.createDataFrame(rows, "query string, label string, pref_label string, definition string, synonyms array<string>")
    assert [r.score for r in search.relevance(df).collect()][:3] == [97.0, 92.0, 82.0]
    assert [r.score for r in search.relevance(df).collect()][3] >= 85 and [r.score for r in search.relevance(df).collect()][4] == 0.0


def test_individuals_merge():
    base = dict(mention="m", url=None)
    rows = [dict(base, name="Acme", start=0, end=4, source="spacy"), dict(base, name="Acme Corp", start=0, end=9, source="regex", mention="n", url="u"), dict(base, name="Other", start=50, end=55, source="llm", mention="o")]
    out = entities.merge_individuals(rows)
    assert [(r["name"], r["source"], r["n_merged"]) for r in out] == [("Acme Corp", "hybrid", 2), ("Other", "llm", 1)]


def test_normalize_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(vectors.normalize(F.col("v"))).collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]


def test_lifecycle(spark):
    c = spark.createDataFrame([("a", 0, "x", "confirmed"), ("a", 1, "y", "backup"), ("a", 2, "z", "backup"), ("b", 0, "x", "confirmed")], "ann_id string, rank int, iri string, state string")
    got = {(r.ann_id, r.iri): (r.rank, r.state) for r in lifecycle.promote(c, "a", 2).collect()}
    assert got == {("a", "x"): (2, "backup"), ("a", "y"): (1, "backup"), ("a", "z"): (0, "confirmed"), ("b", "x"): (0, "confirmed")}
    got = {(r.ann_id, r.iri): (r.rank, r.state) for r in lifecycle.cascade_promote(c, "x", "y").collect()}
    assert got == {("a", "x"): (1, "backup"), ("a", "y"): (0, "confirmed"), ("a", "z"): (2, "backup"), ("b", "x"): (0, "confirmed")}


def test_mark_up_nests_crossing_spans(spark):
    spans = spark.createDataFrame([(1, a, b, 0, f'<mark data-concept="{x}">', "</mark>") for a, b, x in [(0, 5, "x"), (4, 7, "y")]], "doc_id long, start int, end int, ord int, open string, close string")
    out = markup.marked_text(spark.createDataFrame([(1, "a & b c d")], "doc_id long, text string"), spans).first().body
    assert out == '<mark data-concept="x">a &amp; <mark data-concept="y">b</mark></mark><mark data-concept="y"> c</mark> d'


def test_xlsx_is_a_workbook():
    with zipfile.ZipFile(io.BytesIO(export.xlsx({"A": [["x", 1]], "B": []}))) as z:
        assert "xl/worksheets/sheet2.xml" in z.namelist() and b"<t xml:space=\"preserve\">x</t>" in z.read("xl/worksheets/sheet1.xml")
    assert len(export.EXPORTERS) == 13
    with pytest.raises(ValueError):
        export.get_exporter("paper")


def test_rate_limit_counts_accepted_only(spark, data):
    from collections import deque

    q = deque()
    assert [streams.admit(q, t, 2, 10) for t in (0, 1, 2, 9, 10.5, 11.5)] == [True, True, False, False, True, True]


def test_stream_equals_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = streams.rate_limit_stream(s, 3, 86400).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, streams.rate_limit(e, 3, 86400).collect()))
    w = streams.windowed_counts(s, "1 hour", "1 day").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    w.awaitTermination()
    assert spark.table("counted").count() == streams.windowed_counts(e).count()


def test_match_forms_agree_on_many_labels(spark):
    """Labels of one to eight words, with hyphens, points and apostrophes, cut out of the texts or made up."""
    r = random.Random(21)
    words = ["rule", "the", "pre-trial", "d'oeuvre", "u.s.", "é", "x_1", "§", "act", "of", "Straße", "(b)"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) + r.choice(["", ".", "-"]) for _ in range(40)]
    keys = set()
    for _ in range(300):
        w = r.choice(texts).lower().split(" ")
        n, at = r.randint(1, 8), r.randrange(max(1, len(w)))
        keys.add(" ".join(w[at : at + n] if r.random() < 0.8 else r.choices(words, k=n)).lower())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    keys = sorted(k for k in keys if k)
    got, want = (sorted(map(tuple, x.collect())) for x in (match.match_anchor(docs, spark.createDataFrame([(k,) for k in keys], "label_key string")), match.match_automaton(docs, keys)))
    assert got == want and max(len(x[3].split()) for x in got) > 4


def test_same_concept_spans(spark):
    rows = [(1, "a", 0, 10, 0.5, "confirmed"), (1, "a", 8, 14, 0.5, "confirmed"), (1, "a", 13, 18, 0.5, "confirmed"), (1, "a", 0, 9, 0.9, "rejected"), (1, None, 0, 9, 0.9, "confirmed"), (1, "b", 0, 5, 0.1, "confirmed"), (1, "b", 0, 5, 0.2, "confirmed")]
    got = match.same_iri_spans(spark.createDataFrame(rows, "doc_id bigint, iri string, start int, end int, confidence double, state string")).collect()
    assert sorted((r.iri or "", r.start, r.end, r.confidence, r.n_absorbed) for r in got) == [("", 0, 9, 0.9, 0), ("a", 0, 9, 0.9, 0), ("a", 0, 10, 0.5, 1), ("a", 13, 18, 0.5, 0), ("b", 0, 5, 0.2, 1)]


def test_keep_properties():
    assert ruler.keep_properties([(0, 5, 0.5, 0), (0, 5, 0.9, 1)]) == [1] and ruler.keep_properties([(0, 8, 0.5, 0), (4, 15, 0.4, 1)]) == [1]
    assert ruler.keep_properties([(0, 18, 0.5, 0), (10, 18, 0.9, 1)]) == [0, 1] and ruler.keep_properties([(0, 8, 0.5, 0), (4, 12, 0.9, 1)]) == [0]


def test_repair_pdf(spark):
    assert column(spark, ["exam-\nple goes\non here;\nnot this\n\n 12 \nNext"], T.repair_pdf_text) == ["example goes on here;\nnot this\nNext"]


def test_entity_graph_is_cut(spark):
    edges = spark.createDataFrame([(f"n{k}", "top", k) for k in range(30)] + [("top", "root", 0), ("n1", "n2", 1)], "child string, parent string, ord int")
    see = spark.createDataFrame([("top", "far", 0)], "src string, dst string, ord int")
    whole = {r.iri: (r.depth, r.phase) for r in ontology.entity_graph(spark, edges, see, "top").collect()}
    assert len(whole) == 33 and whole["root"] == (-1, "ancestor") and whole["n7"] == (1, "descendant") and whole["far"] == (0, "related")
    cut = ontology.entity_graph(spark, edges, see, "top", max_nodes=6).collect()
    assert len(cut) == 6 and all(r.truncated for r in cut) and {r.iri for r in cut} == {"top", "root", "n0", "n1", "n10", "n11"}


def test_flat_triples(spark):
    t = spark.createDataFrame([("t1", "s"), ("t2", "s")], "triple_id string, subject string")
    links = spark.createDataFrame([("t1", "subject", "concept", "c2", 2), ("t1", "subject", "concept", "c1", 1), ("t1", "predicate", "property", "p", 1)], "triple_id string, role string, kind string, entity_id string, ord int")
    got = {r.triple_id: (r.subject_iri, r.object_iri, r.predicate_property) for r in triples.flat_triples(t, links).collect()}
    assert got == {"t1": ("c1", "", "p"), "t2": ("", "", "")}
