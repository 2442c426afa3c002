"""Graphs of many roots, labels with misprints, marked text and standoff lines against plain versions."""

import html
import random

from lexweave.operators import entities, fuzzy, graphs, ontology, properties
from lexweave.sinks import markup


def test_graphs_of_many_roots_equal_one_root_at_a_time(spark):
    rnd = random.Random(11)
    names = [f"n{i:02d}" for i in range(30)]
    edges = sorted({(names[i], names[rnd.randrange(i)], k) for i in range(1, 30) for k in range(rnd.choice([1, 1, 2]))})
    edges += [(names[0], names[29], 9), (None, "n01", 0), ("n01", None, 0)]  # a cycle, and edges without an end
    beside = [(a, rnd.choice(names), k) for a in names for k in range(3)]
    e = spark.createDataFrame(edges, "child string, parent string, ord int")
    s = spark.createDataFrame(beside, "src string, dst string, ord int")
    roots = ["n00", "n07", "n19", "n29", "unknown"]
    r = spark.createDataFrame([(x,) for x in [*roots, "n07", None]], "iri string")
    for most in (7, 200):
        got = graphs.entity_graphs(spark, e, s, r, max_nodes=most, related=2).select("root", "iri", "depth", "phase", "truncated").collect()
        want = [(x, *row) for x in roots for row in ontology.entity_graph(spark, e.dropna(), s, x, max_nodes=most, related=2).select("iri", "depth", "phase", "truncated").collect()]
        assert sorted(map(tuple, got)) == sorted(want)
    assert graphs.entity_graphs(spark, e, s, r.where("false")).count() == 0


def test_a_wide_node_is_cut_and_says_so(spark):
    e = spark.range(3000).selectExpr("concat('c', lpad(id, 4, '0')) AS child", "'top' AS parent", "0 AS ord")
    s = spark.createDataFrame([], "src string, dst string, ord int")
    got = graphs.entity_graphs(spark, e, s, spark.createDataFrame([("top",), ("c0005",)], "iri string"), max_nodes=10)
    rows = {(r.root, r.iri): r for r in got.collect()}
    assert sorted(i for x, i in rows if x == "top") == ["c0000", "c0001", "c0002", "c0003", "c0004", "c0005", "c0006", "c0007", "c0008", "top"]
    assert rows["top", "top"].truncated and rows["top", "top"].root_type == "ultimate" and rows["c0005", "top"].root_type == "ultimate" and not rows["c0005", "top"].truncated
    links = graphs.graph_edges(got, e, s)
    assert sorted(map(tuple, links.where("root = 'c0005'").collect())) == [("c0005", "top", "c0005", "subClassOf")] and links.where("root = 'top'").count() == 9


def test_edges_of_a_graph(spark):
    e = spark.createDataFrame([("b", "a", 0), ("c", "b", 0), ("d", "c", 0), ("x", "a", 0)], "child string, parent string, ord int")
    s = spark.createDataFrame([("b", "x", 0), ("d", "a", 0)], "src string, dst string, ord int")
    g = graphs.entity_graphs(spark, e, s, spark.createDataFrame([("b",)], "iri string"), depth=1)
    assert sorted(map(tuple, g.select("iri", "depth", "phase").collect())) == [("a", -1, "ancestor"), ("b", 0, "focus"), ("c", 1, "descendant"), ("x", 0, "related")]
    assert sorted(map(tuple, graphs.graph_edges(g, e, s, depth=1).collect())) == [("b", "a", "b", "subClassOf"), ("b", "a", "x", "subClassOf"), ("b", "b", "c", "subClassOf"), ("b", "b", "x", "seeAlso")]


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_labels_equal_all_pairs(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 10)))
    labels = sorted({word() for _ in range(150)}) + ["straße", "😀😀x"]
    asked = sorted({word() for _ in range(60)}) + [" ABCA ", "strase", "😀😀y", ""]
    rows = spark.createDataFrame([(x, f"i:{x}") for x in labels] + [(None, "i"), ("", "i"), (labels[0], f"i:{labels[0]}")], "label_key string, iri string")
    q = spark.createDataFrame([(x,) for x in [*asked, None, asked[0]]], "query string")
    got = fuzzy.fuzzy_labels(q, rows, top=None).collect()
    want = {(x, y): d for x in asked for y in labels if (k := x.strip(" ").lower()) and (d := edits(k, y)) <= min(len(k) // 3, 2)}
    assert {(r.query, r.label_key): r.distance for r in got} == want and len(got) == len(want) > 100
    best = fuzzy.fuzzy_labels(q, rows, top=1).collect()
    assert all(r.distance == min(d for (x, _), d in want.items() if x == r.query) for r in best) and len(best) == len({x for x, _ in want})


def test_marks_nest_as_a_sweep_in_python_has_them(spark):
    rnd = random.Random(8)
    wide = "".join(rnd.choice("ab&<\"'é😀 ") for _ in range(3 * markup.BLOCK + 5))
    texts = {1: "a & b c d", 2: "", 3: wide, 4: None, 5: "x" * markup.BLOCK, 6: "no spans"}
    spans = [(1, 0, 5, "x"), (1, 4, 7, "y"), (1, 4, 7, "y"), (1, 5, 5, "none"), (1, 8, 99, "past"), (1, 40, 50, "beyond"), (1, -3, 2, "before"), (2, 0, 4, "z"), (4, 0, 1, "z"), (5, 0, markup.BLOCK, "all"), (1, None, 3, "null")]
    spans += [(3, s, s + rnd.choice([1, 7, 60, markup.BLOCK]), f"t{k}") for k in range(80) for s in [rnd.randrange(len(wide))]]
    s = spark.createDataFrame([(d, a, b, 0, f"<{t}>", f"</{t}>") for d, a, b, t in spans], "doc_id long, start int, end int, ord int, open string, close string")
    got = {r.doc_id: r.body for r in markup.marked_text(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), s).collect()}
    for d, text in texts.items():
        text = text or ""
        own = sorted((max(a, 0), -min(b, len(text)), f"<{t}>") for e, a, b, t in spans if e == d and a is not None and min(b, len(text)) > max(a, 0))
        out, was = [], []
        for i in range(len(text) + 1):
            now = [x for x in own if x[0] <= i < -x[1]]
            same = next((k for k in range(min(len(now), len(was))) if now[k] != was[k]), min(len(now), len(was)))
            out += [x[2].replace("<", "</") for x in reversed(was[same:])] + [x[2] for x in now[same:]] + [html.escape(text[i : i + 1])]
            was = now
        assert got[d] == "".join(out), d
    assert markup.marked_text(spark.createDataFrame([], "doc_id long, text string"), s).count() == 0


def test_a_page_and_standoff_lines(spark):
    docs = spark.createDataFrame([(1, "The court's seller pays"), (2, None)], "doc_id long, text string")
    a = spark.createDataFrame([(1, "a1", 4, 9, "court", "confirmed"), (1, "a2", 12, 18, "seller", "confirmed")], "doc_id long, ann_id string, start int, end int, text string, state string")
    c = spark.createDataFrame([("a1", 0, "urn:c", "Court", "Legal Entity", 0.5, "confirmed"), ("a1", 1, "urn:d", "", "Forum", 0.4, "backup")], "ann_id string, rank int, iri string, label string, branch string, confidence double, state string")
    i = spark.createDataFrame([(1, 0, 9, "The court", "the <Court>", "legal_citation", "urn:i", "Legal Court")], "doc_id long, start int, end int, mention string, name string, kind string, iri string, label string")
    p = spark.createDataFrame([(1, 19, 23, "pays", None, None, None)], "doc_id long, start int, end int, text string, iri string, label string, definition string")
    t = spark.createDataFrame([(1, "seller", "pays for", "x", 12, 18, 4, 9, "active", 0.7, True), (1, "y", "z", "w", None, None, 1, 2, "active", 0.7, False)], "doc_id long, subject string, predicate string, object string, s_start int, s_end int, o_start int, o_end int, voice string, confidence double, linked boolean")
    lines = [r.value for r in markup.to_standoff(a, c, i, p, t).orderBy("n").collect()]
    assert lines == [
        "T1\tLegal_Entity 4 9\tcourt", "A1\tIRI T1 urn:c", "A2\tLabel T1 Court", "A3\tIRI T1 urn:d", "T2\tCONCEPT 12 18\tseller", "T3\tLegal_Court 0 9\tThe court", "A4\tCanonicalName T3 the <Court>", "A5\tIRI T3 urn:i",
        "T4\tPROPERTY 19 23\tpays", "T5\tTRIPLE_SUBJECT 12 18\tseller", "T6\tTRIPLE_OBJECT 4 9\tx", "R1\tpays_for Arg1:T5 Arg2:T6",
    ]
    page = {r.doc_id: r.value for r in markup.to_page(docs, a, c, i, p, t).collect()}
    assert "Extracted triples (2)" in page[1] and 'title="the &lt;Court&gt; (Legal Court)">The <span class="annotation" style="border-bottom-color: #FF8C00;" data-iri="urn:c"' in page[1]
    assert "court</a></span></span>&#x27;s seller <span" in page[1] and "<pre style=\"white-space: pre-wrap;\"></pre></body>" in page[2]


def test_base_forms_are_those_that_the_texts_show(spark):
    docs = spark.createDataFrame([(1, "Stop stop stopped. Remand remands remanded; make making mak"), (2, "use used us carry carried carries seen sting REMAND"), (3, None), (4, "")], "doc_id long, text string")
    counts = properties.word_counts(docs)
    words = ["stopped", "remanded", "making", "used", "carried", "carries", "seen", "sting", "unknowned", None]
    got = {r.word: r.lemma for r in properties.lemmas(spark.createDataFrame([(w,) for w in [*words, "used"]], "word string"), counts).collect()}
    assert got == {"stopped": "stop", "remanded": "remand", "making": "make", "used": "use", "carried": "carry", "carries": "carry"}  # make and mak are as frequent: the first ending
    labels = spark.createDataFrame([("remanded", "p:1", "preferred"), ("remands", "p:2", "alternative"), ("has", "p:3", "preferred"), ("us", "p:4", "preferred"), ("stop stop", "p:5", "preferred"), ("used", "p:6", "preferred"), ("use", "p:7", "preferred")], "label_key string, iri string, label_type string")
    rows = {tuple(r) for r in properties.match_properties(docs, labels).select("doc_id", "label_key", "iri", "label_type", "confidence").collect()}
    assert rows == {
        (1, "remanded", "p:1", "preferred", 0.85), (1, "remands", "p:2", "alternative", 0.75), (1, "remand", "p:1", "lemma", 0.72), (2, "remand", "p:1", "lemma", 0.72), (1, "stop stop", "p:5", "preferred", 0.9),
        (2, "used", "p:6", "preferred", 0.85), (2, "use", "p:7", "preferred", 0.85),
    }
    assert properties.match_properties(docs.where("false"), labels).count() == 0 and properties.match_properties(docs, labels.where("false")).count() == 0


def test_literals_that_a_pattern_needs_lose_no_match(spark, monkeypatch):
    parts = ["5 % off", "five percent", "9 Baſis pointſ", "12 K", "$5", "9 poundſ", "two dayſ", "three MİNUTES", "Jan. 2, 2020", "٣/٤/٢٠٢٠", "Supreme Court of Ohio", "S.D. Ohio", '"Term" meanſ', "“Term” shall mean", "ıf so", "except that", "at least", "a maxımum of",
             "12 Main Street", "© 2020 Acme", "copyrıght 2020", "Copyright (c) 2020", "eleven euros", "5 USD", "no more than", "twelve hundred cents", "10 basis points", "nothing", ""]
    docs = spark.createDataFrame([(k, f"x {p} y") for k, p in enumerate(parts)] + [(99, None)], "doc_id long, text string")
    got = sorted(map(tuple, entities.extract_all(docs).collect()))
    monkeypatch.setattr(entities, "NEEDS", {})
    assert got == sorted(map(tuple, entities.extract_all(docs).collect())) and len(got) > 22
