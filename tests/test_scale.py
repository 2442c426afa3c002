"""Operators that failed on larger tables: with limits set low, and against plain versions."""

import random
import re
import zlib
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import annotate, graphs, match, ontology, search, vector_index, vectors

LIMIT = "spark.sql.cteRecursionRowLimit"


@pytest.fixture
def few_recursive_rows(spark):
    """Recursion in SQL ends with an error beyond so many rows (a million by default)."""
    was = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "20")
    yield
    spark.conf.set(LIMIT, was)


def dag(seed: int = 3) -> tuple[list[str], list[tuple[str, str, int]]]:
    rnd = random.Random(seed)
    names = ["lex:root"] + [f"n{i:02d}" for i in range(1, 40)]
    edges = [(names[i], names[rnd.randrange(max(0, i - 4), i)], 0) for i in range(1, 36)]
    edges += [(names[i], names[rnd.randrange(i)], 1) for i in range(2, 36, 3)]
    return names, edges


def frames(spark, names, edges):
    return spark.createDataFrame([(n,) for n in [*names, names[5]]], "iri string"), spark.createDataFrame(edges, "child string, parent string, ord int")


def test_counts_below_each_node(spark, few_recursive_rows):
    names, edges = dag()
    want = {}
    for n in names:
        at, d = [n], 0
        while at := [p for x in at for c, p, _ in edges if c == x]:
            d += 1
            for p in at:
                k, deep = want.get(p, (0, 0))
                want[p] = (k + 1, max(deep, d))
    got = ontology.below_counts(spark, frames(spark, names, edges)[1])
    assert {r.node: (r.n_below, r.deepest) for r in got.collect()} == want
    assert ontology.below_counts(spark, frames(spark, names, [])[1]).count() == 0


def ways_up(edges, start, most, stop=None):
    """All ways of first parents from a node, as lists of nodes."""
    out, at = [[start]], [[start]]
    for _ in range(most):
        at = [[p, *way] for way in at if way[0] != stop for c, p, o in edges if c == way[0] and o == 0]
        out += at
    return out


def test_first_parent_paths(spark, few_recursive_rows):
    names, edges = dag()
    got = {r.iri: (r.depth, r.path) for r in ontology.hierarchy(spark, "path", *frames(spark, names, edges)).collect()}
    longest = {n: max(ways_up(edges, n, 9, "lex:root"), key=len) for n in names}
    assert got == {n: (len(w) - 1, " > ".join(w)) for n, w in longest.items()} and max(len(w) for w in longest.values()) == 10


def test_paths_by_each_parent(spark, few_recursive_rows):
    names, edges = dag(4)
    edges += [("lex:root", "n39", 0)]  # these paths go on above the root
    got = ontology.hierarchy(spark, "paths", *frames(spark, names, edges)).collect()
    want = {(c, p, " > ".join([*max(ways_up(edges, p, 8), key=len), c])) for c, p, _ in edges}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_nearest_branch_root(spark, few_recursive_rows):
    names, edges = dag(5)
    edges += [("n01", "n30", 1)]  # a cycle
    got = {r.iri: (r.depth, r.branch_root) for r in ontology.hierarchy(spark, "branch", *frames(spark, names, edges)).collect()}
    tops, want = {c for c, p, _ in edges if p == "lex:root"}, {}
    for n in names:
        at = {n}
        for d in range(21):
            if at & tops:
                want[n] = (d, min(at & tops))
                break
            at = {p for c, p, _ in edges if c in at}
    assert got == want and len(tops) > 1 and len(want) > 30


def plain_detail(names, edges, beside):
    def row(n):
        children, parents = sorted({c for c, p, _ in edges if p == n}), sorted({p for c, p, _ in edges if c == n})
        first = {p for c, p, o in edges if c == n and o == 0}
        siblings = sorted({c for c, p, _ in edges if p in first and c != n})
        return n, ",".join(children), ",".join(parents), ",".join(siblings), ",".join(sorted({d for s, d, _ in beside if s == n}))

    return {row(n) for n in names}


COLUMNS = ("iri", "children", "parents", "siblings", "related")


def detail_tables(spark):
    names, edges = dag(6)
    names += ["é", "éa", "e", "only", "😀"]
    edges += [(c, "n39", 0) for c in ("é", "éa", "e", "😀", "n03", "é")] + [("only", "n38", 0), ("n03", "n20", 0)]  # n03 has several first parents
    beside = [("n02", "n09", 0), ("n02", "n01", 1), ("é", "e", 0)]
    concepts, e = frames(spark, names, edges)
    return names, edges, beside, (concepts.distinct(), e, spark.createDataFrame(beside, "src string, dst string, ord int"))


def test_details_and_no_child_meets_its_siblings_one_by_one(spark):
    names, edges, beside, tables = detail_tables(spark)
    got = ontology.concept_detail(*tables).select(*COLUMNS)
    assert {tuple(r) for r in got.collect()} == plain_detail(names, edges, beside) and got.count() == len(names)
    wide = spark.range(30_000).selectExpr("concat('c', lpad(id, 5, '0')) AS child", "'top' AS parent", "0 AS ord")  # 900 million pairs
    few = spark.createDataFrame([("c00000",), ("c29999",), ("top",)], "iri string")
    rows = {r.iri: r for r in ontology.concept_detail(few, wide, tables[2]).collect()}
    every = [f"c{k:05d}" for k in range(30_000)]
    assert rows["c00000"].siblings == ",".join(every[1:]) and rows["c29999"].siblings == ",".join(every[:-1]) and rows["top"].children == ",".join(every)


def test_a_batch_puts_together_its_own_details_only(spark, monkeypatch):
    names, edges, beside, tables = detail_tables(spark)
    seen, whole = [], ontology.concept_detail
    monkeypatch.setattr(ontology, "concept_detail", lambda c, e, s: seen.append((c.count(), e.count(), s.count())) or whole(c, e, s))
    asked = spark.createDataFrame([("n03",), ("n02",), ("é",), ("n02",), ("n025",), ("zz",)], "iri string")
    got = ontology.batch_detail(*tables, asked, most=3).select(*COLUMNS)
    assert {tuple(r) for r in got.collect()} == {r for r in plain_detail(names, edges, beside) if r[0] in ("n02", "n03")}  # the first three by name, of which one is unknown
    assert len(seen) == 1 and seen[0][0] == 2 and seen[0][1] < len(edges) / 2 and seen[0][2] == 2


def test_labels_are_not_sent_through_the_driver(spark):
    rows = spark.range(2000).selectExpr("concat('label ', id % 50) AS label_key", "concat('i:', id) AS iri")
    asked = spark.createDataFrame([("label 1",), ("LABEL 49 ",), ("none",)], "query string")
    found = ontology.by_prefix(asked, rows)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = {tuple(r) for r in found.collect()}
    assert got == {(q, f"label {k % 50}", f"i:{k}") for q in ("label 1", "LABEL 49 ") for k in range(2000) if f"label {k % 50}".startswith(q.strip().lower())}


def test_the_filter_comes_after_five_times_as_many(spark):
    near = [(k, [1.0 - 0.01 * k, 0.0], 1) for k in range(9)] + [(20, [0.5, 0.5], 2), (21, [0.4, 0.6], 2), (22, [0.0, 1.0], 2)]
    v = spark.createDataFrame(near, "vec_id bigint, embedding array<float>, label int")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    got = [(r.vec_id, r.rank) for r in vectors.top_k_then_filter(v, q, 2, F.col("label") == 2).orderBy("rank").collect()]
    assert got == [(20, 1)]  # the tenth; 21 passes as well, but is not among the ten
    assert vectors.top_k_then_filter(v, q, 1, F.col("label") == 2).count() == 0


def test_an_index_reaches_further_the_more_it_holds(spark, tmp_path):
    sizes = [100, 10_000, 100_000, 10_000_000]
    reach = [vector_index.reach_of(n) for n in sizes]
    assert reach == sorted(set(reach)) or reach[0] == reach[1] == vector_index.REACH
    assert all(n * (1 - NormalDist().cdf(x)) <= 1.001 for n, x in zip(sizes, reach, strict=True)) and reach[-1] > 5
    r = np.random.default_rng(2)
    m = r.normal(size=(3000, 16))
    m = (m / np.linalg.norm(m, axis=1)[:, None]).astype(np.float32)
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "vec_id bigint, embedding array<float>")
    vector_index.build(v, str(tmp_path / "i"))
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"))
    assert index.reach == vector_index.reach_of(3000)
    index.reach = 4.0  # the root of 16: the whole radius, as ``exact``
    rows = lambda exact: {tuple(x) for x in index.search(v.where("vec_id < 20").withColumnRenamed("vec_id", "query_id"), 5, exact=exact).select("query_id", "vec_id").collect()}
    assert rows(False) == rows(True)


def test_concepts_that_read_the_same_are_scored_once(spark, monkeypatch):
    shape = "iri string, label string, pref_label string, definition string, branch string, deprecated boolean, ord int"
    rows = [(f"i{k:03d}", "red bolt", None, "A bolt.", "Acts" if k == 0 else "B", k == 1, k) for k in range(200)]
    rows += [("x", "blue bolt", "Bolt", None, "B", False, 300), ("up", "thing", None, None, "B", False, 301), ("x", "red", None, None, "B", False, 302)]  # x stands in two rows
    concepts = spark.createDataFrame(rows, shape)
    labels = spark.createDataFrame([("i005", "crimson bolt", "alternative")], "iri string, label string, label_type string")
    edges = spark.createDataFrame([(r[0], "up", 0) for r in rows if r[0].startswith("i")] + [("up", "top", 0), ("x", "i010", 0)], "child string, parent string, ord int")
    asked = spark.createDataFrame([("red bolt",), ("crimson bolt",)], "query string")
    scored, plain = [], search.relevance
    monkeypatch.setattr(search, "relevance", lambda pairs: scored.append(pairs.count()) or plain(pairs))
    got = {(r.query, r.iri): r.score for r in search.scores(asked, concepts, labels).collect()}
    assert scored == [scored[0]] and scored[0] <= 2 * 5 and len({i for q, i in got if q == "red bolt"}) == 200
    assert got["red bolt", "i000"] == got["red bolt", "i199"] == 92.0 and got["crimson bolt", "i005"] > got["crimson bolt", "i006"] and ("red bolt", "i001") not in got
    best = [(r.rank, r.iri, r.score) for r in search.search(asked.where("query = 'red bolt'"), concepts, labels, edges, top=4, excluded=("Acts",)).orderBy("rank").collect()]
    assert best == [(1, "i002", 92.0), (2, "i003", 92.0), (3, "i004", 92.0), (4, "i005", 92.0)]
    far = {r.iri: r.score for r in search.search(asked.where("query = 'red bolt'"), concepts, labels, edges, top=500, excluded=("Acts",)).collect()}
    assert far["up"] == 78.2 and far["top"] == 66.5 and "i000" not in far and "i001" not in far and len(far) == 198 + 3


WORDS = ["Éa", "_x1", "b", "of", "the", "straße", "1st", "İ", "ABC", "日本", "of the"]
GAPS = [" ", "  ", "-", ". ", "\n", ", 'n ", "…"]


def some_texts(n=40):
    rnd = random.Random(9)
    return [(k, rnd.choice(["", *GAPS]) + "".join(rnd.choice(WORDS) + rnd.choice(GAPS) for _ in range(rnd.randrange(30))) + rnd.choice(["", "end"])) for k in range(n)] + [(90, None), (91, ""), (92, "--"), (93, "b")]


def plain_tokens(text):
    return [(m.start(), m.group()) for m in re.finditer(r"\w+", text)]


def test_tokens_are_cut_where_the_texts_are(spark, monkeypatch):
    monkeypatch.setattr(match, "CUT_BYTES", 100)
    docs = spark.createDataFrame([(k, t and t.replace("İ", "i")) for k, t in some_texts()], "doc_id bigint, text string").repartition(6)
    t = match.tokens(docs, columns=tuple(match.TOKEN_COLUMNS))
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and plan.count("Exchange") == 1  # that of ``docs``
    got = {(r.doc_id, r.i): r for r in t.collect()}
    want = {}
    for d, text in some_texts():
        text = (text or "").replace("İ", "i").lower()
        own = plain_tokens(text)
        for i, (a, w) in enumerate(own):
            b, end = a + len(w), own[i + 1][0] if i + 1 < len(own) else len(text)
            far = own[i + match.NEAR][0] + len(own[i + match.NEAR][1]) if i + match.NEAR < len(own) else len(text)
            ahead = text[(own[i - 1][0] + len(own[i - 1][1])) if i else 0 : a]
            want[d, i + 1] = (a, w, text[b:end], ahead, own[i + 1][1] if i + 1 < len(own) else None, i + 1 == len(own), text[a:far])
    assert {k: (r.start, r.token, r.gap, r.ahead, r.nxt, r.last, r.context) for k, r in got.items()} == want and len(want) > 300


def test_anchored_and_automaton_agree_with_and_without_few_labels(spark, monkeypatch):
    labels = ["of the", "of", "the", "b", "éa", "-b", "b-", "of the of the", "the abc b of the 1st", "the. b", "…", "'n", "", "ab"]
    docs = spark.createDataFrame([(k, t and t.replace("İ", "i")) for k, t in some_texts(80)] + [(200, "xx The ABC B of the 1st-b")], "doc_id bigint, text string")
    known = spark.createDataFrame([(v,) for v in labels], "label_key string")
    want = sorted(map(tuple, match.match_automaton(docs, labels).collect()))
    assert sorted(map(tuple, match.match_anchor(docs, known).collect())) == want and len({r[3] for r in want}) > 8
    monkeypatch.setattr(match, "SMALL", 3)
    assert sorted(map(tuple, match.match_anchor(docs, known).collect())) == want
    each = docs.select("doc_id").crossJoin(known)
    assert sorted(map(tuple, match.match_by_document(docs, each).collect())) == want
    settled = match.match_by_document(docs, each, resolve=True)
    assert "Window" not in settled._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, settled.collect())) == sorted(map(tuple, match.resolve_overlaps(match.match_automaton(docs, labels)).collect()))


def test_runs_of_words_meet_few_labels_in_place(spark, monkeypatch):
    texts = ["", "a", "ab", "abc", "éab", "日本語x", "of the", "x" * 50, "a\x7fb", "😀ab"]
    want = np.zeros((len(texts), 64))
    for k, t in enumerate(texts):
        for i in range(max(len(t) - 2, 1)):
            want[k, zlib.crc32(t[i : i + 3].encode()) % 64] += 1
    assert np.array_equal(vectors.trigram_vectors(texts), want / np.linalg.norm(want, axis=1, keepdims=True))
    docs = spark.createDataFrame([(1, "Breach of Contract and the rule-of law, of the"), (2, "rule of, law; the of"), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([("breach of contracts", "i:1"), ("rule of law", "i:2"), ("rule of law", "i:3"), (None, "i:4")], "label_key string, iri string")
    known = spark.createDataFrame([(2, 0, 4)], "doc_id bigint, start int, end int")
    made = []
    monkeypatch.setattr(vector_index, "nearest", lambda *a, **k: made.append(1))
    got = sorted(map(tuple, annotate.semantic_spans(docs, known, labels, 0.7, ("of", "the")).select("doc_id", "start", "end", "gram", "label", "iri").collect()))
    assert got and not made and {(1, 0, 18, "breach of contract", "breach of contracts", "i:1"), (1, 27, 38, "rule of law", "rule of law", "i:2"), (1, 27, 38, "rule of law", "rule of law", "i:3")} <= set(got)
    assert not [r for r in got if r[0] == 2 and r[1] < 4] and not {r[3] for r in got} & {"of the", "the of"}  # begin in a known span, or are of stop words
    monkeypatch.undo()
    monkeypatch.setattr(annotate, "FEW_LABELS", 1)
    assert sorted(map(tuple, annotate.semantic_spans(docs, known, labels, 0.7, ("of", "the")).select("doc_id", "start", "end", "gram", "label", "iri").collect())) == got


def test_levels_of_graphs_are_not_sent_through_the_driver(spark):
    names, edges = dag(8)
    concepts, e = frames(spark, names, edges)
    got = graphs.entity_graphs(spark, e, spark.createDataFrame([("n03", "n20", 0)], "src string, dst string, ord int"), concepts)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("root = 'n03' AND phase = 'related'").select("iri").collect()[0][0] == "n20"
