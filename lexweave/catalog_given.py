"""Queries of graphs, labels and exports over the given tables as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import catalog as C
from lexweave import catalog_stages as S
from lexweave.functions import text as T
from lexweave.operators import fuzzy, graphs, models, ontology, properties, ruler, search
from lexweave.sinks import markup
from lexweave.sources import ontology_data
from lexweave.sources.shared import fresh_dir

query, read = C.query, C.read


# --- graphs around many nodes -------------------------------------------------------------------------


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders below customers, customers and suppliers below nations, nations below regions; an order's suppliers are related to it."""
    name = lambda tag, c: F.concat(F.lit(tag), F.col(c))
    below = [("orders", "o", "o_orderkey", "c", "o_custkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")]
    parts = [read(spark, sf_dir, t).select(name(a, k).alias("child"), name(b, p).alias("parent"), F.lit(0).alias("ord")) for t, a, k, b, p in below]
    edges = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return edges, read(spark, sf_dir, "lineitem").select(name("o", "l_orderkey").alias("src"), name("s", "l_suppkey").alias("dst"), F.col("l_linenumber").alias("ord"))


GRAPHS = """WITH own AS (SELECT 'c' || c_custkey AS root, c_custkey, 'n' || c_nationkey AS n, 'r' || n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey),
    sup AS (SELECT 's' || s_suppkey AS s, 'n' || s_nationkey AS n, 'r' || n_regionkey AS r FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    beside AS (SELECT l_orderkey, 's' || l_suppkey AS s FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS k FROM lineitem GROUP BY ALL)
               QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY k, 's' || l_suppkey) <= 5),
    rel AS (SELECT DISTINCT own.root, own.n AS own_n, own.r AS own_r, sup.s, sup.n, sup.r FROM own JOIN orders ON o_custkey = c_custkey JOIN beside ON l_orderkey = o_orderkey JOIN sup ON sup.s = beside.s),
    nodes AS (SELECT root, root AS iri, 0 AS depth, 'focus' AS phase FROM own UNION ALL SELECT root, n, -1, 'ancestor' FROM own UNION ALL SELECT root, r, -2, 'ancestor' FROM own
        UNION ALL SELECT own.root, 'o' || o_orderkey, 1, 'descendant' FROM own JOIN orders ON o_custkey = c_custkey
        UNION ALL SELECT DISTINCT root, s, 0, 'related' FROM rel UNION ALL SELECT DISTINCT root, n, -1, 'related_ancestor' FROM rel WHERE n <> own_n
        UNION ALL SELECT DISTINCT root, r, -2, 'related_ancestor' FROM rel WHERE r <> own_r
        UNION ALL SELECT s, s, 0, 'focus' FROM sup UNION ALL SELECT s, n, -1, 'ancestor' FROM sup UNION ALL SELECT s, r, -2, 'ancestor' FROM sup)
    SELECT root, iri, CAST(depth AS INTEGER) AS depth, phase, CASE WHEN iri[1] <> 'r' THEN NULL WHEN phase = 'ancestor' THEN 'ultimate' ELSE 'ancillary' END AS root_type, false AS truncated FROM nodes"""


@query("g7_many_roots", GRAPHS)
def g7(spark, sf_dir):
    """The graph of every customer and supplier."""
    edges, beside = trade_graph(spark, sf_dir)
    roots = edges.where("child LIKE 'c%' OR child LIKE 's%'").select(F.col("child").alias("iri"))
    return graphs.entity_graphs(spark, edges, beside, roots, max_nodes=400)


# --- labels with misprints ----------------------------------------------------------------------------


@query("q5_fuzzy_labels", """WITH l AS (SELECT 'part:' || p_partkey AS iri, lower(p_name || ' ' || p_brand || ' ' || p_type) AS label_key FROM part), t AS (SELECT DISTINCT label_key FROM l),
    q AS (SELECT left(label_key, 3) || substr(label_key, 5) AS query FROM t UNION SELECT left(label_key, 1) || substr(label_key, 3, 1) || substr(label_key, 2, 1) || substr(label_key, 4) FROM t),
    m AS (SELECT query, label_key, levenshtein(trim(query), label_key) AS distance FROM q JOIN t ON abs(length(trim(query)) - length(label_key)) <= 2)
    SELECT query, label_key, iri, CAST(distance AS INTEGER) AS distance, round(100 * (1 - distance / greatest(length(trim(query)), length(label_key))), 4) AS score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, greatest(length(trim(query)), length(label_key)) * (distance > 0)::INT DESC, label_key, iri) AS rank FROM m JOIN l USING (label_key) WHERE distance <= least(length(trim(query)) // 3, 2)) WHERE rank <= 25""")
def q5(spark, sf_dir):
    """Parts by names in which a character is missing or two are swapped; the twin measures all pairs."""
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("iri"), F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("label_key"))
    t = rows.select("label_key").distinct()
    missing = F.concat(F.substring("label_key", 1, 3), F.expr("substr(label_key, 5)"))
    swapped = F.concat(F.substring("label_key", 1, 1), F.substring("label_key", 3, 1), F.substring("label_key", 2, 1), F.expr("substr(label_key, 4)"))
    return fuzzy.fuzzy_labels(t.select(missing.alias("query")).union(t.select(swapped.alias("query"))).distinct(), rows)


# --- pages and standoff files -------------------------------------------------------------------------


def crossing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Annotations, their concepts, and individuals, properties and triples that cross them or lie in them."""
    path = fresh_dir(spark, "annotated")
    C.annotated(spark, sf_dir)[0].write.parquet(path)  # matched once; four tables are made of it
    a = spark.read.parquet(path)
    c = a.select("ann_id", F.lit(0).alias("rank"), F.concat(F.lit("lex:"), F.regexp_replace("text", " ", "_")).alias("iri"), F.col("text").alias("label"), F.lit("Rules").alias("branch"), F.lit(0.9).alias("confidence"), "state")
    at = lambda s, e: (F.expr(s).alias("start"), F.expr(e).alias("end"))
    none = F.lit(None).cast("string")
    individuals = a.select("doc_id", *at("start + 3", "end + 3"), F.col("text").alias("mention"), F.upper("text").alias("name"), F.lit("phrase").alias("kind"), none.alias("iri"), none.alias("label"))
    properties = a.select("doc_id", *at("start", "start + 2"), "text", none.alias("iri"), none.alias("label"), none.alias("definition"))
    triples = a.select("doc_id", F.col("text").alias("subject"), F.lit("is in").alias("predicate"), F.upper("text").alias("object"), F.col("start").alias("s_start"), F.col("end").alias("s_end"),
        F.expr("start + 3").alias("o_start"), F.expr("end + 3").alias("o_end"), F.lit("active").alias("voice"), F.lit(0.5).alias("confidence"), (F.col("start") % 2 == 0).alias("linked"))
    return a, c, individuals, properties, triples


@query("x12_pages", f"""WITH {S.ANNOTATED},
    sp AS (SELECT doc_id, start AS s, "end" AS e, 0 AS ord, '<span class="annotation" style="border-bottom-color: #228B22;" data-iri="' || iri || '" data-branch="Rules" data-confidence="0.90"><a href="' || iri || '/html" title="' || label || ' (Rules) - No definition">' AS op, '</a></span>' AS cl FROM ex
      UNION ALL SELECT doc_id, start + 3, "end" + 3, 1, '<span class="individual" style="border-top: 2px solid #FF9800;" data-individual-type="phrase" title="' || upper(text) || ' (phrase)">', '</span>' FROM a
      UNION ALL SELECT doc_id, start, start + 2, 2, '<span class="property" style="text-decoration: underline wavy;" data-iri="#" title="' || text || ' - Object property">', '</span>' FROM a),
    sl AS (SELECT doc_id, s, least(e, length(text)) AS e, ord, op, cl FROM sp JOIN d USING (doc_id) WHERE s < length(text)),
    cut AS (SELECT doc_id, s AS p FROM sl UNION SELECT doc_id, e FROM sl UNION SELECT doc_id, 0 FROM d UNION SELECT doc_id, length(text) FROM d),
    seg AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nx FROM cut),
    cov AS (SELECT g.doc_id, p, nx, coalesce(list({{'s': s, 'e': -e, 'o': ord, 'op': op, 'cl': cl}} ORDER BY s, -e, ord, op) FILTER (op IS NOT NULL), []) AS st FROM seg g LEFT JOIN sl ON sl.doc_id = g.doc_id AND s <= p AND e >= nx GROUP BY g.doc_id, p, nx),
    pv AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY doc_id ORDER BY p), []) AS was FROM cov),
    cm AS (SELECT *, len(list_filter(range(1, least(len(st), len(was)) + 1), lambda i: st[1:i] = was[1:i])) AS same FROM pv),
    pg AS (SELECT doc_id, string_agg(array_to_string(list_reverse(list_transform(was[same + 1:], lambda x: x.cl)), '') || array_to_string(list_transform(st[same + 1:], lambda x: x.op), '')
      || coalesce(replace(replace(replace(replace(replace(substring(text, p + 1, nx - p), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), ''), '' ORDER BY p) AS body FROM cm JOIN d USING (doc_id) GROUP BY doc_id),
    tr AS (SELECT doc_id, '<h2>Extracted triples (' || count(*) || ')</h2><table><tr><th>Subject</th><th>Predicate</th><th>Object</th><th>Voice</th><th>Confidence</th><th>Linked</th></tr>'
      || string_agg('<tr><td>' || text || '</td><td>is in</td><td>' || upper(text) || '</td><td>active</td><td>0.50</td><td>' || CASE WHEN start % 2 = 0 THEN '✓' ELSE '' END || '</td></tr>', '' ORDER BY start) || '</table>' AS rows FROM a GROUP BY doc_id)
    SELECT doc_id, '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Annotated document</title></head><body><pre style="white-space: pre-wrap;">' || body || '</pre>' || coalesce(tr.rows, '') || '</body></html>' AS value FROM pg LEFT JOIN tr USING (doc_id)""")
def x12(spark, sf_dir):
    """Whole pages of all documents; individuals cross the annotations, properties lie in them."""
    return markup.to_page(C.normal(spark, sf_dir), *crossing(spark, sf_dir))


@query("x11_standoff", f"""WITH {S.ANNOTATED},
    it AS (SELECT doc_id, 0 AS sec, start, 1 AS nt, 2 AS na, 0 AS nr, ['Rules ' || start || ' ' || "end" || chr(9) || text] AS ts, ['IRI', 'Label'] AS an, [iri, label] AS av FROM ex
      UNION ALL SELECT doc_id, 1, start, 1, 1, 0, ['PHRASE ' || (start + 3) || ' ' || ("end" + 3) || chr(9) || text], ['CanonicalName'], [upper(text)] FROM a
      UNION ALL SELECT doc_id, 2, start, 1, 0, 0, ['PROPERTY ' || start || ' ' || (start + 2) || chr(9) || text], [], [] FROM a
      UNION ALL SELECT doc_id, 3, start, 2, 0, 1, ['TRIPLE_SUBJECT ' || start || ' ' || "end" || chr(9) || text, 'TRIPLE_OBJECT ' || (start + 3) || ' ' || ("end" + 3) || chr(9) || upper(text)], [], [] FROM a),
    nb AS (SELECT *, sum(nt) OVER w - nt AS t, sum(na) OVER w - na AS k, sum(nr) OVER w - nr AS r FROM it WINDOW w AS (PARTITION BY doc_id ORDER BY sec, start)),
    ln AS (SELECT doc_id, t + k + r AS base, list_concat(list_transform(ts, lambda x, i: 'T' || (t + i) || chr(9) || x), list_transform(av, lambda x, i: 'A' || (k + i) || chr(9) || an[i] || ' T' || (t + 1) || ' ' || x),
      CASE WHEN nr = 1 THEN ['R' || (r + 1) || chr(9) || 'is_in Arg1:T' || (t + 1) || ' Arg2:T' || (t + 2)] ELSE [] END) AS v FROM nb)
    SELECT doc_id, CAST(base + i AS INTEGER) AS n, value FROM (SELECT doc_id, base, unnest(v) AS value, generate_subscripts(v, 1) AS i FROM ln)""")
def x11(spark, sf_dir):
    return markup.to_standoff(*crossing(spark, sf_dir))


# --- an ontology made of the given tables -------------------------------------------------------------

#: Parts below kinds (brand and type), kinds below brands, brands below the root; suppliers are related to the parts that they deliver.
GIVEN = {
    "concepts": """SELECT 'part:' || p_partkey AS iri, p_name AS label, CASE WHEN p_size % 3 = 0 THEN upper(p_name) WHEN p_size % 3 = 1 THEN p_type || ' ' || p_name END AS pref_label,
          'A ' || p_name || ' of ' || p_brand || '.' AS definition, p_type AS branch, p_size = 1 AS deprecated, CAST(p_partkey AS INT) AS ord FROM {part}
        UNION ALL SELECT 'supplier:' || s_suppkey, s_name, NULL, NULL, 'SUPPLIER', false, CAST(s_suppkey AS INT) FROM {supplier}
        UNION ALL SELECT DISTINCT 'kind:' || p_brand || ':' || p_type, p_brand || ' ' || p_type, NULL, 'Parts of one brand and type.', p_type, false, -1 FROM {part}
        UNION ALL SELECT DISTINCT 'brand:' || p_brand, p_brand, NULL, NULL, 'BRAND', false, -2 FROM {part} UNION ALL SELECT 'lex:root', 'thing', NULL, NULL, NULL, false, -3""",
    "labels_in": """SELECT 'part:' || p_partkey AS iri, p_brand || ' ' || p_name AS label, 'alternative' AS label_type FROM {part}
        UNION ALL SELECT 'part:' || p_partkey, p_type || ' ' || p_name, 'hidden' FROM {part} UNION ALL SELECT 'supplier:' || s_suppkey, lower(s_name), 'translation' FROM {supplier}""",
    "edges": """SELECT 'part:' || p_partkey AS child, 'kind:' || p_brand || ':' || p_type AS parent, 0 AS ord FROM {part} UNION ALL SELECT 'part:' || p_partkey, 'brand:' || p_brand, 1 FROM {part} WHERE p_size % 5 = 0
        UNION ALL SELECT DISTINCT 'kind:' || p_brand || ':' || p_type, 'brand:' || p_brand, 0 FROM {part} UNION ALL SELECT DISTINCT 'brand:' || p_brand, 'lex:root', 0 FROM {part}""",
    "see_also": "SELECT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, CAST(min(l_linenumber) AS INT) AS ord FROM {lineitem} GROUP BY l_partkey, l_suppkey",
    "properties_in": """SELECT 'p:' || n_nationkey AS iri, CASE WHEN n_regionkey = 0 THEN 'DEPRECATED ' ELSE 'geo:' END || 'tradesWith' || n_name AS label,
        CASE WHEN n_regionkey <> 1 THEN 'trade ' || n_regionkey END AS alt_label, CAST(NULL AS STRING) AS domain_iri, CAST(NULL AS STRING) AS range_iri, CAST(NULL AS STRING) AS inverse_of FROM {nation}""",
}
SOURCES = ("part", "supplier", "lineitem", "nation")


def given(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.sql(GIVEN[n], **{s: read(spark, sf_dir, s) for s in SOURCES if "{" + s + "}" in GIVEN[n]}) for n in names]


def over_given(sql: str, **more: str) -> str:
    """A twin over the own small ontology, with its tables taken from the given ones instead."""
    for name, text in GIVEN.items():
        sql = sql.replace(ontology_data.sql_table(name), f"{name} AS ({text.format(**{s: s for s in SOURCES}).replace('AS STRING', 'AS VARCHAR')})")
    for name, text in more.items():
        head, tail = sql.split(f"{name} AS (SELECT CAST", 1)
        depth, end = 1, 0
        for end, ch in enumerate(tail):  # the end of the literal table
            depth += (ch == "(") - (ch == ")")
            if not depth:
                break
        sql = f"{head}{name} AS ({text}{tail[end:]}"
    return sql


@query("o1_given_concepts", over_given(C.SQL["o1_concepts"]))
def o1(spark, sf_dir):
    return ontology.concept_projection(*given(spark, sf_dir, "concepts"))


@query("o2_given_label_winner", over_given(C.SQL["o2_label_winner"]))
def o2(spark, sf_dir):
    return ontology.label_winner(ontology.label_rows(*given(spark, sf_dir, "concepts", "labels_in")))


@query("o3_given_label_all", over_given(C.SQL["o3_label_all"]))
def o3(spark, sf_dir):
    return ontology.label_all(ontology.label_rows(*given(spark, sf_dir, "concepts", "labels_in")))


@query("o4_given_property_labels", over_given(C.SQL["o4_property_labels"]))
def o4(spark, sf_dir):
    return ontology.property_labels(*given(spark, sf_dir, "properties_in"))


@query("o5_given_branch_root", over_given(C.SQL["o5_branch_root"]))
def o5(spark, sf_dir):
    return ontology.hierarchy(spark, "branch", *given(spark, sf_dir, "concepts", "edges"))


@query("o6_given_branch_counts", over_given(C.SQL["o6_branch_counts"]))
def o6(spark, sf_dir):
    return ontology.branch_counts(*given(spark, sf_dir, "concepts"))


@query("g3_given_path", over_given(C.SQL["g3_path"]))
def g3(spark, sf_dir):
    return ontology.hierarchy(spark, "path", *given(spark, sf_dir, "concepts", "edges"))


@query("g4_given_paths", over_given(C.SQL["g4_paths"]))
def g4(spark, sf_dir):
    return ontology.hierarchy(spark, "paths", *given(spark, sf_dir, "concepts", "edges"))


@query("g6_given_detail", over_given(C.SQL["g6_detail"]))
def g6(spark, sf_dir):
    return ontology.concept_detail(*given(spark, sf_dir, "concepts", "edges", "see_also"))


@query("g8_given_batch", over_given(C.SQL["g6_detail"]) + " WHERE c.iri IN (SELECT DISTINCT 'part:' || l_partkey FROM lineitem ORDER BY 1 LIMIT 100)")
def g8(spark, sf_dir):
    """Details of the first hundred delivered parts by name; a hundred is the most that a batch takes."""
    asked = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("iri"))
    return ontology.batch_detail(*given(spark, sf_dir, "concepts", "edges", "see_also"), asked)


@query("o7_given_labels", over_given(C.SQL["o7_by_label"], asked="SELECT upper(p_name) || ' ' AS query FROM part"))
def o7(spark, sf_dir):
    asked = read(spark, sf_dir, "part").select(F.concat(F.upper("p_name"), F.lit(" ")).alias("query"))
    return ontology.by_label(asked, ontology.label_rows(*given(spark, sf_dir, "concepts", "labels_in")))


# --- search and resolution over it --------------------------------------------------------------------

NAMES = "SELECT DISTINCT lower(p_name) AS query FROM part"
MENTIONED = """SELECT CAST(p_partkey AS INT) AS ord, p_name AS text, CASE WHEN p_size % 4 > 0 THEN p_type END AS branch, CAST((p_size % 7) / 10.0 AS DOUBLE) AS confidence,
    CASE WHEN p_size % 3 = 0 THEN 'part:' || p_partkey WHEN p_size % 3 = 1 THEN 'gone:' || p_partkey END AS iri FROM {part}"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.lower("p_name").alias("query")).distinct()


def given_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(asked(spark, sf_dir), *given(spark, sf_dir, "concepts", "labels_in", "edges"), excluded=("Acts",))


@query("q3_given_relevance", over_given(C.SQL["q3_relevance"], asked=NAMES))
def q3(spark, sf_dir):
    return search.scores(asked(spark, sf_dir), *given(spark, sf_dir, "concepts", "labels_in"))


@query("q8_given_search", over_given(C.SQL["q8_search"], asked=NAMES))
def q8(spark, sf_dir):
    """The five best concepts for the name of each part, with ancestors."""
    return given_hits(spark, sf_dir)


@query("q9_given_resolve", over_given(C.SQL["q9_resolve"], asked=NAMES, mentions=MENTIONED.format(part="part")))
def q9(spark, sf_dir):
    """Each part's name as a mention, with and without a branch and a concept of its own."""
    mentions = spark.sql(MENTIONED, part=read(spark, sf_dir, "part"))
    return search.resolve(mentions, given_hits(spark, sf_dir), *given(spark, sf_dir, "concepts"), ("Acts",))


@query("q10_given_resolve_multi", over_given(C.SQL["q10_resolve_multi"], asked=NAMES, mentions=MENTIONED.format(part="part")))
def q10(spark, sf_dir):
    mentions = spark.sql(MENTIONED, part=read(spark, sf_dir, "part")).select(F.lower("text").alias("text"), F.lower(F.coalesce("branch", F.lit(""))).alias("branch"))
    return search.ranked_by_branch(mentions, given_hits(spark, sf_dir), *given(spark, sf_dir, "concepts"), 3)


# --- properties with base forms -----------------------------------------------------------------------

ENDS = ", ".join(f"({k}, '{e}', '{t}')" for k, (e, t) in enumerate(properties.ENDINGS))


@query("m12_lemmas", f"""WITH {C.TOKENS.split('hits AS')[0]} wc AS (SELECT token AS word, count(*) AS n FROM tl GROUP BY token),
    lab AS (SELECT word AS label_key, 'p:' || word AS iri, CASE WHEN length(word) % 2 = 0 THEN 'preferred' ELSE 'alternative' END AS label_type FROM wc WHERE regexp_matches(word, '^[a-z]+(ing|ed|s)$') AND length(word) > 3),
    en AS (SELECT * FROM (VALUES {ENDS}) AS t(k, e, r)), st AS (SELECT label_key AS word, iri, k, r, left(label_key, length(label_key) - length(e)) AS stem FROM lab JOIN en ON ends_with(label_key, e)),
    tr AS (SELECT word, iri, 2 * k AS k, stem || r AS lemma FROM st UNION ALL SELECT word, iri, 2 * k + 1, stem[:-2] FROM st WHERE r = '' AND stem[-1] = stem[-2:-2] AND regexp_matches(stem, '[b-df-hj-np-tv-z]$')),
    bs AS (SELECT tr.word, iri, arg_min(lemma, n * -100 + k) AS lemma FROM tr JOIN wc ON wc.word = tr.lemma WHERE length(lemma) > 2 GROUP BY tr.word, iri),
    rows AS (SELECT label_key, iri, label_type FROM lab UNION ALL SELECT lemma, arg_min(iri, word), 'lemma' FROM bs WHERE lemma NOT IN ({", ".join(f"'{w}'" for w in properties.COMMON)}) AND lemma NOT IN (SELECT label_key FROM lab) GROUP BY lemma)
    SELECT label_key, iri, label_type, CAST(CASE label_type WHEN 'preferred' THEN 0.85 WHEN 'lemma' THEN 0.72 ELSE 0.75 END AS DOUBLE) AS confidence, wc.n, d.n_docs FROM rows JOIN wc ON wc.word = label_key
      JOIN (SELECT token, count(DISTINCT doc_id) AS n_docs FROM tl GROUP BY token) d ON d.token = label_key""")
def m12(spark, sf_dir):
    """Words of the documents that end in -ing, -ed or -s as labels of properties, and their base forms as the documents show them."""
    d = read(spark, sf_dir, "documents")
    words = properties.word_counts(d).where(r"word RLIKE '^[a-z]+(ing|ed|s)$' AND length(word) > 3")
    labels = words.select(F.col("word").alias("label_key"), F.concat(F.lit("p:"), "word").alias("iri"), F.when(F.length("word") % 2 == 0, "preferred").otherwise("alternative").alias("label_type"))
    return properties.match_properties(d, labels).groupBy("label_key", "iri", "label_type", "confidence").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


# --- markdown, ruler patterns and prompts -------------------------------------------------------------

MARKED = "concat('## ', lang, chr(10), chr(10), '- **', source, '** [a](b) ![c](d)', chr(10), '1. `', doc_id, '` __x__', chr(10), '---', chr(10), coalesce(text, ''))"


def markdown_sql() -> str:
    out = "t"
    for pattern, to in T.MARKDOWN_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"regexp_replace({out}, '{T.STRIP}', '', 'g')"


@query("s3_documents", f"SELECT doc_id, {markdown_sql()} AS text FROM (SELECT doc_id, {MARKED} AS t FROM documents)")
def s3(spark, sf_dir):
    """Every text below a head of markdown that is made of its own columns."""
    return read(spark, sf_dir, "documents").select("doc_id", T.strip_markdown(F.expr(MARKED)).alias("text"))


@query("m3_given_patterns", over_given(C.SQL["m3_ruler_patterns"]))
def m3(spark, sf_dir):
    return ruler.patterns(ontology.label_winner(ontology.label_rows(*given(spark, sf_dir, "concepts", "labels_in"))))


@query("u7_given_branch_detail", over_given(C.SQL["u7_branch_detail"]))
def u7(spark, sf_dir):
    return models.branch_detail(*given(spark, sf_dir, "concepts"))
