"""More queries of the catalog: ruler, search and resolution, graphs, triples, lifecycle, exports, and folds written as recursive SQL."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import catalog as C
from lexweave.functions import text as T
from lexweave.operators import annotate, lifecycle, match, ontology, reconcile, ruler, search, triples
from lexweave.sources import ontology_data
from lexweave.streaming import events as streams

query, read, onto, tables, labels = C.query, C.read, C.onto, C.tables, C.labels


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


def islands_sql(source: str, keys: str, order: str, carry: str, tag: str = "") -> str:
    """isl: rows of ``source`` with their island and their number in it by ``order``; ``tag`` ends the names of a second copy."""
    return f"""mk1{tag} AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
    mk2{tag} AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach <= start THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start, "end" DESC) AS island FROM mk1{tag}),
    isl{tag} AS (SELECT {keys}, island, start, "end", {carry}, row_number() OVER (PARTITION BY {keys}, island ORDER BY {order}) AS k FROM mk2{tag})"""


def greedy_sql(keys: str, tag: str = "") -> str:
    """kept: the numbers of an island's rows that overlap none kept before, row by row."""
    on = " AND ".join(f"i.{c.strip()} = r.{c.strip()}" for c in keys.split(","))
    own = ", ".join(f"r.{c.strip()}" for c in keys.split(","))
    return f"""fold{tag} AS (SELECT {keys}, island, CAST(1 AS BIGINT) AS k, [{{'s': start, 'e': "end", 'k': k}}] AS kept FROM isl{tag} WHERE k = 1
      UNION ALL SELECT {own}, r.island, i.k, CASE WHEN len(list_filter(r.kept, lambda x: x.s < i."end" AND i.start < x.e)) > 0 THEN r.kept ELSE list_append(r.kept, {{'s': i.start, 'e': i."end", 'k': i.k}}) END
        FROM fold{tag} r JOIN isl{tag} i ON {on} AND i.island = r.island AND i.k = r.k + 1),
    kept{tag} AS (SELECT {keys}, island, unnest(list_transform(arg_max(kept, k), lambda x: x.k)) AS k FROM fold{tag} GROUP BY {keys}, island)"""


LABEL_ALL = "al AS (SELECT label_key, iri, label_type FROM (SELECT *, row_number() OVER (PARTITION BY label_key, iri ORDER BY type_rank, ord) AS n FROM rows) WHERE n = 1)"
WINNER = "win AS (SELECT label_key, iri, label_type FROM (SELECT *, row_number() OVER (PARTITION BY label_key ORDER BY type_rank, ord DESC, iri) AS n FROM rows) WHERE n = 1)"

SAME_IRI = recursive(
    onto("concepts", "labels_in") + f""", {C.LABEL_ROWS}, {C.TOKENS}, {LABEL_ALL},
    sp AS (SELECT h.doc_id, a.iri, h.start, h."end", CAST({C.CONF.replace('label_key', 'h.label_key')} AS DOUBLE) AS confidence FROM hits h JOIN al a ON a.label_key = h.label_key),
    {islands_sql("sp", "doc_id, iri", 'start - "end", -confidence, start, "end"', "confidence")}, {greedy_sql("doc_id, iri")}
    SELECT i.doc_id, i.iri, i.start, i."end", i.confidence FROM isl i JOIN kept q ON q.doc_id = i.doc_id AND q.iri = i.iri AND q.island = i.island AND q.k = i.k"""
)


@query("m11_same_concept_spans", SAME_IRI)
def m11(spark, sf_dir):
    rows = labels(spark)
    hit = match.match(read(spark, sf_dir, "documents"), rows).join(ontology.label_all(rows), "label_key")
    spans = hit.select("doc_id", "iri", "start", "end", match.confidence(F.col("label_type"), F.col("label_key")).alias("confidence"))
    return match.same_iri_spans(spans).drop("n_absorbed")


def resolve_sql(tag: str = "") -> str:
    """resolved: of crossing spans of ``hits`` the longer takes the slot of the first kept one that it crosses; equal ones stay once, nested ones all."""
    return islands_sql(f"hits{tag}", "doc_id", 'start, "end" DESC, label_key', "label_key", tag) + f""",
    fold{tag} AS (SELECT doc_id, island, CAST(1 AS BIGINT) AS k, [{{'s': start, 'e': "end", 'k': k}}] AS kept FROM isl{tag} WHERE k = 1
      UNION ALL SELECT r.doc_id, r.island, i.k, CASE WHEN r.at IS NULL THEN list_append(r.kept, {{'s': i.start, 'e': i."end", 'k': i.k}})
          WHEN i."end" - i.start > r.kept[r.at].e - r.kept[r.at].s THEN list_concat(list_append(r.kept[1:r.at - 1], {{'s': i.start, 'e': i."end", 'k': i.k}}), r.kept[r.at + 1:]) ELSE r.kept END
        FROM (SELECT f.*, j.k AS nk, list_position(list_transform(f.kept, lambda x: x.s < j."end" AND j.start < x.e AND ((x.s = j.start AND x.e = j."end") OR NOT ((j.start >= x.s AND j."end" <= x.e) OR (x.s >= j.start AND x.e <= j."end")))), true) AS at
              FROM fold{tag} f JOIN isl{tag} j ON j.doc_id = f.doc_id AND j.island = f.island AND j.k = f.k + 1) r
        JOIN isl{tag} i ON i.doc_id = r.doc_id AND i.island = r.island AND i.k = r.nk),
    resolved{tag} AS (SELECT i.doc_id, i.start, i."end", i.label_key FROM (SELECT doc_id, island, unnest(list_transform(arg_max(kept, k), lambda x: x.k)) AS k FROM fold{tag} GROUP BY doc_id, island) q JOIN isl{tag} i USING (doc_id, island, k))"""


RESOLVE = resolve_sql()

C.SQL["m2_overlaps"] = recursive(onto("concepts", "labels_in") + f', {C.LABEL_ROWS}, {C.TOKENS}, {RESOLVE} SELECT doc_id, start, "end", label_key FROM resolved')
C.SQL["flagship"] = recursive(
    onto("concepts", "labels_in") + f""", {C.LABEL_ROWS}, d AS (SELECT doc_id, {C.NORMAL} AS text FROM documents), {C.TOKENS.replace("FROM documents", "FROM d")}, {RESOLVE}, {LABEL_ALL}
    SELECT c.branch, a.iri, count(*) AS n, count(DISTINCT h.doc_id) AS n_docs, round(avg(CAST({C.CONF.replace('label_key', 'h.label_key')} AS DOUBLE)), 6) AS confidence
    FROM resolved h JOIN al a ON a.label_key = h.label_key JOIN concepts c ON c.iri = a.iri GROUP BY c.branch, a.iri"""
)

STOPPED = ", ".join(f"'{w}'" for w in ruler.STOP)
PATTERNS = f"""{WINNER}, pat AS (SELECT label_key, iri, label_type, CAST(len(list_filter(string_split_regex(label_key, '\\s+'), lambda w: w <> '')) AS INTEGER) AS n_words FROM win WHERE length(label_key) >= {ruler.SHORTEST} AND label_key NOT IN ({STOPPED}))"""


@query("m3_ruler_patterns", onto("concepts", "labels_in") + f", {C.LABEL_ROWS}, {PATTERNS} SELECT label_key, iri, label_type, n_words FROM pat")
def m3(spark, sf_dir):
    return ruler.patterns(ontology.label_winner(labels(spark)))


SCAN = f"""{C.LABEL_ROWS}, {PATTERNS}, {C.TOKENS.replace("FROM rows)", "FROM pat)")}, sp AS (SELECT h.*, n_words FROM hits h JOIN pat p ON p.label_key = h.label_key),
    {islands_sql("sp", "doc_id", '-n_words, start, "end", label_key', "label_key")}, {greedy_sql("doc_id")},
    scanned AS (SELECT i.doc_id, i.start, i."end", i.label_key FROM isl i JOIN kept q ON q.doc_id = i.doc_id AND q.island = i.island AND q.k = i.k)"""


@query("m4_ruler_scan", recursive(onto("concepts", "labels_in") + f', {SCAN} SELECT doc_id, start, "end", label_key FROM scanned'))
def m4(spark, sf_dir):
    return ruler.scan(read(spark, sf_dir, "documents"), m3(spark, sf_dir))


@query("m8_preliminary", recursive(onto("concepts", "labels_in") + f""", {SCAN} SELECT substr(sha256(concat_ws('|', doc_id, start, "end", iri)), 1, 16) AS ann_id, doc_id, start, "end", s.label_key AS text, iri, label_type AS match_type,
    CAST({C.CONF.replace('label_key', 's.label_key')} AS DOUBLE) AS confidence, 'preliminary' AS state FROM scanned s JOIN pat p ON p.label_key = s.label_key"""))
def m8(spark, sf_dir):
    return ruler.preliminary(read(spark, sf_dir, "documents"), m3(spark, sf_dir))


@query("m13_property_dedup")
def m13(spark, sf_dir):
    rows = ontology.property_labels(tables(spark)["properties_in"])
    hit = match.match(read(spark, sf_dir, "documents"), rows.unionByName(labels(spark).select("label_key", "iri", "label_type"))).join(rows.unionByName(labels(spark).select("label_key", "iri", "label_type")), "label_key")
    return ruler.dedup_properties(hit.select("doc_id", "start", "end", "iri", F.when(F.col("label_type") == "preferred", 0.85).otherwise(0.75).alias("confidence")))


@query("m7_semantic_candidates")
def m7(spark, sf_dir):
    d, rows = read(spark, sf_dir, "documents"), labels(spark)
    return annotate.semantic_spans(d, match.match(d, rows), ontology.label_winner(rows).select("label_key", "iri"), 0.8, tuple(search.STOP))


# --- search and resolution ----------------------------------------------------------------------------

EXPANSIONS = {"actor": ["service"], "rule": ["place", "binds"]}
ASKED = [*C.ASKED, ("the",), ("ords of the te",), ("national actors",), ("he",), ("Actor",), ("rule",), ("places and words",)]


def words_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in search.STOP)
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z]+'), lambda w: length(w) >= 2 AND w NOT IN ({stop})))"


def overlap_sql(q: str, t: str) -> str:
    least = "least(length(a), length(b))"
    prefix = f"len(list_filter(range(1, {least} + 1), lambda i: left(a, i) = left(b, i)))"
    credit = f"CASE WHEN a = b THEN 1.0 WHEN {least} >= 3 AND (starts_with(a, b) OR starts_with(b, a)) THEN 0.8 WHEN {least} >= 5 AND {prefix} >= 4 AND {prefix} / {least} >= 0.7 THEN 0.7 ELSE 0.0 END"
    way = lambda s, d: f"list_sum(list_transform({s}, lambda a: list_max(list_transform({d}, lambda b: CAST({credit} AS DOUBLE))))) / len({s})"
    return f"CASE WHEN len({q}) = 0 OR len({t}) = 0 THEN 0.0 ELSE greatest({way(q, t)}, CASE WHEN len({t}) >= 2 THEN {way(t, q)} * 0.75 ELSE 0.0 END) END"


#: Every term against every concept, without candidates.
RELEVANCE = f"""syn AS (SELECT iri, list(DISTINCT label ORDER BY label) AS synonyms FROM labels_in GROUP BY iri),
    known AS (SELECT c.*, coalesce(s.synonyms, []) AS synonyms FROM concepts c LEFT JOIN syn s ON s.iri = c.iri WHERE NOT deprecated),
    pairs AS (SELECT t.query, t.term, lower(trim(t.term)) AS q, k.iri, lower(label) AS l, lower(pref_label) AS p, lower(definition) AS d, {words_sql("t.term")} AS qw, {words_sql("label")} AS lw,
      {words_sql("coalesce(pref_label, '')")} AS pw, {words_sql("coalesce(definition, '')")} AS dw, list_transform(synonyms, lambda s: {words_sql("s")}) AS sw FROM terms t, known k),
    parts AS (SELECT *, greatest(CASE WHEN length(q) >= 4 AND contains(l, q) THEN 85.0 WHEN length(l) >= 4 AND contains(q, l) AND length(l) / length(q) > 0.3 THEN 78.0 ELSE 0.0 END, {overlap_sql("qw", "lw")} * 88) AS a,
      CASE WHEN p IS NULL OR p = '' THEN 0.0 WHEN q = p THEN 90.0 WHEN length(q) >= 4 AND contains(p, q) THEN 84.0 ELSE {overlap_sql("qw", "pw")} * 86 END AS b,
      coalesce(list_max(list_transform(sw, lambda s: {overlap_sql("qw", "s")} * 82)), 0.0) AS c,
      CASE WHEN d IS NULL THEN 0.0 ELSE greatest(CASE WHEN contains(d, q) THEN 60.0 ELSE 0.0 END, {overlap_sql("qw", "dw")} * 55) END AS e FROM pairs),
    scored AS (SELECT query, term, iri, CASE WHEN coalesce(l, '') = '' THEN 0.0 WHEN q = l THEN CASE WHEN len(string_split_regex(q, '\\s+')) >= 3 THEN 97.0 WHEN len(string_split_regex(q, '\\s+')) = 2 THEN 92.0 ELSE 82.0 END
      ELSE round(least(CASE WHEN greatest(a, b, c) > 0 THEN greatest(a, b, c) + least(e * 0.12, 8.0) ELSE e END, 99.0), 1) END AS score FROM parts),
    found AS (SELECT query, iri, max(score) AS score FROM scored WHERE score >= 30 GROUP BY query, iri)"""


def terms_sql(asked: list[tuple], expansions: dict[str, list[str]]) -> str:
    more = " ".join(f"UNION SELECT query, '{w} {e}' FROM asked WHERE list_contains({words_sql('query')}, '{w}')" for w, extra in expansions.items() for e in extra)
    return f"{ontology_data.sql_table('asked', 'query string', asked)}, terms AS (SELECT DISTINCT query, query AS term FROM asked {more})"


HITS = f"""{terms_sql(ASKED, EXPANSIONS)}, {RELEVANCE}, par AS (SELECT child, parent FROM edges WHERE ord = 0),
    up AS (SELECT f.query, p.parent AS iri, f.score * 0.85::DOUBLE AS score FROM found f JOIN par p ON p.child = f.iri WHERE f.score >= 50
      UNION ALL SELECT f.query, p2.parent, f.score * {0.85**2!r}::DOUBLE FROM found f JOIN par p ON p.child = f.iri JOIN par p2 ON p2.child = p.parent WHERE f.score >= 50
      UNION ALL SELECT f.query, p3.parent, f.score * {0.85**3!r}::DOUBLE FROM found f JOIN par p ON p.child = f.iri JOIN par p2 ON p2.child = p.parent JOIN par p3 ON p3.child = p2.parent WHERE f.score >= 50),
    hits AS (SELECT query, iri, score FROM found UNION ALL SELECT query, iri, round(max(score), 1) FROM up WHERE score >= 30 AND NOT EXISTS (SELECT 1 FROM found f WHERE f.query = up.query AND f.iri = up.iri) GROUP BY query, iri),
    best AS (SELECT h.query, h.iri, CAST(h.score AS DOUBLE) AS score, coalesce(c.branch, '') AS own, CAST(row_number() OVER (PARTITION BY h.query ORDER BY h.score DESC, h.iri) AS INTEGER) AS rank FROM hits h JOIN concepts c ON c.iri = h.iri
      WHERE NOT c.deprecated AND coalesce(c.branch, '') <> 'Acts')"""


def hits(spark: SparkSession, top: int = 5) -> DataFrame:
    t = tables(spark)
    return search.search(spark.createDataFrame(ASKED, "query string"), t["concepts"], t["labels_in"], t["edges"], top=top, expansions=EXPANSIONS, excluded=("Acts",))


@query("q8_search", onto("concepts", "labels_in", "edges") + f", {HITS} SELECT query, iri, score, rank FROM best WHERE rank <= 5")
def q8(spark, sf_dir):
    return hits(spark)


@query("q3_relevance", onto("concepts", "labels_in") + f", {terms_sql(ASKED, {})}, {RELEVANCE} SELECT query, iri, CAST(score AS DOUBLE) AS score FROM found")
def q3(spark, sf_dir):
    t = tables(spark)
    return search.scores(spark.createDataFrame(ASKED, "query string"), t["concepts"], t["labels_in"])


#: (ord, text, branch, confidence, iri)
MENTIONS = [
    (0, "rule", None, 0.9, None), (1, "Rule", "", 0.4, "lex:act"), (2, "rule", "places", 0.5, None), (3, "places", None, 0.7, "lex:und"), (4, "the actor", "Actors", 0.0, "lex:gone"),
    (5, "he", None, 0.6, "lex:is"), (6, "nothing here", None, 0.8, None), (7, "of the", "Places", 0.3, None), (8, "being many", None, 0.5, None),
]
MENTION = "ord int, text string, branch string, confidence double, iri string"
RESOLVED = f"""{ontology_data.sql_table("mentions", MENTION, MENTIONS)}, keyed AS (SELECT *, lower(text) AS t, lower(coalesce(branch, '')) AS b FROM mentions),
    one AS (SELECT t, b, iri, confidence FROM (SELECT *, row_number() OVER (PARTITION BY t, b ORDER BY ord) AS n FROM keyed) WHERE n = 1),
    pick AS (SELECT o.t, o.b, h.iri, h.score, row_number() OVER (PARTITION BY o.t, o.b ORDER BY CASE WHEN o.b <> '' AND NOT contains(lower(h.own), o.b) THEN 1 ELSE 0 END, h.score DESC, h.iri) AS rank FROM one o JOIN best h ON h.query = o.t WHERE h.rank <= 5),
    done AS (SELECT o.t, o.b, CASE WHEN c.iri IS NOT NULL THEN c.iri ELSE p.iri END AS resolved, round(CASE WHEN c.iri IS NOT NULL THEN o.confidence WHEN p.score > 0 AND o.confidence > 0 THEN 0.6 * (p.score / 100) + 0.4 * o.confidence ELSE p.score / 100 END, 4) AS final
      FROM one o LEFT JOIN concepts c ON c.iri = o.iri LEFT JOIN pick p ON p.t = o.t AND p.b = o.b AND p.rank = 1),
    fine AS (SELECT d.* FROM done d JOIN concepts c ON c.iri = d.resolved WHERE coalesce(c.branch, '') <> 'Acts')"""


@query("q9_resolve", onto("concepts", "labels_in", "edges") + f", {HITS}, {RESOLVED} SELECT k.ord, k.text, k.branch, k.confidence, k.iri, f.resolved, CAST(f.final AS DOUBLE) AS final FROM keyed k LEFT JOIN fine f ON f.t = k.t AND f.b = k.b")
def q9(spark, sf_dir):
    return search.resolve(spark.createDataFrame(MENTIONS, MENTION), hits(spark), tables(spark)["concepts"], ("Acts",))


@query("q10_resolve_multi", onto("concepts", "labels_in", "edges") + f", {HITS}, {RESOLVED} SELECT t AS text, b AS branch, iri, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM pick WHERE rank <= 3")
def q10(spark, sf_dir):
    asked = spark.createDataFrame(MENTIONS, MENTION).select(F.lower("text").alias("text"), F.lower(F.coalesce("branch", F.lit(""))).alias("branch"))
    return search.ranked_by_branch(asked, hits(spark), tables(spark)["concepts"], 3)


@query("q11_resolution")
def q11(spark, sf_dir):
    d, m = read(spark, sf_dir, "documents").select("doc_id"), spark.createDataFrame(MENTIONS, MENTION)
    some = lambda part, keep: d.where(part).join(m.where(keep))  # noqa: E731  nine mentions
    shown = ["doc_id", "ord", "text", "branch", "confidence", "iri"]
    return search.resolution(*(some(p, k).select(*shown) for p, k in (("doc_id % 3 = 0", "ord < 5"), ("doc_id % 2 = 0", "ord >= 3"), ("true", "true"))), hits(spark), tables(spark)["concepts"], ("Acts",), {"Rules": "Places"})


@query("o7_by_label", onto("concepts", "labels_in") + f", {C.LABEL_ROWS}, {ontology_data.sql_table('asked', 'query string', ASKED)} SELECT DISTINCT query, iri FROM asked JOIN rows ON label_key = lower(trim(query))")
def o7(spark, sf_dir):
    return ontology.by_label(spark.createDataFrame(ASKED, "query string"), labels(spark))


@query("o7_by_prefix", onto("concepts", "labels_in") + f", {C.LABEL_ROWS}, {ontology_data.sql_table('asked', 'query string', [('a',), ('th',), ('i',), ('zz',)])} SELECT DISTINCT query, label_key, iri FROM asked JOIN rows ON starts_with(label_key, query)")
def o7b(spark, sf_dir):
    return ontology.by_prefix(spark.createDataFrame([("a",), ("TH",), ("i",), ("zz",)], "query string").select(F.lower("query").alias("query")), labels(spark))


@query("g8_batch", C.SQL["g6_detail"] + " WHERE c.iri IN ('lex:rule', 'lex:is_the', 'lex:root')")
def g8(spark, sf_dir):
    t = tables(spark)
    return ontology.batch_detail(t["concepts"], t["edges"], t["see_also"], spark.createDataFrame([("lex:rule",), ("lex:is_the",), ("lex:root",), ("lex:unknown",), ("lex:rule",)], "iri string"))


@query("g7_graph", recursive(onto("edges", "see_also") + """, anc AS (SELECT 'lex:is_the' AS iri, 0 AS d UNION ALL SELECT e.parent, a.d - 1 FROM anc a JOIN edges e ON e.child = a.iri),
    des AS (SELECT 'lex:is_the' AS iri, 0 AS d UNION ALL SELECT e.child, a.d + 1 FROM des a JOIN edges e ON e.parent = a.iri WHERE a.d < 2),
    n1 AS (SELECT iri, max(d) AS depth, CASE WHEN max(d) = 0 THEN 'focus' ELSE 'ancestor' END AS phase FROM anc GROUP BY iri UNION ALL SELECT iri, min(d), 'descendant' FROM des WHERE d > 0 GROUP BY iri),
    rel AS (SELECT DISTINCT dst AS iri FROM see_also JOIN n1 ON n1.iri = src WHERE dst NOT IN (SELECT iri FROM n1)),
    ra AS (SELECT iri, 0 AS d FROM rel UNION ALL SELECT e.parent, a.d - 1 FROM ra a JOIN edges e ON e.child = a.iri WHERE e.parent NOT IN (SELECT iri FROM n1) AND e.parent NOT IN (SELECT iri FROM rel))
    SELECT iri, CAST(depth AS INTEGER) AS depth, phase, false AS truncated FROM (SELECT * FROM n1 UNION ALL SELECT iri, max(d), CASE WHEN max(d) = 0 THEN 'related' ELSE 'related_ancestor' END FROM ra GROUP BY iri)"""))
def g7(spark, sf_dir):
    t = tables(spark)
    return ontology.entity_graph(spark, t["edges"], t["see_also"], "lex:is_the")


# --- reconciliation -----------------------------------------------------------------------------------

CONFLICTS = f"""r AS (SELECT doc_id, lower(concept_text) AS text, iri, arg_max(confidence, ord) AS c, min(ord) AS ord FROM ruler GROUP BY ALL), m AS (SELECT doc_id, lower(concept_text) AS text, iri, arg_max(confidence, ord) AS c, min(ord) AS ord FROM llm GROUP BY ALL),
    x AS (SELECT doc_id, text, iri FROM r INTERSECT SELECT doc_id, text, iri FROM m), bare AS (SELECT doc_id, text FROM r ANTI JOIN x USING (doc_id, text, iri) WHERE iri = '' UNION SELECT doc_id, text FROM m ANTI JOIN x USING (doc_id, text, iri) WHERE iri = ''),
    ra AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY ord, iri) AS k FROM (SELECT * FROM r ANTI JOIN x USING (doc_id, text, iri) WHERE iri <> '') ANTI JOIN bare USING (doc_id, text)),
    ma AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY ord, iri) AS k FROM (SELECT * FROM m ANTI JOIN x USING (doc_id, text, iri) WHERE iri <> '') ANTI JOIN bare USING (doc_id, text)),
    pr AS (SELECT ra.doc_id, ra.text, ra.iri AS ri, ra.c AS rc, ma.iri AS mi, ma.c AS mc FROM ra JOIN ma ON ma.doc_id = ra.doc_id AND ma.text = ra.text AND ma.k = ra.k)"""


@query("r6_conflicts", f"""WITH ruler AS (SELECT doc_id, lang AS concept_text, 'lex:' || (doc_id % 5) AS iri, round(0.5 + (doc_id % 5) / 10.0, 2)::DOUBLE AS confidence, 0 AS ord FROM documents),
    llm AS (SELECT doc_id, upper(lang) AS concept_text, 'lex:' || (doc_id % 7) AS iri, round(0.4 + (doc_id % 6) / 10.0, 2)::DOUBLE AS confidence, 0 AS ord FROM documents), {CONFLICTS},
    cc AS (SELECT DISTINCT 'lex:' || k AS iri, lab AS label, def AS definition FROM (VALUES (0, 'en', 'a text'), (1, 'e', 'in en or de'), (2, 'fran', 'fr text here'), (3, 'es', 'the es'), (4, 'deu', 'of de'), (5, 'q', 'fr'), (6, 'en', NULL)) AS t(k, lab, def)),
    p AS (SELECT pr.*, 1 - levenshtein(text, a.label) / greatest(length(text), length(a.label)) AS rs, 1 - levenshtein(text, b.label) / greatest(length(text), length(b.label)) AS ms,
      list_distinct(list_filter(string_split_regex(lower(coalesce(a.definition, '')), '\\s+'), lambda w: w <> '' AND w NOT IN ({", ".join(f"'{w}'" for w in reconcile.COMMON)}))) AS rw,
      list_distinct(list_filter(string_split_regex(lower(coalesce(b.definition, '')), '\\s+'), lambda w: w <> '' AND w NOT IN ({", ".join(f"'{w}'" for w in reconcile.COMMON)}))) AS mw FROM pr JOIN cc a ON a.iri = ri JOIN cc b ON b.iri = mi),
    o AS (SELECT *, CASE WHEN list_contains(rw, text) THEN 1.0 / len(rw) ELSE 0.0 END AS ro, CASE WHEN list_contains(mw, text) THEN 1.0 / len(mw) ELSE 0.0 END AS mo FROM p)
    SELECT doc_id, text, ri AS iri, round(CASE WHEN greatest(rs, ms) > 0.85 THEN greatest(rc, rs) ELSE rc END, 6)::DOUBLE AS confidence FROM o WHERE CASE WHEN greatest(rs, ms) > 0.85 THEN rs >= ms ELSE ro >= mo END
    UNION ALL SELECT doc_id, text, mi, round(CASE WHEN greatest(rs, ms) > 0.85 THEN greatest(mc, ms) ELSE mc END, 6)::DOUBLE FROM o WHERE CASE WHEN greatest(rs, ms) > 0.85 THEN rs < ms ELSE mo >= ro END""")
def r6(spark, sf_dir):
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    side = lambda text, n, a, b: d.select("doc_id", text.alias("concept_text"), F.concat(F.lit("lex:"), i % n).alias("iri"), F.round(a + (i % b) / 10, 2).alias("confidence"), F.lit(0).alias("ord"))
    known = spark.createDataFrame([("lex:0", "en", "a text"), ("lex:1", "e", "in en or de"), ("lex:2", "fran", "fr text here"), ("lex:3", "es", "the es"), ("lex:4", "deu", "of de"), ("lex:5", "q", "fr"), ("lex:6", "en", None)], "iri string, label string, definition string")
    near = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    out = reconcile.reconcile_with_triage(side(F.col("lang"), 5, 0.5, 5), side(F.upper("lang"), 7, 0.4, 6), known, near)
    return out.where("category = 'conflict_resolved'").select("doc_id", "text", "iri", F.round("confidence", 6).alias("confidence"))


# --- triples over a token table made of order lines -----------------------------------------------------

LINE_TOKENS = """tok AS (SELECT l_orderkey AS doc_id, 0 AS sent_idx, CAST(k AS INTEGER) AS tok_idx, CAST(10 * k AS INTEGER) AS start, CAST(10 * k + 5 AS INTEGER) AS "end", l_returnflag || l_linenumber AS token, CAST(CASE WHEN k = 0 THEN 0 ELSE (k - 1) // 2 END AS INTEGER) AS head,
    CASE l_returnflag WHEN 'A' THEN 'VERB' WHEN 'R' THEN 'NOUN' ELSE 'ADV' END AS pos FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) - 1 AS k FROM lineitem))"""


def line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")) - 1
    li = read(spark, sf_dir, "lineitem").withColumn("k", k)
    pos = F.when(F.col("l_returnflag") == "A", "VERB").when(F.col("l_returnflag") == "R", "NOUN").otherwise("ADV")
    head = F.when(F.col("k") == 0, 0).otherwise(F.floor((F.col("k") - 1) / 2)).cast("int")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("sent_idx"), F.col("k").alias("tok_idx"), (10 * F.col("k")).alias("start"), (10 * F.col("k") + 5).alias("end"), F.concat("l_returnflag", "l_linenumber").alias("token"), head.alias("head"), pos.alias("pos"))


@query("t3_subtrees", recursive(f"""WITH {LINE_TOKENS}, sub AS (SELECT doc_id, tok_idx AS root, tok_idx, start, "end", token FROM tok
    UNION ALL SELECT s.doc_id, s.root, t.tok_idx, t.start, t."end", t.token FROM sub s JOIN tok t ON t.doc_id = s.doc_id AND t.head = s.tok_idx AND t.tok_idx <> t.head)
    SELECT doc_id, 0 AS sent_idx, root AS tok_idx, min(start) AS start, arg_max("end", tok_idx) AS "end", string_agg(token, ' ' ORDER BY tok_idx) AS text FROM sub GROUP BY doc_id, root"""))
def t3(spark, sf_dir):
    return triples.subtrees(line_tokens(spark, sf_dir))


@query("p2_pos_of_lines", f"""WITH {LINE_TOKENS}, sp AS (SELECT DISTINCT doc_id, 3 AS start, 34 AS "end" FROM tok), c AS (SELECT s.doc_id, s.start, s."end", pos, count(*) AS n, min(tok_idx) AS seen FROM sp s JOIN tok t ON t.doc_id = s.doc_id AND t.start < s."end" AND s.start < t."end" GROUP BY ALL)
    SELECT doc_id, start, "end", pos AS majority FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS k FROM c) WHERE k = 1""")
def p2(spark, sf_dir):
    t = line_tokens(spark, sf_dir)
    return triples.majority_pos(t.select("doc_id", F.lit(3).alias("start"), F.lit(34).alias("end")).distinct(), t)


@query("t4_links", """WITH t AS (SELECT doc_id, 't' || doc_id AS triple_id, lower(text) AS s, lower(source) AS p, lower(lang) AS o FROM documents), i AS (SELECT doc_id, 'i' || doc_id AS id, lower(lang) AS m FROM documents), q AS (SELECT doc_id, 'p' || doc_id AS id, 'e' AS m FROM documents)
    SELECT triple_id, 'subject' AS role, 'individual' AS kind, id AS entity_id, CAST(0.8 AS DOUBLE) AS confidence FROM t JOIN i USING (doc_id) WHERE m <> '' AND contains(s, m)
    UNION ALL SELECT triple_id, 'object', 'individual', id, 0.8 FROM t JOIN i USING (doc_id) WHERE m <> '' AND contains(o, m) UNION ALL SELECT triple_id, 'predicate', 'property', id, 0.75 FROM t JOIN q USING (doc_id) WHERE contains(p, m)""")
def t4(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    t = d.select("doc_id", F.concat(F.lit("t"), "doc_id").alias("triple_id"), F.col("text").alias("subject"), F.col("source").alias("predicate"), F.col("lang").alias("object"))
    i = d.select("doc_id", F.concat(F.lit("i"), "doc_id").alias("id"), F.upper("lang").alias("mention"))
    p = d.select("doc_id", F.concat(F.lit("p"), "doc_id").alias("id"), F.lit("e").alias("text"), F.lit(0.75).alias("confidence"))
    return triples.link_texts(t, i, p)


# --- lifecycle, analytics, individuals ------------------------------------------------------------------


@query("l4_lineage", f"""WITH {C.ANN}, h AS (SELECT ann_id, min(CASE WHEN rank > 0 AND iri = 'p7' THEN rank END) AS b FROM ac GROUP BY ann_id HAVING max(CASE WHEN rank = 0 AND iri = 'p3' THEN 1 END) = 1 AND b IS NOT NULL)
    SELECT DISTINCT ac.ann_id, iri, 'cascade_promote' AS action, 'rank ' || CASE WHEN rank = b THEN 0 ELSE b END || ', ' || CASE WHEN rank = b THEN 'confirmed' ELSE 'backup' END AS detail FROM ac JOIN h ON h.ann_id = ac.ann_id WHERE rank = b OR rank = 0""")
def l4(spark, sf_dir):
    before = C.ann_concepts(spark, sf_dir)
    return lifecycle.lineage(before, lifecycle.cascade_promote(before, "p3", "p7"), "cascade_promote")


@query("l6_feedback_lines", f"""WITH {C.FEEDBACK} SELECT id, CASE WHEN stage IS NULL THEN to_json({{'id': id, 'job_id': job_id, 'rating': rating, 'iri': iri, 'label': label, 'created_at': strftime(created_at, '%Y-%m-%d %H:%M:%S')}})
    ELSE to_json({{'id': id, 'job_id': job_id, 'rating': rating, 'stage': stage, 'iri': iri, 'label': label, 'created_at': strftime(created_at, '%Y-%m-%d %H:%M:%S')}}) END AS value FROM feedback""")
def l6(spark, sf_dir):
    return lifecycle.feedback_lines(C.feedback(spark, sf_dir))


@query("a7_area_summary", onto("concepts", "labels_in") + f""", {C.LABEL_ROWS}, {C.TOKENS}, {WINNER},
    x AS (SELECT h.doc_id, h.start * 1000 + h."end" AS ord, c.label || ' [' || coalesce(c.branch, '') || ']' AS key, c.definition FROM hits h JOIN win w ON w.label_key = h.label_key JOIN concepts c ON c.iri = w.iri),
    g AS (SELECT doc_id, key, count(*) AS n, min(ord) AS ord, min(definition) AS d FROM x GROUP BY doc_id, key), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord, key) AS k FROM g)
    SELECT doc_id, string_agg(key || coalesce(' — ' || regexp_replace(left(d, 60), '\\s+$', '') || CASE WHEN length(d) > 60 THEN '...' ELSE '' END, '') || CASE WHEN n > 1 THEN ' (x' || n || ')' ELSE '' END, ', ' ORDER BY k) AS summary FROM t WHERE k <= 30 GROUP BY doc_id""")
def a7(spark, sf_dir):
    rows, c = labels(spark), tables(spark)["concepts"]
    hit = match.match(read(spark, sf_dir, "documents"), rows).join(ontology.label_winner(rows), "label_key").join(c.select("iri", "label", "branch", "definition"), "iri")
    return lifecycle.area_summary(hit.select("doc_id", (F.col("start") * 1000 + F.col("end")).alias("ord"), "label", "branch", "definition"))


@query("a8_areas", "SELECT doc_id, area, confidence, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, area) AS INTEGER) AS rank FROM (SELECT p_partkey % 50 AS doc_id, p_name AS area, p_size / 50.0::DOUBLE AS confidence FROM part) WHERE confidence >= 0.5")
def a8(spark, sf_dir):
    return lifecycle.areas(read(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("doc_id"), F.col("p_name").alias("area"), (F.col("p_size") / 50.0).alias("confidence")))


@query("a11_document_fields", "SELECT l_orderkey AS doc_id, CAST(max(l_linenumber) + 1 AS INTEGER) AS page_count FROM lineitem GROUP BY l_orderkey")
def a11(spark, sf_dir):
    return lifecycle.document_fields(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")))


@query("e19_class_iris", onto("concepts", "labels_in") + f""", {C.LABEL_ROWS}, {WINNER}, x AS (SELECT doc_id, [ 'Actor', 'PLACE', 'Rule', 'none', 'la' ][doc_id % 5 + 1] AS label, CASE WHEN doc_id % 3 = 0 THEN 'lex:own' END AS iri, CASE WHEN doc_id % 2 = 0 THEN 'Own' ELSE '' END AS branch FROM documents)
    SELECT x.doc_id, x.label, CASE WHEN x.iri IS NULL AND w.iri IS NOT NULL THEN w.iri ELSE x.iri END AS iri, CASE WHEN x.iri IS NULL AND w.iri IS NOT NULL AND x.branch = '' THEN c.branch ELSE x.branch END AS branch
    FROM x LEFT JOIN win w ON w.label_key = lower(x.label) LEFT JOIN concepts c ON c.iri = w.iri""")
def e19(spark, sf_dir):
    i = F.col("doc_id")
    label = F.get(F.array(*[F.lit(v) for v in ("Actor", "PLACE", "Rule", "none", "la")]), (i % 5).cast("int"))
    links = read(spark, sf_dir, "documents").select("doc_id", label.alias("label"), F.when(i % 3 == 0, "lex:own").alias("iri"), F.when(i % 2 == 0, "Own").otherwise("").alias("branch"))
    return annotate.fill_class_iris(links, ontology.label_winner(labels(spark)), tables(spark)["concepts"])


# --- folds over chunks and requests ---------------------------------------------------------------------

PACKED = f"""{C.SENTENCES}, dd AS (SELECT doc_id, {C.NORMAL} AS text FROM documents), long AS (SELECT doc_id FROM dd WHERE length(text) > 3000),
    st AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) AS BIGINT) AS k, CAST(length(sentence) AS BIGINT) AS n FROM sentences SEMI JOIN long USING (doc_id)),
    fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS held, CAST(0 AS BIGINT) AS len, CAST(0 AS BIGINT) AS start, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM long
      UNION ALL SELECT doc_id, k, CASE WHEN full_ THEN list_append(tail, n) ELSE list_append(held, n) END, CASE WHEN full_ THEN used + n + 1 ELSE len + n + 1 END, CASE WHEN full_ THEN start + size - used ELSE start END, CASE WHEN full_ THEN start END, CASE WHEN full_ THEN start + size END
      FROM (SELECT *, CASE WHEN m = 0 THEN CAST([] AS BIGINT[]) ELSE held[-m:] END AS tail, CASE WHEN m = 0 THEN CAST(0 AS BIGINT) ELSE CAST(list_sum(held[-m:]) + m AS BIGINT) END AS used FROM (
        SELECT r.doc_id, s.k, s.n, r.held, r.len, r.start, len(r.held) > 0 AND r.len + s.n > 3000 AS full_, CASE WHEN len(r.held) > 0 THEN CAST(list_sum(r.held) + len(r.held) - 1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS size,
          len(list_filter(range(1, len(r.held) + 1), lambda i: list_sum(r.held[-i:]) + i <= 200)) AS m FROM fold r JOIN st s ON s.doc_id = r.doc_id AND s.k = r.k + 1))),
    ch AS (SELECT doc_id, k, a, b FROM fold WHERE a IS NOT NULL UNION ALL SELECT doc_id, k + 1, start, start + CAST(list_sum(held) + len(held) - 1 AS BIGINT) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS last FROM fold) WHERE last = 1 AND len(held) > 0
      UNION ALL SELECT doc_id, 0, 0, length(text) FROM dd WHERE length(text) <= 3000)"""
C.SQL["n5_chunks"] = recursive(f'WITH {PACKED} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, CAST(a AS INTEGER) AS start_offset, CAST(b AS INTEGER) AS end_offset, CAST(b - a AS INTEGER) AS chars FROM ch')


@query("n7_text_counts", recursive(f"""WITH {PACKED}, sn AS (SELECT doc_id, count(*) AS c FROM sentences GROUP BY doc_id), cn AS (SELECT doc_id, count(*) AS c FROM ch GROUP BY doc_id)
    SELECT dd.doc_id, CAST(length(dd.text) AS INTEGER) AS n_chars, CAST(coalesce(sn.c, 0) AS INTEGER) AS n_sentences, cn.c AS n_chunks FROM dd LEFT JOIN sn ON sn.doc_id = dd.doc_id LEFT JOIN cn ON cn.doc_id = dd.doc_id"""))
def n7(spark, sf_dir):
    return T.text_counts(read(spark, sf_dir, "documents"))


C.SQL["k3_rate_limit"] = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    fold AS (SELECT user_id, event_id, k, [ms] AS held, true AS allowed FROM e WHERE k = 1
      UNION ALL SELECT x.user_id, x.event_id, x.k, CASE WHEN len(live) < 3 THEN list_append(live, x.ms) ELSE live END, len(live) < 3
      FROM (SELECT n.*, list_filter(f.held, lambda t: t > n.ms - 86400) AS live FROM fold f JOIN e n ON n.user_id = f.user_id AND n.k = f.k + 1) x)
    SELECT event_id, user_id, allowed FROM fold"""

SNAPSHOTS = """sn AS (SELECT 'j' || (user_id % 50) AS job_id, CAST(event_id % 4 AS BIGINT) AS seq, CASE event_type WHEN 'click' THEN 'annotation' WHEN 'view' THEN 'individual' ELSE 'triple' END AS entity, 'x' || (user_id % 7) AS entity_id,
      CASE WHEN event_id % 3 = 0 THEN 'preliminary' ELSE 'confirmed' END AS state FROM events
    UNION ALL SELECT 'j' || j, s, 'status', '', CASE WHEN j % 2 = 0 AND s = 2 THEN 'completed' WHEN s = 0 THEN 'pending' ELSE 'running' END FROM range(50) a(j), range(4) b(s))"""


def snapshots(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "annotation").when(F.col("event_type") == "view", "individual").otherwise("triple")
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("j"), u % 50).alias("job_id"), (e % 4).cast("long").alias("seq"), kind.alias("entity"), F.concat(F.lit("x"), u % 7).alias("entity_id"), F.when(e % 3 == 0, "preliminary").otherwise("confirmed").alias("state"))
    j, s = F.floor(F.col("id") / 4), F.col("id") % 4
    status = F.when((j % 2 == 0) & (s == 2), "completed").when(s == 0, "pending").otherwise("running")
    return rows.unionByName(spark.range(200).select(F.concat(F.lit("j"), j).alias("job_id"), s.alias("seq"), F.lit("status").alias("entity"), F.lit("").alias("entity_id"), status.alias("state")))


@query("k1_job_events", f"""WITH {SNAPSHOTS}, live AS (SELECT * FROM sn WHERE seq <= 2 OR CAST(job_id[2:] AS INTEGER) % 2 = 1), st AS (SELECT job_id, seq, state, lag(state) OVER (PARTITION BY job_id ORDER BY seq) AS was FROM live WHERE entity = 'status'),
    n AS (SELECT job_id, seq, entity_id, min(state) AS state FROM live WHERE entity = 'annotation' GROUP BY ALL), top AS (SELECT job_id, max(seq) AS m FROM st GROUP BY job_id)
    SELECT job_id, seq, 'status' AS event, state AS entity_id FROM st WHERE state IS DISTINCT FROM was UNION ALL SELECT job_id, seq, 'complete', state FROM st WHERE state = 'completed'
    UNION ALL SELECT n.job_id, n.seq, CASE WHEN o.state IS NULL THEN CASE WHEN n.state = 'preliminary' THEN 'preliminary_annotation' ELSE 'annotation' END ELSE 'annotation_update' END, n.entity_id FROM n LEFT JOIN n o ON o.job_id = n.job_id AND o.seq = n.seq - 1 AND o.entity_id = n.entity_id WHERE n.state IS DISTINCT FROM o.state
    UNION ALL SELECT o.job_id, o.seq + 1, 'annotation_removed', o.entity_id FROM n o JOIN top ON top.job_id = o.job_id AND o.seq + 1 <= m WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.job_id = o.job_id AND n.seq = o.seq + 1 AND n.entity_id = o.entity_id)
    UNION ALL SELECT job_id, min(seq), entity || '_added', entity_id FROM live WHERE entity IN ('individual', 'triple') GROUP BY job_id, entity, entity_id""")
def k1_events(spark, sf_dir):
    return streams.job_events(snapshots(spark, sf_dir))


# --- exports --------------------------------------------------------------------------------------------

ANNOTATED = f"""rows AS (SELECT unnest(['of the', 'de la', 'in the']) AS label_key), d AS (SELECT doc_id, {C.NORMAL} AS text FROM documents), {C.TOKENS.replace("FROM documents", "FROM d")},
    an AS (SELECT doc_id, doc_id || '-' || start AS ann_id, start, "end", label_key AS text, CASE WHEN start % 10 = 0 THEN 'rejected' ELSE 'confirmed' END AS state FROM hits),
    a AS (SELECT * FROM an WHERE state <> 'rejected'), c AS (SELECT ann_id, 0 AS rank, 'lex:' || replace(text, ' ', '_') AS iri, text AS label, 'Rules' AS branch, 0.9::DOUBLE AS confidence FROM an),
    ex AS (SELECT a.doc_id, a.ann_id, a.start, a."end", a.text, c.rank, c.iri, c.label, c.branch, c.confidence FROM a JOIN c USING (ann_id))"""
for _name, _sql in {
    "csv": """SELECT doc_id, ann_id, start, "end", text, rank, iri, label, branch, printf('%.4f', confidence) AS confidence FROM ex""",
    "jsonld": """SELECT doc_id, to_json({'@type': 'oa:Annotation', '@id': 'urn:lexweave:ann/' || ann_id, 'oa:hasBody': iri, 'oa:hasTarget': {'source': 'urn:lexweave:doc/' || doc_id, 'selector': {'@type': 'oa:TextPositionSelector', 'start': start, 'end': "end"}}, 'confidence': confidence}) AS value FROM ex""",
    "jsonl": """SELECT to_json({'record_type': 'annotation', 'doc_id': doc_id, 'ann_id': ann_id, 'start': start, 'end': "end", 'text': text, 'state': state}) AS value FROM a
      UNION ALL SELECT to_json({'record_type': 'concept', 'ann_id': ann_id, 'rank': rank, 'iri': iri, 'label': label, 'confidence': confidence}) FROM c""",
    "json": """SELECT doc_id, to_json({'doc_id': doc_id, 'annotations': list({'start': start, 'end': "end", 'ann_id': ann_id, 'text': text, 'concepts': [{'rank': rank, 'iri': iri, 'label': label, 'branch': branch, 'confidence': confidence}]} ORDER BY start, "end", ann_id),
      'statistics': {'annotations': count(*), 'distinct_concepts': count(DISTINCT iri)}}) AS value FROM ex GROUP BY doc_id""",
    "elasticsearch": """SELECT ann_id || '-' || rank AS id, 0 AS k, '{"index":{"_index":"annotations"}}' AS value FROM ex
      UNION ALL SELECT ann_id || '-' || rank, 1, to_json({'doc_id': doc_id, 'start': start, 'end': "end", 'text': text, 'iri': iri, 'label': label, 'branch': branch, 'confidence': confidence}) FROM ex""",
    "rdf": """SELECT DISTINCT doc_id, unnest(['<urn:lexweave:ann/' || ann_id || '> <http://www.w3.org/ns/oa#hasBody> <' || iri || '> .', '<urn:lexweave:ann/' || ann_id || '> <http://www.w3.org/ns/oa#exact> "' || text || '" .']) AS value FROM ex""",
    "brat": """SELECT doc_id, CAST(n AS INTEGER) AS n, 'T' || n || chr(9) || branch || ' ' || start || ' ' || "end" || chr(9) || text AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, ann_id) AS n FROM ex)""",
    "xml": """SELECT doc_id, '<annotation ann_id="' || ann_id || '" start="' || start || '" end="' || "end" || '" iri="' || iri || '" confidence="' || confidence || '">' || text || '</annotation>' AS value FROM ex""",
    "neo4j": """SELECT DISTINCT ann_id AS src, iri AS dst, 'REFERS_TO' AS kind FROM ex""",
}.items():
    C.SQL[f"x_{_name}"] = f"WITH {ANNOTATED} {_sql}"
C.SQL["x_rag"] = recursive(f"""WITH {PACKED}, cx AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, a AS lo, b AS hi FROM ch), {ANNOTATED.replace("m AS", "m9 AS")}
    SELECT cx.doc_id, chunk_index, count(a.ann_id) AS n_items FROM cx LEFT JOIN a ON a.doc_id = cx.doc_id AND a.start >= lo AND a."end" <= hi GROUP BY cx.doc_id, chunk_index""")


LITERALS = [(1, 'a"b\\c\nd\te\rf'), (2, "plain"), (3, "\\n")]


@query("x10_literals", f"""WITH {ontology_data.sql_table("given", "id bigint, text string", [(i, t) for i, t in LITERALS])}
    SELECT id, '"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') || '"' AS value FROM (SELECT id, text FROM given UNION ALL SELECT doc_id + 10, text FROM documents)""")
def x10(spark, sf_dir):
    from lexweave.sinks import export

    given = spark.createDataFrame(LITERALS, "id bigint, text string").unionByName(read(spark, sf_dir, "documents").select((F.col("doc_id") + 10).alias("id"), "text"))
    return given.select("id", export.literal(F.col("text")).alias("value"))


C.SQL["x_parquet_rows"] = f"WITH {ANNOTATED} SELECT doc_id, ann_id, start, \"end\", text, rank, iri, label, branch, confidence FROM ex"
C.SQL["x_excel_sheets"] = f"WITH {ANNOTATED} SELECT doc_id, count(*) AS n FROM ex GROUP BY doc_id"


@query("x_parquet_rows")
def x6(spark, sf_dir):
    from lexweave.sinks import export

    return export.to_tables(*C.annotated(spark, sf_dir))["annotations"]


@query("x_excel_sheets")
def x13(spark, sf_dir):
    """Rows of each document's sheet, counted in its workbook's XML."""
    from lexweave.sinks import export

    @F.pandas_udf("bigint")
    def n_rows(books: pd.Series) -> pd.Series:
        return pd.Series([zipfile.ZipFile(io.BytesIO(b)).read("xl/worksheets/sheet1.xml").count(b"<row>") - 1 for b in books])

    return export.to_excel(*C.annotated(spark, sf_dir)).select("doc_id", n_rows("value").alias("n"))
