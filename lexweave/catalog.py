"""All queries of the engine's own operators, with their DuckDB twins.

Small literal tables are shared by both sides; everything else runs over the given tables as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import config
from lexweave.functions import text as T
from lexweave.operators import annotate, entities, lifecycle, match, models, ontology, reconcile, search, triples, vectors
from lexweave.sinks import export
from lexweave.sources import ingest, ontology_data
from lexweave.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WS = T.WS


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def onto(*names: str) -> str:
    return "WITH " + ", ".join(ontology_data.sql_table(n) for n in names)


# --- text ---------------------------------------------------------------------------------------------

NORMAL = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[{WS}]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' *\\n *', chr(10), 'g'), '^[{WS}\\n]+|[{WS}\\n]+$', '', 'g')"
SENTENCES = f"""
m AS (SELECT doc_id, regexp_replace({NORMAL}, '([.!?])(\\s+)([A-Z])', '\\1\\2' || chr(1) || '\\3', 'g') AS t FROM documents),
p AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS piece, generate_subscripts(string_split(t, chr(1)), 1) AS i FROM m),
q AS (SELECT doc_id, i, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p),
sentences AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS sent_idx, CAST(s AS INTEGER) AS start,
                     CAST(s + length(regexp_replace(piece, '\\s+$', '')) AS INTEGER) AS "end", regexp_replace(piece, '\\s+$', '') AS sentence
              FROM q WHERE length(regexp_replace(piece, '[{WS}\\n]+', '', 'g')) > 0)"""


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@query("n1_normalize", f"SELECT doc_id, {NORMAL} AS text FROM documents")
def n1(spark, sf_dir):
    return normal(spark, sf_dir)


@query("n2_sentences", f"WITH {SENTENCES} SELECT doc_id, count(*) AS n_sentences, sum(length(sentence)) AS chars FROM sentences GROUP BY doc_id".replace("sum(length(sentence))", "CAST(sum(length(sentence)) AS BIGINT)"))
def n2(spark, sf_dir):
    s = normal(spark, sf_dir).select("doc_id", F.explode(T.sentences_of(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length(F.regexp_replace("s", r"\s+$", ""))).alias("chars"))


@query("n3_sentence_index", f'WITH {SENTENCES} SELECT doc_id, sent_idx, start, "end", sentence FROM sentences')
def n3(spark, sf_dir):
    return T.sentence_index(normal(spark, sf_dir))


@query("n5_chunks")
def n5(spark, sf_dir):
    c = T.chunks(normal(spark, sf_dir), config.CHUNK_CHARS, config.CHUNK_OVERLAP)
    return c.select("doc_id", "chunk_index", "start_offset", "end_offset", F.length("text").alias("chars"))


@query(
    "s1_detect_format",
    """SELECT doc_id, CASE WHEN t LIKE 'JVBER%' THEN 'pdf' WHEN t LIKE 'UEsDB%' THEN 'word' WHEN t LIKE '{\\rtf%' THEN 'rtf'
       WHEN regexp_matches(t, '^(?i:From|Subject|Date|To|Message-ID):\\s') THEN 'email' WHEN t LIKE '<!%' OR lower(t) LIKE '<html%' THEN 'html'
       WHEN t LIKE '# %' OR contains(t, chr(10) || '## ') THEN 'markdown' ELSE 'plain_text' END AS format
       FROM (SELECT doc_id, text AS t FROM documents UNION ALL SELECT -1 - page_id, html FROM pages)""",
)
def s1(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(read(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text")))
    return d.select("doc_id", T.detect_format(F.lit(""), F.col("text")).alias("format"))


MARKDOWN = [(1, "# Head\n\nSome *bold* and [link](u) text\n- a\n- b\n1. one"), (2, "plain"), (3, "```code``` __x__\n---\n![pic](p.png)")]


@query("s3_markdown", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'Head' || chr(10) || chr(10) || 'Some bold and link text' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'one'), (2, 'plain'), (3, 'code x' || chr(10) || chr(10) || '!pic')) AS t(doc_id, text)")
def s3(spark, sf_dir):
    return spark.createDataFrame(MARKDOWN, "doc_id bigint, t string").select("doc_id", T.strip_markdown(F.col("t")).alias("text"))


@query(
    "s4_html_elements",
    """SELECT page_id, CAST(count(*) FILTER (kind = 'heading') AS BIGINT) AS headings, CAST(count(*) FILTER (kind = 'list_item') AS BIGINT) AS list_items FROM (
         SELECT page_id, 'heading' AS kind, unnest(regexp_extract_all(html, '<h[1-6]>[^<]*\\S[^<]*</h')) AS x FROM pages
         UNION ALL SELECT page_id, 'list_item', unnest(regexp_extract_all(html, '<li>')) FROM pages) GROUP BY page_id""",
)
def s4(spark, sf_dir):
    e = ingest.html_elements(read(spark, sf_dir, "pages"))
    return e.groupBy("page_id").agg(F.count_if(F.col("element_type") == "heading").alias("headings"), F.count_if(F.col("element_type") == "list_item").alias("list_items")).where("headings + list_items > 0")


@query("s10_ingest", "SELECT format, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT 'a.txt' AS format, text AS t FROM documents) GROUP BY format")
def s10(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.lit("a.txt").alias("filename"))
    return ingest.ingest(d).agg(F.lit("a.txt").alias("format"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).select("format", "n", "chars")


JOBS = "SELECT 'j' || user_id || '-' || event_type AS job_id, CASE event_type WHEN 'click' THEN 'enriching' WHEN 'view' THEN 'completed' ELSE 'pending' END AS status, max(ts) AS updated_at FROM events GROUP BY user_id, event_type"


@query("s13_job_sweep", f"""WITH jobs AS ({JOBS}), n AS (SELECT max(ts) AS now FROM events)
    SELECT job_id, CASE WHEN status NOT IN ('completed', 'failed', 'pending') AND updated_at < now - INTERVAL 30 MINUTE THEN 'failed' ELSE status END AS status
    FROM jobs, n WHERE updated_at >= now - INTERVAL 10 DAY""")
def s13(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "enriching").when(F.col("event_type") == "view", "completed").otherwise("pending")
    jobs = e.groupBy("user_id", "event_type").agg(F.max("ts").cast("timestamp").alias("updated_at")).select(F.concat(F.lit("j"), "user_id", F.lit("-"), "event_type").alias("job_id"), status.alias("status"), "updated_at")
    now = e.agg(F.max("ts").cast("timestamp")).first()[0]
    return lifecycle.job_sweep(jobs, F.lit(now), 30, 10).select("job_id", "status")


# --- ontology -----------------------------------------------------------------------------------------


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: ontology_data.frame(spark, n) for n in ontology_data.TABLES}


LABEL_ROWS = """rows AS (
  SELECT iri, lower(label) AS label_key, 'preferred' AS label_type, 0 AS type_rank, ord FROM concepts WHERE NOT deprecated UNION ALL
  SELECT l.iri, lower(l.label), label_type, CASE label_type WHEN 'alternative' THEN 1 WHEN 'hidden' THEN 2 ELSE 3 END, c.ord
  FROM labels_in l JOIN concepts c ON c.iri = l.iri WHERE NOT c.deprecated)"""


@query("o1_concepts", onto("concepts") + " SELECT iri, coalesce(label, pref_label) AS preferred_label, CASE WHEN lower(pref_label) <> lower(label) THEN pref_label END AS alt_pref, definition, branch, deprecated FROM concepts")
def o1(spark, sf_dir):
    return ontology.concept_projection(tables(spark)["concepts"])


@query("o2_label_winner", onto("concepts", "labels_in") + f", {LABEL_ROWS} SELECT label_key, iri, label_type FROM (SELECT *, row_number() OVER (PARTITION BY label_key ORDER BY type_rank, ord DESC, iri) AS k FROM rows) WHERE k = 1")
def o2(spark, sf_dir):
    t = tables(spark)
    return ontology.label_winner(ontology.label_rows(t["concepts"], t["labels_in"]))


@query("o3_label_all", onto("concepts", "labels_in") + f", {LABEL_ROWS} SELECT label_key, iri, label_type FROM (SELECT *, row_number() OVER (PARTITION BY label_key, iri ORDER BY type_rank, ord) AS k FROM rows) WHERE k = 1")
def o3(spark, sf_dir):
    t = tables(spark)
    return ontology.label_all(ontology.label_rows(t["concepts"], t["labels_in"]))


PROPS = """props AS (SELECT iri, lower(regexp_replace(regexp_replace(label, '^[a-z]+:', ''), '([a-z])([A-Z])', '\\1 \\2', 'g')) AS label_key, 0 AS r
  FROM properties_in WHERE label NOT LIKE 'DEPRECATED%' AND label NOT LIKE 'ZZZ:%' UNION ALL
  SELECT iri, lower(alt_label), 1 FROM properties_in WHERE label NOT LIKE 'DEPRECATED%' AND label NOT LIKE 'ZZZ:%' AND alt_label IS NOT NULL)"""


@query("o4_property_labels", onto("properties_in") + f", {PROPS} SELECT label_key, iri, CASE r WHEN 0 THEN 'preferred' ELSE 'alternative' END AS label_type FROM (SELECT *, row_number() OVER (PARTITION BY label_key ORDER BY r, iri) AS k FROM props) WHERE k = 1")
def o4(spark, sf_dir):
    return ontology.property_labels(tables(spark)["properties_in"])


UP = ", up AS (SELECT iri, iri AS node, 0 AS depth FROM concepts UNION ALL SELECT u.iri, e.parent, u.depth + 1 FROM up u JOIN edges e ON e.child = u.node WHERE u.depth < 20)"


def recursive(*names: str) -> str:
    return onto(*names).replace("WITH", "WITH RECURSIVE", 1)


@query("o5_branch_root", recursive("concepts", "edges") + UP + """ SELECT iri, node AS branch_root, depth FROM (
    SELECT u.iri, u.node, u.depth, row_number() OVER (PARTITION BY u.iri ORDER BY u.depth, u.node) AS k FROM up u JOIN edges r ON r.child = u.node AND r.parent = 'lex:root') WHERE k = 1""")
def o5(spark, sf_dir):
    t = tables(spark)
    return ontology.hierarchy(spark, "branch", t["concepts"], t["edges"])


@query("o6_branch_counts", onto("concepts") + " SELECT branch, count(*) AS n_concepts FROM concepts WHERE branch IS NOT NULL AND NOT deprecated GROUP BY branch")
def o6(spark, sf_dir):
    return ontology.branch_counts(tables(spark)["concepts"])


@query("g3_path", recursive("concepts", "edges") + """, up AS (SELECT iri, iri AS node, 0 AS depth, iri AS path FROM concepts UNION ALL
    SELECT u.iri, e.parent, u.depth + 1, e.parent || ' > ' || u.path FROM up u JOIN edges e ON e.child = u.node AND e.ord = 0 WHERE u.depth < 9 AND u.node <> 'lex:root')
    SELECT iri, depth, path FROM (SELECT *, row_number() OVER (PARTITION BY iri ORDER BY depth DESC) AS k FROM up) WHERE k = 1""")
def g3(spark, sf_dir):
    t = tables(spark)
    return ontology.hierarchy(spark, "path", t["concepts"], t["edges"])


@query("g4_paths", recursive("edges") + """, up AS (SELECT child AS iri, parent AS via, parent AS node, 1 AS depth, parent || ' > ' || child AS path FROM edges UNION ALL
    SELECT u.iri, u.via, e.parent, u.depth + 1, e.parent || ' > ' || u.path FROM up u JOIN edges e ON e.child = u.node AND e.ord = 0 WHERE u.depth < 9)
    SELECT DISTINCT iri, via, path FROM (SELECT *, row_number() OVER (PARTITION BY iri, via ORDER BY depth DESC) AS k FROM up) WHERE k = 1""")
def g4(spark, sf_dir):
    t = tables(spark)
    return ontology.hierarchy(spark, "paths", t["concepts"], t["edges"])


@query("g6_detail", onto("concepts", "edges", "see_also") + """ SELECT c.iri, list_extract(string_split(c.iri, '/'), -1) AS iri_hash,
    coalesce((SELECT string_agg(DISTINCT child, ',' ORDER BY child) FROM edges e WHERE e.parent = c.iri), '') AS children,
    coalesce((SELECT string_agg(DISTINCT parent, ',' ORDER BY parent) FROM edges e WHERE e.child = c.iri), '') AS parents,
    coalesce((SELECT string_agg(DISTINCT o.child, ',' ORDER BY o.child) FROM edges e JOIN edges o ON o.parent = e.parent WHERE e.child = c.iri AND e.ord = 0 AND o.child <> c.iri), '') AS siblings,
    coalesce((SELECT string_agg(DISTINCT dst, ',' ORDER BY dst) FROM see_also s WHERE s.src = c.iri), '') AS related FROM concepts c""")
def g6(spark, sf_dir):
    t = tables(spark)
    return ontology.concept_detail(t["concepts"], t["edges"], t["see_also"])


@query("g2_region_tree", """WITH RECURSIVE edges AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
    up AS (SELECT child AS iri, parent AS node, 1 AS depth FROM edges UNION ALL SELECT u.iri, e.parent, u.depth + 1 FROM up u JOIN edges e ON e.child = u.node)
    SELECT node, count(*) AS n_below, max(depth) AS deepest FROM up GROUP BY node""")
def g2(spark, sf_dir):
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    e = c.select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")))
    return ontology.below_counts(spark, e)


# --- dictionary matching ------------------------------------------------------------------------------

TOKENS = """
mk AS (SELECT doc_id, regexp_replace(lower(text), '([\\p{L}\\p{N}_]+)', chr(1) || '\\1' || chr(2), 'g') AS t FROM documents),
pc AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS piece, generate_subscripts(string_split(t, chr(1)), 1) AS i FROM mk),
ps AS (SELECT doc_id, i, piece, coalesce(sum(length(piece) - (i > 1)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pc),
tk AS (SELECT doc_id, i, start, split_part(piece, chr(2), 1) AS token, split_part(piece, chr(2), 2) AS gap FROM ps WHERE i > 1),
tl AS (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM tk),
hits AS (SELECT t.doc_id, CAST(t.start AS INTEGER) AS start, CAST(t.start + length(k.label_key) AS INTEGER) AS "end", k.label_key FROM tl t
  JOIN (SELECT DISTINCT label_key, split_part(label_key, ' ', 1) AS a, split_part(label_key, ' ', 2) AS b FROM rows) k ON k.a = t.token AND (k.b = '' OR (t.gap = ' ' AND t.nxt = k.b)))"""


def labels(spark: SparkSession) -> DataFrame:
    t = tables(spark)
    return ontology.label_rows(t["concepts"], t["labels_in"])


@query("m1_match_automaton", onto("concepts", "labels_in") + f", {LABEL_ROWS}, {TOKENS} SELECT doc_id, start, \"end\", label_key FROM hits")
def m1(spark, sf_dir):
    return match.match(read(spark, sf_dir, "documents"), labels(spark))


@query("m1_match_anchor", SQL["m1_match_automaton"])
def m1b(spark, sf_dir):
    return match.match_anchor(read(spark, sf_dir, "documents"), labels(spark))


@query("m2_overlaps")
def m2(spark, sf_dir):
    return match.resolve_overlaps(m1(spark, sf_dir))


CONF = "CASE label_type WHEN 'preferred' THEN CASE WHEN contains(label_key, ' ') THEN 0.90 ELSE 0.72 END WHEN 'alternative' THEN CASE WHEN contains(label_key, ' ') THEN 0.65 ELSE 0.35 END WHEN 'translation' THEN CASE WHEN contains(label_key, ' ') THEN 0.60 ELSE 0.30 END ELSE 0.50 END"


@query("m5_m6_concepts", onto("concepts", "labels_in") + f""", {LABEL_ROWS}, {TOKENS}, al AS (SELECT label_key, iri, label_type FROM (SELECT *, row_number() OVER (PARTITION BY label_key, iri ORDER BY type_rank, ord) AS k FROM rows) WHERE k = 1)
    SELECT h.doc_id, a.iri, count(*) AS n, CAST(max({CONF.replace('label_key', 'h.label_key')}) AS DOUBLE) AS confidence FROM hits h JOIN al a ON a.label_key = h.label_key GROUP BY h.doc_id, a.iri""")
def m5(spark, sf_dir):
    rows = labels(spark)
    hit = match.match(read(spark, sf_dir, "documents"), rows).join(ontology.label_all(rows), "label_key")
    return hit.groupBy("doc_id", "iri").agg(F.count("*").alias("n"), F.max(match.confidence(F.col("label_type"), F.col("label_key"))).alias("confidence"))


@query("m12_properties", onto("properties_in") + f", {PROPS}, rows AS (SELECT label_key FROM props WHERE length(label_key) > 2), {TOKENS} SELECT doc_id, label_key, count(*) AS n FROM hits GROUP BY doc_id, label_key")
def m12(spark, sf_dir):
    rows = ontology.property_labels(tables(spark)["properties_in"]).where(F.length("label_key") > 2)
    return match.match(read(spark, sf_dir, "documents"), rows).groupBy("doc_id", "label_key").agg(F.count("*").alias("n"))


@query("n4_sentence_of_span", onto("concepts") + f""", rows AS (SELECT 'of the' AS label_key UNION ALL SELECT 'de la'), d AS (SELECT doc_id, {NORMAL} AS text FROM documents), {TOKENS.replace('FROM documents', 'FROM d')}, {SENTENCES}
    SELECT h.doc_id, h.start, h."end", CAST((SELECT arg_min(s.sent_idx, (CASE WHEN s.start <= h.start AND h."end" <= s."end" THEN 0 ELSE 1 END) * 1000000000000 + (CASE WHEN s.start <= h.start AND h."end" <= s."end" THEN 0 ELSE -(least(s."end", h."end") - greatest(s.start, h.start)) END) * 1000000 + s.sent_idx)
      FROM sentences s WHERE s.doc_id = h.doc_id AND s.start < h."end" AND h.start < s."end") AS INTEGER) AS sent_idx FROM hits h""")
def n4(spark, sf_dir):
    d = normal(spark, sf_dir)
    spans = match.match_automaton(d, ["of the", "de la"]).select("doc_id", "start", "end")
    return T.sentence_for_span(spans, T.sentence_index(d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, match the dictionary, resolve overlaps, attach concepts and confidences, count by branch and concept."""
    rows = labels(spark)
    kept = match.resolve_overlaps(match.match(normal(spark, sf_dir), rows))
    hit = kept.join(ontology.label_all(rows), "label_key").join(tables(spark)["concepts"].select("iri", "branch"), "iri")
    return hit.groupBy("branch", "iri").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg(match.confidence(F.col("label_type"), F.col("label_key"))), 6).alias("confidence"))


QUERIES["flagship"] = flagship

# --- entities -----------------------------------------------------------------------------------------

PLANTED = [
    (-1, "Pay $5,000 million dollars within thirty (30) days of January 15, 2023 unless 5% is due."), (-2, "The Supreme Court of Texas met on 2023-01-15; at least 3 years and 25 basis points."),
    (-3, '"Term" means 12 months. Copyright 2020-2024 Acme Widgets™ Inc. at 12 North Main Street, Suite 5'), (-4, "twenty dollars not to exceed 12.5 percent if provided that up to x. S.D. Cal."), (-5, "😀 € 7.50 and 3 hours"),
]


def with_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dealt(read(spark, sf_dir, "documents").select("doc_id", "text")).unionByName(spark.createDataFrame(PLANTED, "doc_id bigint, text string"))


def spans_sql(pattern: str, source: str = "documents", least: int = 1) -> str:
    """r: (doc_id, start, w) of a pattern's matches in ``source`` by sentinels, with ``\\s``, ``\\w`` and ``\\b`` as RE2 has them."""
    p = pattern.replace(r"\x{201C}", "“").replace(r"\x{201D}", "”").replace("'", "''")
    return f"""m AS (SELECT doc_id, regexp_replace(text, '{p}', chr(1) || '\\1' || chr(2), 'g') AS t FROM {source}),
      p AS (SELECT doc_id, unnest(string_split(t, chr(1))) AS piece, generate_subscripts(string_split(t, chr(1)), 1) AS i FROM m),
      q AS (SELECT doc_id, i, piece, coalesce(sum(length(piece) - (i > 1)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM p),
      r AS (SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(s + length(split_part(piece, chr(2), 1)) AS INTEGER) AS "end", split_part(piece, chr(2), 1) AS w FROM q WHERE i > 1)"""


def entity_sql(e: entities.Entity) -> str:
    planted = ontology_data.sql_table("planted", "doc_id bigint, text string", PLANTED)
    pattern = e.pattern.replace(r"\w", r"\p{L}\p{N}_") if e.kind == "trademark" else e.pattern
    term = e.pattern.replace(r"\x{201C}", "“").replace(r"\x{201D}", "”")
    name = f"regexp_extract(w, '(?i){term}', 1)" if e.kind == "definition" else "mention"
    return f"""WITH {planted}, d AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM planted), {spans_sql(f"{'(?i)' if e.ignore_case else ''}({pattern})", "d")}
      SELECT doc_id, start, "end", regexp_replace(w, '^\\s+|\\s+$', '', 'g') AS mention, {name} AS name, '{e.kind}' AS kind, '{e.label}' AS label, CAST({e.confidence} AS DOUBLE) AS confidence FROM r WHERE length(mention) >= {e.least}"""


for _n, _e in enumerate(entities.ENTITIES, 1):
    QUERIES[f"e{_n}_{_e.kind}"] = lambda spark, sf_dir, e=_e: (entities.extract_trademarks if e.kind == "trademark" else lambda d: entities.extract(d, e))(with_planted(spark, sf_dir))
    SQL[f"e{_n}_{_e.kind}"] = entity_sql(_e)
SQL["e15_all_entities"] = " UNION ALL ".join(f"SELECT * FROM ({entity_sql(e)})" for e in entities.ENTITIES)


@query("e15_all_entities")
def e15(spark, sf_dir):
    return entities.extract_all(with_planted(spark, sf_dir))


@query("e18_individuals")
def e18(spark, sf_dir):
    e = entities.extract_all(with_planted(spark, sf_dir))
    rows = e.select("doc_id", "name", "mention", "start", "end", F.when(F.col("kind") == "court", "eyecite").otherwise("regex").alias("source"), F.lit(None).cast("string").alias("url"))
    return entities.dedup_individuals(rows)


# --- reconciliation -----------------------------------------------------------------------------------

SIDE = "doc_id bigint, concept_text string, iri string, confidence double, ord int"
RULER_SQL = """SELECT doc_id, lang AS concept_text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'lex:' || (doc_id % 5) END AS iri, round(0.5 + (doc_id % 5) / 10.0, 2)::DOUBLE AS confidence, 0 AS ord FROM documents
  UNION ALL SELECT doc_id, source, 'lex:s', 0.7, 1 FROM documents"""
LLM_SQL = """SELECT doc_id, upper(lang) AS concept_text, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'lex:' || (doc_id % 10) END AS iri, round(0.4 + (doc_id % 6) / 10.0, 2)::DOUBLE AS confidence, 0 AS ord FROM documents
  UNION ALL SELECT doc_id, 'other', 'lex:o', 0.9, 1 FROM documents WHERE doc_id % 2 = 0"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    row = lambda text, iri, conf, ord: d.select("doc_id", text.alias("concept_text"), iri.alias("iri"), conf.cast("double").alias("confidence"), F.lit(ord).alias("ord"))
    ruler = row(F.col("lang"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("lex:"), i % 5)), F.round(0.5 + (i % 5) / 10, 2), 0).unionByName(row(F.col("source"), F.lit("lex:s"), F.lit(0.7), 1))
    llm = row(F.upper("lang"), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("lex:"), i % 10)), F.round(0.4 + (i % 6) / 10, 2), 0).unionByName(row(F.lit("other"), F.lit("lex:o"), F.lit(0.9), 1).where("doc_id % 2 = 0"))
    return ruler, llm


@query("r1_reconcile", f"""WITH ruler AS ({RULER_SQL}), llm AS ({LLM_SQL}),
    r AS (SELECT doc_id, lower(concept_text) AS text, iri, arg_max(confidence, ord) AS c FROM ruler GROUP BY ALL), m AS (SELECT doc_id, lower(concept_text) AS text, iri, arg_max(confidence, ord) AS c FROM llm GROUP BY ALL),
    b AS (SELECT r.doc_id, r.text, r.iri, greatest(r.c, m.c) AS g FROM r JOIN m USING (doc_id, text, iri)),
    r1 AS (SELECT * FROM r ANTI JOIN b USING (doc_id, text, iri)), m1 AS (SELECT * FROM m ANTI JOIN b USING (doc_id, text, iri)),
    p AS (SELECT m1.doc_id, m1.text, m1.iri, greatest(r1.c, m1.c) AS g FROM r1 JOIN m1 ON r1.doc_id = m1.doc_id AND r1.text = m1.text WHERE r1.iri = ''),
    r2 AS (SELECT r1.* FROM r1 WHERE NOT (iri = '' AND EXISTS (SELECT 1 FROM p WHERE p.doc_id = r1.doc_id AND p.text = r1.text))), m2 AS (SELECT * FROM m1 ANTI JOIN p USING (doc_id, text, iri)),
    q AS (SELECT r2.doc_id, r2.text, r2.iri, greatest(r2.c, m2.c) AS g FROM m2 JOIN r2 ON r2.doc_id = m2.doc_id AND r2.text = m2.text WHERE m2.iri = ''),
    m3 AS (SELECT m2.* FROM m2 WHERE NOT (iri = '' AND EXISTS (SELECT 1 FROM q WHERE q.doc_id = m2.doc_id AND q.text = m2.text))), r3 AS (SELECT * FROM r2 ANTI JOIN q USING (doc_id, text, iri)),
    u AS (SELECT doc_id, text, iri, least(1.0, g + 0.05 * (1 - g)) AS c, 'both_agree' AS category FROM (SELECT * FROM b UNION ALL SELECT * FROM p UNION ALL SELECT * FROM q)
      UNION ALL SELECT doc_id, text, iri, c, 'ruler_only' FROM r3 WHERE c >= 0.60 UNION ALL SELECT doc_id, text, iri, c, 'llm_only' FROM m3)
    SELECT doc_id, text, iri, round(c::DOUBLE, 6) AS confidence, category FROM u""")
def r1(spark, sf_dir):
    out = reconcile.reconcile(*sides(spark, sf_dir))
    return out.select("doc_id", "text", "iri", F.round("confidence", 6).alias("confidence"), "category")


@query("r7_states", f"""WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'both_agree' WHEN 1 THEN 'ruler_only' WHEN 2 THEN 'conflict_resolved' END AS category FROM documents)
    SELECT doc_id, CASE WHEN category IN ('both_agree', 'conflict_resolved') THEN 'confirmed' WHEN category IS NULL THEN 'rejected' ELSE 'preliminary' END AS state FROM x""")
def r7(spark, sf_dir):
    i = F.col("doc_id") % 4
    category = F.when(i == 0, "both_agree").when(i == 1, "ruler_only").when(i == 2, "conflict_resolved")
    return read(spark, sf_dir, "documents").select("doc_id", reconcile.next_state(category, F.lit("preliminary")).alias("state"))


@query("r8_pos_penalty", """WITH x AS (SELECT doc_id, 0.1 + (doc_id % 10) / 20.0 AS c, doc_id % 2 = 0 AS hit FROM documents)
    SELECT doc_id, round((CASE WHEN hit THEN greatest(0.0, c - 0.15) ELSE c END)::DOUBLE, 6) AS confidence, hit AND round((c - 0.15)::DOUBLE, 6) < 0.20 AS rejected FROM x""")
def r8(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", (0.1 + (F.col("doc_id") % 10) / 20.0).alias("c"), F.when(F.col("doc_id") % 2 == 0, "VERB").otherwise("NOUN").alias("pos"))
    c, _ = reconcile.pos_penalty(F.col("c"), F.lit("word"), F.lit("alternative"), F.col("pos"))
    return d.select("doc_id", F.round(c, 6).alias("confidence"), ((F.col("pos") == "VERB") & (F.round(F.col("c") - 0.15, 6) < 0.20)).alias("rejected"))


@query("r9_merge_preliminary", """WITH a AS (SELECT doc_id, 0 AS start, 5 AS "end", lang AS text FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, 0 AS start, 5 AS "end", lang AS text FROM documents WHERE doc_id % 3 = 0)
    SELECT doc_id, start, "end", text FROM a UNION ALL SELECT doc_id, start, "end", text FROM b ANTI JOIN a USING (doc_id, start, "end", text)""")
def r9(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("start"), F.lit(5).alias("end"), F.col("lang").alias("text"))
    return reconcile.merge_preliminary(d.where("doc_id % 2 = 0"), d.where("doc_id % 3 = 0"))


# --- search -------------------------------------------------------------------------------------------

ASKED = [("rule that binds",), ("of the",), ("places",), ("the actor",), ("joining words",), ("withdrawn",), ("being many",), ("act",)]


@query("q1_content_words", """SELECT item_id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 2 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in search.STOP) + """)))) AS INTEGER) AS n_words FROM benchmark""")
def q1(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(search.content_words(F.col("text"))).alias("n_words"))


@query("q4_terms")
def q4(spark, sf_dir):
    q = spark.createDataFrame(ASKED, "query string")
    return q.select("query", F.posexplode(search.search_terms(F.col("query"), {"actor": ["service"]})).alias("k", "term"))


# --- vectors ------------------------------------------------------------------------------------------


@query("v2_top_k", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, v.vec_id, round(list_dot_product(q.e, v.embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings v)
    SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def v2(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return vectors.top_k(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


@query("v4_branch_filter", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, v.vec_id, v.label, round(list_dot_product(q.e, v.embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings v),
    w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS k FROM s)
    SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM w WHERE k <= 25 AND label % 2 = 0) WHERE rank <= 5""")
def v4(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return vectors.top_k_then_filter(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, F.col("label") % 2 == 0)


@query("v7_normalize", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, 1.0::DOUBLE AS after FROM embeddings")
def v7(spark, sf_dir):
    n = vectors.normalize(F.col("embedding"))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"), F.round(F.sqrt(vectors.dot(n, n)), 4).alias("after"))


# --- analytics and lifecycle --------------------------------------------------------------------------

FEEDBACK = """feedback AS (SELECT event_id AS id, 'j' || (user_id % 7) AS job_id, CASE event_id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'dismissed' END AS rating, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS stage,
  'lex:' || (user_id % 50) AS iri, 'label ' || (user_id % 25) AS label, ts AS created_at FROM events)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i, u = read(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    return e.select(
        i.alias("id"), F.concat(F.lit("j"), u % 7).alias("job_id"), F.when(i % 3 == 0, "up").when(i % 3 == 1, "down").otherwise("dismissed").alias("rating"),
        F.when(i % 5 != 0, F.col("event_type")).alias("stage"), F.concat(F.lit("lex:"), u % 50).alias("iri"), F.concat(F.lit("label "), u % 25).alias("label"), F.col("ts").alias("created_at"),
    )


@query("a1_totals", f"WITH {FEEDBACK} SELECT count(*) AS total, count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down, count(*) FILTER (rating = 'dismissed') AS dismissed FROM feedback")
def a1(spark, sf_dir):
    return lifecycle.rating_totals(feedback(spark, sf_dir))


@query("a2_by_stage", f"WITH {FEEDBACK} SELECT coalesce(stage, 'overall') AS stage, count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down, count(*) FILTER (rating = 'dismissed') AS dismissed FROM feedback GROUP BY 1")
def a2(spark, sf_dir):
    return lifecycle.by_stage(feedback(spark, sf_dir))


@query("a3_top_downvoted", f"WITH {FEEDBACK} SELECT label, count(*) AS n, arg_max(iri, (created_at, id)) AS iri, min(id) AS first_id FROM feedback WHERE rating = 'down' GROUP BY label ORDER BY n DESC, first_id LIMIT 10")
def a3(spark, sf_dir):
    return lifecycle.top_rated(feedback(spark, sf_dir), "down")


@query("a4_recent", f"WITH {FEEDBACK} SELECT id, rating, label FROM feedback ORDER BY created_at DESC, id DESC LIMIT 20")
def a4(spark, sf_dir):
    return lifecycle.recent(feedback(spark, sf_dir)).select("id", "rating", "label")


@query("l5_upsert", f"WITH {FEEDBACK} SELECT job_id, label, id, rating FROM (SELECT *, row_number() OVER (PARTITION BY job_id, label ORDER BY created_at DESC, id DESC) AS k FROM feedback) WHERE k = 1")
def l5(spark, sf_dir):
    f = feedback(spark, sf_dir)
    return lifecycle.upsert(f.where("id % 2 = 0"), f.where("id % 2 = 1"), ["job_id", "label"], ["created_at", "id"]).select("job_id", "label", "id", "rating")


ANN = """ac AS (SELECT 'a' || l_orderkey AS ann_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS rank, 'p' || (l_partkey % 20) AS iri, CASE WHEN l_linenumber = 1 THEN 'confirmed' ELSE 'backup' END AS state FROM lineitem)"""


def ann_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    li = read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return li.select(F.concat(F.lit("a"), "l_orderkey").alias("ann_id"), (F.row_number().over(w) - 1).alias("rank"), F.concat(F.lit("p"), F.col("l_partkey") % 20).alias("iri"), F.when(F.col("l_linenumber") == 1, "confirmed").otherwise("backup").alias("state"))


@query("l1_promote", f"WITH {ANN} SELECT ann_id, CAST(CASE WHEN ann_id = 'a1' AND rank = 1 THEN 0 WHEN ann_id = 'a1' AND rank = 0 THEN 1 ELSE rank END AS INTEGER) AS rank, iri, CASE WHEN ann_id = 'a1' AND rank = 1 THEN 'confirmed' WHEN ann_id = 'a1' AND rank = 0 THEN 'backup' ELSE state END AS state FROM ac")
def l1(spark, sf_dir):
    return lifecycle.promote(ann_concepts(spark, sf_dir), "a1", 1)


@query("l2_cascade_promote", f"""WITH {ANN}, h AS (SELECT ann_id, min(CASE WHEN rank > 0 AND iri = 'p7' THEN rank END) AS b FROM ac GROUP BY ann_id HAVING max(CASE WHEN rank = 0 AND iri = 'p3' THEN 1 END) = 1 AND b IS NOT NULL)
    SELECT ac.ann_id, CAST(CASE WHEN rank = b THEN 0 WHEN b IS NOT NULL AND rank = 0 THEN b ELSE rank END AS INTEGER) AS rank, iri, CASE WHEN rank = b THEN 'confirmed' WHEN b IS NOT NULL AND rank = 0 THEN 'backup' ELSE state END AS state FROM ac LEFT JOIN h ON h.ann_id = ac.ann_id""")
def l2(spark, sf_dir):
    return lifecycle.cascade_promote(ann_concepts(spark, sf_dir), "p3", "p7")


@query("l3_bulk_reject", f"WITH {ANN} SELECT iri, count(*) AS n, count(*) FILTER (rank = 0 AND iri = 'p3') AS rejected FROM ac GROUP BY iri")
def l3(spark, sf_dir):
    out = lifecycle.set_state(ann_concepts(spark, sf_dir), (F.col("rank") == 0) & (F.col("iri") == "p3"), "rejected")
    return out.groupBy("iri").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "rejected").alias("rejected"))


@query("a5_export_statistics", f"WITH {ANN} SELECT count(DISTINCT ann_id) AS annotations, count(DISTINCT iri) AS concepts, count(*) FILTER (state = 'backup') AS backups FROM ac")
def a5(spark, sf_dir):
    return ann_concepts(spark, sf_dir).agg(F.countDistinct("ann_id").alias("annotations"), F.countDistinct("iri").alias("concepts"), F.count_if(F.col("state") == "backup").alias("backups"))


@query("a6_top_branches", "SELECT p_brand AS branch, concat(p_brand, ' (x', count(*), ')') AS shown FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 10")
def a6(spark, sf_dir):
    c = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("branch")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "branch").limit(10)
    return c.select("branch", F.concat("branch", F.lit(" (x"), "n", F.lit(")")).alias("shown"))


@query("a14_prices", """WITH m AS (SELECT p_brand || '/' || p_type AS model_id, max(p_retailprice) / 1e6 AS i, min(p_retailprice) / 1e6 AS o FROM part GROUP BY p_brand, p_type), c AS (SELECT model_id, round(i * 800 + o * 200, 10) AS price FROM m)
    SELECT model_id, round(price, 6) AS price FROM c UNION ALL SELECT regexp_replace(model_id, '^[^/]*/', '') AS model_id, round(min(price), 6) FROM c GROUP BY 1""")
def a14(spark, sf_dir):
    p = read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg((F.max("p_retailprice") / 1e6).alias("input_price"), (F.min("p_retailprice") / 1e6).alias("output_price"))
    out = lifecycle.llm_prices(p.select(F.concat("p_brand", F.lit("/"), "p_type").alias("model_id"), "input_price", "output_price"))
    return out.select("model_id", F.round("price", 6).alias("price"))


# --- exports ------------------------------------------------------------------------------------------


def annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hit = match.match_automaton(normal(spark, sf_dir), ["of the", "de la", "in the"])
    a = hit.select("doc_id", F.concat_ws("-", "doc_id", "start").alias("ann_id"), "start", "end", F.col("label_key").alias("text"), F.when(F.col("start") % 10 == 0, "rejected").otherwise("confirmed").alias("state"))
    c = a.select("ann_id", F.lit(0).alias("rank"), F.concat(F.lit("lex:"), F.regexp_replace("text", " ", "_")).alias("iri"), F.col("text").alias("label"), F.lit("Rules").alias("branch"), F.lit(0.9).alias("confidence"), "state")
    return export.live(a), c


for _name in ("json", "jsonld", "csv", "jsonl", "elasticsearch", "rdf", "brat", "xml"):
    QUERIES[f"x_{_name}"] = lambda spark, sf_dir, f=export.EXPORTERS[_name]: f(*annotated(spark, sf_dir))


@query("x_neo4j")
def x8(spark, sf_dir):
    return export.to_property_graph(*annotated(spark, sf_dir))[1]


@query("x_rag")
def x9(spark, sf_dir):
    return export.to_rag(T.chunks(normal(spark, sf_dir)).drop("text"), annotated(spark, sf_dir)[0]).select("doc_id", "chunk_index", "n_items")


@query("x_html")
def x12(spark, sf_dir):
    return export.to_page(normal(spark, sf_dir), *annotated(spark, sf_dir)).select("doc_id", F.length("value").alias("chars"))


# --- triples and streams ------------------------------------------------------------------------------

TOKEN_SCHEMA = "doc_id bigint, sent_idx int, tok_idx int, start int, end int, token string, lemma string, pos string, tag string, dep string, head int"
TOKEN_ROWS = [
    (1, 0, 0, 0, 6, "Courts", "court", "NOUN", "NNS", "nsubj", 1), (1, 0, 1, 7, 12, "apply", "apply", "VERB", "VBP", "ROOT", 1), (1, 0, 2, 13, 18, "rules", "rule", "NOUN", "NNS", "dobj", 1),
    (1, 1, 0, 20, 25, "Rules", "rule", "NOUN", "NNS", "nsubjpass", 2), (1, 1, 1, 26, 29, "are", "be", "AUX", "VBP", "auxpass", 2), (1, 1, 2, 30, 37, "applied", "apply", "VERB", "VBN", "ROOT", 2),
    (1, 1, 3, 38, 40, "by", "by", "ADP", "IN", "agent", 2), (1, 1, 4, 41, 47, "courts", "court", "NOUN", "NNS", "pobj", 3), (2, 0, 0, 0, 5, "Rules", "rule", "NOUN", "NNS", "nsubjpass", 1), (2, 0, 1, 6, 13, "applied", "apply", "VERB", "VBN", "ROOT", 1),
]


@query("t1_svo", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 'Courts', 'apply', 'rules', 'active', CAST(0.8 AS DOUBLE)), (1, 1, 'courts', 'apply', 'Rules', 'passive', 0.75), (2, 0, '[agent]', 'apply', 'Rules', 'passive', 0.5)) AS t(doc_id, sent_idx, subject, predicate, object, voice, confidence)")
def t1(spark, sf_dir):
    return triples.svo(spark.createDataFrame(TOKEN_ROWS, TOKEN_SCHEMA))


@query("p2_majority_pos", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 0, 12, 'NOUN'), (1, 7, 18, 'VERB'), (1, 30, 47, 'VERB')) AS t(doc_id, start, \"end\", majority)")
def p2(spark, sf_dir):
    return triples.majority_pos(spark.createDataFrame([(1, 0, 12), (1, 7, 18), (1, 30, 47)], "doc_id bigint, start int, end int"), spark.createDataFrame(TOKEN_ROWS, TOKEN_SCHEMA))


@query("k1_snapshot_changes", """WITH a AS (SELECT 'j' AS job_id, 'annotation' AS entity, 'x' || doc_id AS entity_id, CASE WHEN quality = 1 THEN 'confirmed' ELSE 'preliminary' END AS state FROM labels WHERE doc_id % 5 <> 0),
    b AS (SELECT 'j' AS job_id, 'annotation' AS entity, 'x' || doc_id AS entity_id, CASE WHEN toxic = 1 THEN 'preliminary' ELSE 'confirmed' END AS state FROM labels WHERE doc_id % 7 <> 0)
    SELECT job_id, entity, entity_id, change FROM (SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.entity, b.entity) AS entity, coalesce(a.entity_id, b.entity_id) AS entity_id,
      CASE WHEN a.state IS NULL THEN 'added' WHEN b.state IS NULL THEN 'removed' WHEN a.state <> b.state THEN 'changed' END AS change FROM a FULL JOIN b ON a.entity_id = b.entity_id) WHERE change IS NOT NULL""")
def k1(spark, sf_dir):
    x = read(spark, sf_dir, "labels").select(F.lit("j").alias("job_id"), F.lit("annotation").alias("entity"), F.concat(F.lit("x"), "doc_id").alias("entity_id"), "doc_id", "quality", "toxic")
    old = x.where("doc_id % 5 <> 0").withColumn("state", F.when(F.col("quality") == 1, "confirmed").otherwise("preliminary")).drop("doc_id", "quality", "toxic")
    new = x.where("doc_id % 7 <> 0").withColumn("state", F.when(F.col("toxic") == 1, "preliminary").otherwise("confirmed")).drop("doc_id", "quality", "toxic")
    return streams.snapshot_changes(old, new)


@query("k3_rate_limit")
def k3(spark, sf_dir):
    return streams.rate_limit(read(spark, sf_dir, "events"), 3, 3600 * 24)


@query("k5_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def k5(spark, sf_dir):
    out = streams.windowed_counts(read(spark, sf_dir, "events"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- model-backed stages with a deterministic stand-in, annotation, metadata --------------------------

@query("u3_identify_concepts")
def u3(spark, sf_dir):
    return models.best_concepts(models.identify_concepts(T.chunks(normal(spark, sf_dir)), "echo"))


@query("u7_branch_detail", onto("concepts") + """, l AS (SELECT branch, '- ' || branch || ': ' || string_agg(label, ', ' ORDER BY k) AS line FROM (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY label, iri) AS k FROM concepts WHERE branch IS NOT NULL) WHERE k <= 8 GROUP BY branch)
    SELECT branch, line FROM (SELECT *, sum(length(line)) OVER (ORDER BY branch) AS total FROM l) WHERE total <= 8000""")
def u7(spark, sf_dir):
    return models.branch_detail(tables(spark)["concepts"])


RERANK = '```json\n{"scores": [{"text": "a", "iri": "x", "score": 0.9}, {"text": "b", "iri": "y", "score": 7}]}\n```'


@query("q14_rerank", "SELECT * FROM (VALUES ('a', 'x', CAST(0.7 AS DOUBLE)), ('b', 'y', 0.8), ('c', 'z', 0.3)) AS t(text, iri, confidence)")
def q14(spark, sf_dir):
    concepts = spark.createDataFrame([("a", "x", 0.5), ("b", "y", 0.6), ("c", "z", 0.3)], "text string, iri string, confidence double")
    return models.rerank(concepts, spark.createDataFrame([(RERANK,)], "answer string"))


CITED = [(-1, "See 410 U.S. 113 and 42 U.S.C. § 1983 in Roe v. Wade today."), (-2, "Acme Widgets Inc. met John Smith in Orange County."), (-3, "1  F. Supp. 2d 7 and 12 F.3d 99")]
CITED_SQL = f"WITH {ontology_data.sql_table('planted', 'doc_id bigint, text string', CITED)}, d AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM planted)"
NO_NAMES = ", ".join(f"'{w}'" for w in annotate.NO_NAMES)


def with_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(CITED, "doc_id bigint, text string"))


CITATIONS = f"""{CITED_SQL}, {spans_sql(f"({annotate.CITATION})", "d")}, c AS (SELECT doc_id, start, "end", w AS mention, regexp_replace(w, '\\s+', ' ', 'g') AS normalized,
    CASE WHEN contains(w, 'U.S.C.') THEN 'Statute' WHEN contains(w, ' v. ') THEN 'Case Name' ELSE 'Caselaw' END AS label FROM r)"""


@query("e16_citations", f"{CITATIONS} SELECT * FROM c")
def e16(spark, sf_dir):
    return annotate.citations(with_cited(spark, sf_dir))


REPORTED = f"regexp_extract(normalized, '^(\\d+) ({annotate.REPORTER}) ?(?:§ ?)?(\\d+[a-z]?)$', ['v', 'r', 'p'])"


@query("e17_citation_urls", f"""{CITATIONS}, u AS (SELECT *, {REPORTED} AS x FROM c), a AS (SELECT *, CASE WHEN x.r = 'U.S.C.' THEN 'https://www.law.cornell.edu/uscode/text/' || x.v || '/' || x.p WHEN x.r <> '' THEN 'https://www.courtlistener.com/c/' || replace(x.r, ' ', '%20') || '/' || x.v || '/' || x.p || '/' END AS url FROM u)
    SELECT doc_id, start, "end", mention, CASE WHEN normalized <> mention AND (url IS NOT NULL OR label <> 'Caselaw') THEN normalized END AS normalized, url, CASE WHEN label = 'Caselaw' THEN label ELSE 'Legal Citation' END AS label, CASE WHEN label = 'Caselaw' THEN 0.92 ELSE 0.90 END::DOUBLE AS confidence, CASE WHEN label = 'Caselaw' THEN 'eyecite' ELSE 'citeurl' END AS source FROM a""")
def e17(spark, sf_dir):
    found = annotate.citations(with_cited(spark, sf_dir))
    text = F.lit(None).cast("string")
    known = found.where("label = 'Caselaw'").select("doc_id", "start", "end", "mention", text.alias("normalized"), text.alias("url"), "label", F.lit(0.92).alias("confidence"), F.lit("eyecite").alias("source"))
    return annotate.add_citations(known, found)


@query("e12_names", f"""{CITED_SQL}, {spans_sql(f"({annotate.NAME})", "d")}, l AS (SELECT doc_id, start, "end", w AS mention, CASE WHEN regexp_matches(w, '{annotate.ORGANISATION}') THEN 'Organization' WHEN regexp_matches(w, '{annotate.PLACE}') THEN 'Location' ELSE 'Person' END AS label
    FROM r WHERE lower(w) NOT IN ({NO_NAMES})) SELECT *, CASE WHEN label = 'Person' THEN 0.80 ELSE 0.78 END::DOUBLE AS confidence FROM l""")
def e12(spark, sf_dir):
    return annotate.names(with_cited(spark, sf_dir))


@query("m10_attach")
def m10(spark, sf_dir):
    a, c = annotated(spark, sf_dir)
    every = match.match_automaton(normal(spark, sf_dir), ["of the", "in the"]).select("doc_id", "start", "end", F.col("label_key").alias("text"), F.concat(F.lit("lex:"), F.regexp_replace("label_key", " ", "_")).alias("iri"), F.lit(0.9).alias("confidence"))
    return annotate.attach(every, a.join(c.select("ann_id", "iri"), "ann_id"))


@query("a9_metadata_context")
def a9(spark, sf_dir):
    e = entities.extract_all(with_planted(spark, sf_dir))
    return annotate.split_by_confidence(e.select("doc_id", "kind", "name", "start", F.when(F.col("start") % 2 == 0, 0.9).otherwise(0.7).alias("confidence")))


@query("a10_promotions")
def a10(spark, sf_dir):
    d = with_planted(spark, sf_dir).unionByName(spark.createDataFrame([(-9, "Filed on 2024-01-02 in court on 2024-03-04")], "doc_id bigint, text string"))
    return annotate.promotions(d, entities.extract(d, entities.ENTITIES[1]))


from lexweave import catalog_given, catalog_models, catalog_progress, catalog_stages  # noqa: E402, F401  register their queries
