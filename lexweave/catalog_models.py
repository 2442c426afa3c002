"""Queries of the stages that ask a model, over the stand-in provider; SQL twins answer as it does."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave import catalog as C
from lexweave import catalog_stages as S
from lexweave.functions import text as T
from lexweave.operators import lifecycle, match, model_stages, ontology

query, read, onto, tables, labels = C.query, C.read, C.onto, C.tables, C.labels
UPPER = r"^\p{Lu}"
WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"


def first_word(text: str) -> str:
    return f"coalesce(({WORDS.format(text)})[1], '')"


@query("u4_document_types", f"SELECT doc_id, {first_word('left(text, 500)')} AS document_type, 1.0::DOUBLE AS confidence FROM documents WHERE {first_word('left(text, 500)')} <> ''")
def u4a(spark, sf_dir):
    return model_stages.document_types(read(spark, sf_dir, "documents"), "stand_in")


@query("u4_classify", f"SELECT doc_id, {first_word('left(text, 500)')} AS document_type, 0.8::DOUBLE AS confidence, 'first word' AS reasoning FROM documents")
def u4b(spark, sf_dir):
    return model_stages.classify(read(spark, sf_dir, "documents"), "stand_in")


@query("u4_classify_failing", "SELECT doc_id, 'Unknown' AS document_type, 0.0::DOUBLE AS confidence, 'error' AS reasoning FROM documents")
def u4c(spark, sf_dir):
    return model_stages.classify(read(spark, sf_dir, "documents"), "failing")


@query("u4_areas_of_law", f"SELECT doc_id, {first_word('text')} AS area, 0.9::DOUBLE AS confidence, 1 AS rank FROM documents WHERE text IS NOT NULL")
def u4d(spark, sf_dir):
    found = model_stages.areas_of_law(read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("text").alias("summary")), "stand_in")
    return lifecycle.areas(found)


@query("u4_metadata", f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, w[1] AS title, list_filter(w, lambda x: regexp_matches(x, '{UPPER}')) AS c FROM w),
    o AS (SELECT doc_id, title, list_transform(list_filter(range(1, len(c) + 1), lambda i: list_position(c, c[i]) = i)[1:2], lambda i: c[i]) AS p FROM c)
    SELECT doc_id, 'document_title' AS field, title AS value FROM o WHERE title <> '' UNION ALL SELECT doc_id, 'parties', array_to_string(p, '|') FROM o WHERE len(p) > 0""")
def u4e(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.lit("letter").alias("document_type"), F.col("text").alias("context"))
    return model_stages.metadata(d, "stand_in").select("doc_id", "field", F.array_join("values", "|").alias("value"))


HIT = f"""{C.LABEL_ROWS}, {C.TOKENS}, {S.WINNER}, cx AS (SELECT h.doc_id, h.start AS ord, h.start, h."end", c.label, coalesce(c.branch, '') AS branch FROM hits h JOIN win w ON w.label_key = h.label_key JOIN concepts c ON c.iri = w.iri)"""


def hits(spark, sf_dir):
    rows, c = labels(spark), tables(spark)["concepts"]
    hit = match.match(read(spark, sf_dir, "documents"), rows).join(ontology.label_winner(rows), "label_key").join(c.select("iri", "label", "branch"), "iri")
    return hit.select("doc_id", F.col("start").alias("ord"), "start", "end", "label", F.coalesce("branch", F.lit("")).alias("branch"))


FOUND = """n AS (SELECT doc_id, count(*) AS n FROM cx GROUP BY doc_id), fb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o, branch) AS k FROM (SELECT doc_id, branch, count(*) AS n, min(ord) AS o FROM cx WHERE branch <> '' GROUP BY doc_id, branch)),
    fl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o, label) AS k FROM (SELECT doc_id, label, count(*) AS n, min(ord) AS o FROM cx WHERE label <> '' GROUP BY doc_id, label)),
    found AS (SELECT d.doc_id, d.lang AS document_type, coalesce(n.n, 0) AS n_annotations, 0::BIGINT AS n_properties, coalesce(b.s, 'none') AS branches, coalesce(l.s, 'none') AS labels FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
      LEFT JOIN (SELECT doc_id, string_agg(branch || ' (x' || n || ')', ', ' ORDER BY k) AS s FROM fb WHERE k <= 10 GROUP BY doc_id) b ON b.doc_id = d.doc_id
      LEFT JOIN (SELECT doc_id, string_agg(label || ' (x' || n || ')', ', ' ORDER BY k) AS s FROM fl WHERE k <= 15 GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""


@query("u4_findings", onto("concepts", "labels_in") + f", {HIT}, {FOUND} SELECT * FROM found")
def u4f(spark, sf_dir):
    h = hits(spark, sf_dir)
    return model_stages.findings(read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("document_type")), h, h.where("false"), h)


@query("u4_quality_signals", onto("concepts", "labels_in") + f", {HIT}, {FOUND} SELECT doc_id, 'few annotations' AS signal, 'info' AS severity, '1' AS details FROM found WHERE n_annotations = 1 AND document_type <> ''")
def u4g(spark, sf_dir):
    return model_stages.quality_signals(u4f(spark, sf_dir), "stand_in")


#: Concepts of each document: (ord, text, branch, part of speech, confidence)
JUDGED = [(0, "the", None, "NOUN", 0.9), (1, "nowhere at all", "", "VERB", 0.5), (2, "of", "Acts", "NOUN", 0.4), (3, "e", None, "VERB", 1.0)]
JUDGED_SCHEMA = "ord int, text string, branch string, pos string, confidence double"


@query("q13_branches", f"""WITH {C.ontology_data.sql_table("given", JUDGED_SCHEMA, JUDGED)}, x AS (SELECT d.doc_id, g.*, d.text AS t, instr(lower(d.text), lower(g.text)) AS pos_ FROM documents d, given g WHERE d.text IS NOT NULL),
    s AS (SELECT *, CASE WHEN pos_ = 0 THEN text ELSE regexp_extract(left(t, pos_ - 1), '[^.]*$') || substr(t, pos_, length(text)) || regexp_extract(substr(t, pos_ + length(text)), '^[^.]*\\.?') END AS sentence FROM x WHERE coalesce(branch, '') = ''),
    j AS (SELECT *, len({WORDS.format('sentence')}) % 2 = 0 AS judged FROM s)
    SELECT doc_id, ord, text, CASE WHEN judged THEN 'Filing process' ELSE '' END AS branch, pos, round(least(1.0, confidence * 0.7 + 0.15) + CASE WHEN judged AND pos = 'VERB' THEN 0.05 WHEN judged AND pos = 'NOUN' THEN -0.05 ELSE 0 END, 6)::DOUBLE AS confidence,
      CASE WHEN judged THEN 'confirmed' ELSE 'rejected' END AS state FROM j UNION ALL SELECT doc_id, ord, text, branch, pos, confidence, 'preliminary' FROM x WHERE coalesce(branch, '') <> ''""")
def q13(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    given = d.select("doc_id").join(F.broadcast(spark.createDataFrame(JUDGED, JUDGED_SCHEMA))).withColumn("state", F.lit("preliminary"))  # four concepts
    return model_stages.judge_branches(given, d, "Filing process,Places", "stand_in").withColumn("confidence", F.round("confidence", 6))


CHUNKED = f"""{S.PACKED}, ck AS (SELECT ch.doc_id, CAST(row_number() OVER (PARTITION BY ch.doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, a AS lo, substr(dd.text, a + 1, b - a) AS t FROM ch JOIN dd ON dd.doc_id = ch.doc_id)"""


def chunked(spark, sf_dir):
    """Chunks with their own part of the normal text, so that places in a chunk are places in the document."""
    n = C.normal(spark, sf_dir)
    cut = T.chunks(n).drop("text").join(n, "doc_id")
    return cut.withColumn("text", F.substring(F.col("text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")))


@query("e20_individuals", S.recursive(f"""WITH {CHUNKED}, w AS (SELECT *, unnest(list_distinct(list_filter({WORDS.format('t')}, lambda w: regexp_matches(w, '{UPPER}')))) AS w FROM ck)
    SELECT doc_id, chunk_index, w AS name, w AS mention, CAST(lo + instr(t, w) - 1 AS INTEGER) AS start, CAST(lo + instr(t, w) - 1 + length(w) AS INTEGER) AS "end", 'named_entity' AS individual_type, 'actor' AS label, 1.0::DOUBLE AS confidence FROM w"""))
def e20(spark, sf_dir):
    a = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("start"), F.lit(9).alias("end"), F.lit("start").alias("text"))
    existing = a.select("doc_id", "start", "end", F.lit("Name").alias("name"), F.lit("Name").alias("mention"))
    return model_stages.individuals(chunked(spark, sf_dir), a, existing, "stand_in")[0]


@query("u5_properties", S.recursive(f"""WITH {CHUNKED}, {C.ontology_data.sql_table("lk", "label_key string, iri string", [("is", "lex:p9"), ("is", "lex:p1")])}, w AS (SELECT *, unnest(list_distinct(list_filter({WORDS.format('t')}, lambda w: w IN ('is', 'with')))) AS w FROM ck)
    SELECT doc_id, chunk_index, w AS text, w AS label, CASE WHEN w = 'is' THEN 'lex:p1' END AS iri, CAST(lo + instr(t, w) - 1 AS INTEGER) AS start, CAST(lo + instr(t, w) - 1 + length(w) AS INTEGER) AS "end", 0.6::DOUBLE AS confidence FROM w"""))
def u5(spark, sf_dir):
    known = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("start"), F.lit(9).alias("end"), F.lit("start").alias("text"))
    return model_stages.properties(chunked(spark, sf_dir), known, spark.createDataFrame([("is", "lex:p9"), ("is", "lex:p1")], "label_key string, iri string"), "stand_in")
