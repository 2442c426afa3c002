"""Queries of annotation by document, the progressive pipeline, vector index, job state, versioned annotations, graphs and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import catalog as C
from lexweave import catalog_stages as S
from lexweave.operators import document_patterns, match, ontology, ruler, vector_index
from lexweave.sources import annotation_table
from lexweave.sources.shared import fresh_dir, kept
from lexweave.streaming import job_state, progressive

query, read, onto, tables, labels = C.query, C.read, C.onto, C.tables, C.labels


# --- annotation by document ---------------------------------------------------------------------------

UNSAFE = ", ".join(f"'{w}'" for w in document_patterns.COMMON_LABELS)


def annotate_sql(resolved: str, alternatives: str, existing: str) -> str:
    """an: annotations of documents whose concepts (``resolved``) have texts of one or two words. Needs ``tl``, the tokens with the next one."""
    hits = S.resolve_sql("_a")
    same = f"""{S.islands_sql("spx", "doc_id, iri", 'start - "end", -confidence, start, "end", ann_id, text', "ann_id, text, confidence, state", "_b")}, {S.greedy_sql("doc_id, iri", "_b")}"""
    return f"""po AS (SELECT doc_id, lower(concept_text) AS label_key, coalesce(iri, '') AS iri, concept_text, confidence, ord, -1 AS seq FROM {resolved}),
    pa AS (SELECT o.doc_id, lower(a.label) AS label_key, o.iri, o.concept_text, o.confidence, o.ord, a.seq FROM po o JOIN {alternatives} a ON a.iri = o.iri WHERE length(a.label) > 3 AND (contains(a.label, ' ') OR lower(a.label) NOT IN ({UNSAFE}))),
    pf AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label_key, iri ORDER BY ord, seq, concept_text) AS f FROM (SELECT * FROM po UNION ALL SELECT * FROM pa) WHERE label_key <> ''),
    pk AS (SELECT doc_id, label_key, iri, arg_max(concept_text, (confidence, -ord, -seq, concept_text)) AS concept_text, max(confidence) AS confidence FROM pf WHERE seq = -1 OR f = 1 GROUP BY ALL),
    hits_a AS (SELECT t.doc_id, CAST(t.start AS INTEGER) AS start, CAST(t.start + length(k.label_key) AS INTEGER) AS "end", k.label_key FROM tl t
      JOIN (SELECT DISTINCT doc_id, label_key, split_part(label_key, ' ', 1) AS a, split_part(label_key, ' ', 2) AS b FROM pk) k ON k.doc_id = t.doc_id AND k.a = t.token AND (k.b = '' OR (t.gap = ' ' AND t.nxt = k.b))), {hits},
    every AS (SELECT r.doc_id, r.start, r."end", p.concept_text AS text, p.iri, p.confidence FROM resolved_a r JOIN pk p ON p.doc_id = r.doc_id AND p.label_key = r.label_key
      QUALIFY row_number() OVER (PARTITION BY r.doc_id, r.start, r."end", p.iri) = 1),
    ex AS (SELECT doc_id, ann_id, start, "end", lower(text) AS lt, text, coalesce(iri, '') AS iri, confidence, state FROM {existing}),
    e1 AS (SELECT doc_id, start, "end", iri, max(ann_id) AS a FROM ex GROUP BY ALL), e2 AS (SELECT doc_id, start, "end", lt, min(ann_id) AS b FROM ex GROUP BY ALL),
    rowsx AS (SELECT v.doc_id, coalesce(e1.a, e2.b, substr(sha256(concat_ws('|', v.doc_id, v.start, v."end", v.iri)), 1, 16)) AS ann_id, v.start, v."end", v.text, v.iri, v.confidence, 'confirmed' AS state FROM every v
        LEFT JOIN e1 ON e1.doc_id = v.doc_id AND e1.start = v.start AND e1."end" = v."end" AND e1.iri = v.iri LEFT JOIN e2 ON e2.doc_id = v.doc_id AND e2.start = v.start AND e2."end" = v."end" AND e2.lt = lower(v.text)
      UNION ALL SELECT x.doc_id, ann_id, x.start, x."end", text, iri, confidence, state FROM ex x WHERE state = 'rejected' AND NOT EXISTS (SELECT 1 FROM every v WHERE v.doc_id = x.doc_id AND v.start = x.start AND v."end" = x."end")),
    spx AS (SELECT * FROM rowsx WHERE iri <> '' AND state <> 'rejected'), {same},
    an AS (SELECT doc_id, ann_id, start, "end", text, iri, confidence, state FROM rowsx WHERE iri = '' OR state = 'rejected'
      UNION ALL SELECT i.doc_id, i.ann_id, i.start, i."end", i.text, i.iri, i.confidence, i.state FROM isl_b i JOIN kept_b q ON q.doc_id = i.doc_id AND q.iri = i.iri AND q.island = i.island AND q.k = i.k)"""


#: A model's stand-in: the long words of a text, and those that begin a sentence or a line.
LONG = 10
PICKED_SQL = f"""tw AS (SELECT *, lag(gap) OVER (PARTITION BY doc_id ORDER BY i) AS ahead FROM tl),
    picked AS (SELECT doc_id, token, min(i) - 1 AS ord FROM tw WHERE length(token) >= {LONG} OR ahead IS NULL OR regexp_matches(ahead, '[.!?\\n]') GROUP BY doc_id, token)"""


def picked(docs: DataFrame) -> DataFrame:
    t = match.tokens(docs, columns=("i", "token", "ahead"))
    return t.where((F.length("token") >= LONG) | (F.col("i") == 1) | F.col("ahead").rlike(r"[.!?\n]")).groupBy("doc_id", "token").agg(F.min("i").cast("int").alias("ord"))


def _sure(c):
    return F.round(F.least(F.lit(0.95), 0.4 + F.length(c) / 20), 2)


OTHER_LABELS = "oth AS (SELECT 'w:' || left(label_key, 1) AS iri, label_key AS label, CAST(row_number() OVER (PARTITION BY left(label_key, 1) ORDER BY label_key) AS INTEGER) AS seq FROM (SELECT DISTINCT label_key FROM rows))"


@query("m10_string_match", S.recursive(onto("concepts", "labels_in") + f""", {C.LABEL_ROWS}, {C.TOKENS}, {PICKED_SQL}, {OTHER_LABELS},
    res AS (SELECT doc_id, token AS concept_text, 'w:' || left(token, 1) AS iri, CAST(round(least(0.95, 0.4 + length(token) / 20), 2) AS DOUBLE) AS confidence, ord FROM picked
      UNION ALL SELECT doc_id, token || ' ' || nxt, 'b:' || left(nxt, 1), 0.8, min(i) - 1 FROM tw WHERE gap = ' ' AND nxt IS NOT NULL AND length(token) >= {LONG} GROUP BY doc_id, token, nxt),
    exi AS (SELECT doc_id, 'e' || start AS ann_id, CAST(start AS INTEGER) AS start, CAST(start + length(token) AS INTEGER) AS "end", token AS text, CASE WHEN length(token) % 3 = 0 THEN 'w:' || left(token, 1) END AS iri, 0.5::DOUBLE AS confidence,
      CASE WHEN length(token) % 3 = 1 THEN 'rejected' ELSE 'preliminary' END AS state FROM tl WHERE length(token) >= {LONG - 1}),
    {annotate_sql("res", "oth", "exi")} SELECT doc_id, ann_id, start, "end", text, iri, confidence, state FROM an"""))
def m10(spark, sf_dir):
    """Thousands of patterns, made of each document's own words; annotations of some of them are there already."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    t = match.tokens(docs, columns=("i", "start", "token", "gap", "nxt"))
    first = F.concat(F.lit("w:"), F.substring("token", 1, 1))
    words = picked(docs).select("doc_id", F.col("token").alias("concept_text"), first.alias("iri"), _sure("token").alias("confidence"), "ord")
    pairs = t.where((F.col("gap") == " ") & F.col("nxt").isNotNull() & (F.length("token") >= LONG)).groupBy("doc_id", "token", "nxt").agg(F.min("i").cast("int").alias("ord"))
    pairs = pairs.select("doc_id", F.concat_ws(" ", "token", "nxt").alias("concept_text"), F.concat(F.lit("b:"), F.substring("nxt", 1, 1)).alias("iri"), F.lit(0.8).alias("confidence"), "ord")
    n = F.length("token")
    there = t.where(n >= LONG - 1).select(
        "doc_id", F.concat(F.lit("e"), "start").alias("ann_id"), "start", (F.col("start") + n).cast("int").alias("end"), F.col("token").alias("text"), F.when(n % 3 == 0, first).alias("iri"),
        F.lit(0.5).alias("confidence"), F.when(n % 3 == 1, "rejected").otherwise("preliminary").alias("state"),
    )
    there, _ = kept(there, fresh_dir(spark, "there"))
    return document_patterns.annotate(docs, words.unionByName(pairs), other_labels(spark), there)


def other_labels(spark: SparkSession) -> DataFrame:
    initial = F.substring("label_key", 1, 1)
    seq = F.row_number().over(match.Window.partitionBy(initial).orderBy("label_key"))
    return labels(spark).select("label_key").distinct().select(F.concat(F.lit("w:"), initial).alias("iri"), F.col("label_key").alias("label"), seq.alias("seq"))


@query("m9_concept_spans", f"""WITH {C.TOKENS.split("hits AS")[0].rstrip().rstrip(",")}, {PICKED_SQL}
    SELECT t.doc_id, CAST(t.start AS INTEGER) AS start, CAST(t.start + length(t.token) AS INTEGER) AS "end", t.token AS text, '' AS iri, CAST(round(least(0.95, 0.4 + length(t.token) / 20), 2) AS DOUBLE) AS confidence FROM tl t JOIN picked p ON p.doc_id = t.doc_id AND p.token = t.token""")
def m9(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return document_patterns.concept_spans(docs, picked(docs).select("doc_id", F.upper("token").alias("concept_text"), _sure("token").alias("confidence")))


# --- the progressive pipeline -------------------------------------------------------------------------

LABEL_OF = "oth AS (SELECT iri, label, CAST(row_number() OVER (PARTITION BY iri ORDER BY label) AS INTEGER) AS seq FROM labels_in WHERE label_type <> 'translation')"
K2_SQL = S.recursive(onto("concepts", "labels_in") + f""", {S.SCAN}, {PICKED_SQL}, {LABEL_OF},
    ident AS (SELECT p.doc_id, p.token AS concept_text, coalesce(w.iri, '') AS iri, CAST(round(least(0.95, 0.4 + length(token) / 20), 2) AS DOUBLE) AS confidence, ord FROM picked p LEFT JOIN win w ON w.label_key = p.token),
    rul AS (SELECT s.doc_id, s.start, s."end", s.label_key AS text, p.iri, CAST({C.CONF.replace('label_key', 's.label_key')} AS DOUBLE) AS confidence FROM scanned s JOIN pat p ON p.label_key = s.label_key),
    mod AS (SELECT t.doc_id, CAST(t.start AS INTEGER) AS start, CAST(t.start + length(t.token) AS INTEGER) AS "end", i.concept_text AS text, i.iri, i.confidence FROM tl t JOIN ident i ON i.doc_id = t.doc_id AND i.concept_text = t.token),
    pre AS (SELECT *, substr(sha256(concat_ws('|', doc_id, start, "end", iri)), 1, 16) AS ann_id FROM (SELECT * FROM rul UNION ALL SELECT * FROM mod ANTI JOIN rul USING (doc_id, start, "end", text))),
    r AS (SELECT doc_id, text, iri, max(confidence) AS c FROM rul GROUP BY ALL), m AS (SELECT doc_id, concept_text AS text, iri, confidence AS c FROM ident),
    u AS (SELECT doc_id, text, iri, least(1.0, greatest(r.c, m.c) + 0.05 * (1 - greatest(r.c, m.c))) AS confidence, 'both_agree' AS category FROM r JOIN m USING (doc_id, text, iri)
      UNION ALL SELECT doc_id, text, iri, c, 'ruler_only' FROM r ANTI JOIN m USING (doc_id, text, iri) WHERE c >= 0.60 UNION ALL SELECT doc_id, text, iri, c, 'llm_only' FROM m ANTI JOIN r USING (doc_id, text, iri)),
    sta AS (SELECT p.doc_id, p.ann_id, p.start, p."end", p.text, p.iri, p.confidence, CASE WHEN u.category = 'both_agree' THEN 'confirmed' WHEN u.category IS NULL THEN 'rejected' ELSE 'preliminary' END AS state
      FROM pre p LEFT JOIN u ON u.doc_id = p.doc_id AND u.text = p.text AND u.iri = p.iri),
    res AS (SELECT doc_id, text AS concept_text, iri, confidence, 0 AS ord FROM u WHERE iri <> ''), {annotate_sql("res", "oth", "sta")}
    SELECT 'preliminary' AS stage, doc_id, ann_id, start, "end", text, iri, round(confidence::DOUBLE, 6) AS confidence, 'preliminary' AS state FROM pre
    UNION ALL SELECT 'states', doc_id, ann_id, start, "end", text, iri, round(confidence::DOUBLE, 6), state FROM sta
    UNION ALL SELECT 'annotations', doc_id, ann_id, start, "end", text, iri, round(confidence::DOUBLE, 6), state FROM an""")
SHOWN = ["doc_id", "ann_id", "start", "`end`", "text", "iri", "round(confidence, 6) AS confidence", "state"]


def stages(spark: SparkSession) -> list[progressive.Stage]:
    winners = ontology.label_winner(labels(spark))
    others = tables(spark)["labels_in"].where("label_type <> 'translation'")
    others = others.withColumn("seq", F.row_number().over(match.Window.partitionBy("iri").orderBy("label"))).select("iri", "label", "seq")

    def identify(docs: DataFrame) -> DataFrame:
        p = picked(docs).join(winners.select(F.col("label_key").alias("token"), "iri"), "token", "left")
        return p.select("doc_id", F.col("token").alias("concept_text"), F.coalesce("iri", F.lit("")).alias("iri"), _sure("token").alias("confidence"), "ord")

    return progressive.enrichment_stages(ruler.patterns(winners), others, identify)


@query("k2_progressive", K2_SQL)
def k2(spark, sf_dir):
    """A stream over the documents' files, file by file; the rows of the stages that a reader sees."""
    base = fresh_dir(spark, "progressive")
    docs = spark.readStream.schema(read(spark, sf_dir, "documents").schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.parque[t]").select("doc_id", "text")
    progressive.start(docs, base, f"{base}/checkpoint", stages(spark)).awaitTermination()
    shown = [progressive.table(spark, base, s).selectExpr(f"'{s}' AS stage", *SHOWN) for s in ("preliminary", "states", "annotations")]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


# --- vector index -------------------------------------------------------------------------------------


def indexed(spark: SparkSession, sf_dir: str) -> tuple[vector_index.VectorIndex, DataFrame]:
    """An index of all vectors, and the queries: every vector whose id is divisible by 100."""
    path, v = fresh_dir(spark, "index"), read(spark, sf_dir, "embeddings")
    vector_index.build(v, path)
    return vector_index.VectorIndex(spark, path), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("v2_index_exact", C.SQL["v2_top_k"])
def v2_index(spark, sf_dir):
    index, asked = indexed(spark, sf_dir)
    return index.search(asked, 5, exact=True)


FILTERED = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, v.vec_id, round(list_dot_product(q.e, v.embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings v WHERE v.label = 3)
    SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


@query("v4_index_filtered", FILTERED)
def v4_index(spark, sf_dir):
    """A filter that few of the best pass: it works inside the probe, and twenty rows come for every query."""
    index, asked = indexed(spark, sf_dir)
    return index.search(asked, 20, where=F.col("label") == 3, exact=True)


@query("v4_filtered", FILTERED)
def v4_filtered(spark, sf_dir):
    from lexweave.operators import vectors

    v = read(spark, sf_dir, "embeddings")
    return vectors.top_k_in_branch(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 20, F.col("label") == 3)


@query("v2_index_recall", "SELECT count(*) AS n_queries, 5 * count(*) AS wanted, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def v2_recall(spark, sf_dir):
    """Rows of the exact answer that the first pass finds: at least 95 in a hundred."""
    index, asked = indexed(spark, sf_dir)
    exact, near = index.search(asked, 5, exact=True), index.search(asked, 5)
    met = exact.join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return met.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("wanted"), (F.count("hit") >= 0.95 * F.count("*")).alias("enough"))


# --- versioned annotations ----------------------------------------------------------------------------

GIVEN_SQL = """ini AS (SELECT DISTINCT 'a' || user_id AS ann_id, ['lex:p' || (user_id % 5), 'lex:q' || (user_id % 7), 'lex:r' || (user_id % 3)] AS c, CASE WHEN user_id % 4 = 0 THEN 'preliminary' ELSE 'confirmed' END AS state FROM events),
    act AS (SELECT CASE WHEN user_id % 11 = 0 THEN 'zz' ELSE 'a' END || user_id AS ann_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'restore' ELSE 'promote' END AS action, CAST(floor(value) AS INTEGER) % 5 AS k FROM events)"""


def given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An annotation for each user, and a change for each event; some are of annotations that are not there, some of ranks that are not."""
    e, u = read(spark, sf_dir, "events"), F.col("user_id")
    first = e.select(F.concat(F.lit("a"), u).alias("ann_id"), F.array(*[F.concat(F.lit(f"lex:{c}"), u % m) for c, m in (("p", 5), ("q", 7), ("r", 3))]).alias("concepts"), F.when(u % 4 == 0, "preliminary").otherwise("confirmed").alias("state"), F.lit(None).cast("long").alias("dismissed_seq")).distinct()
    action = F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "purchase", "restore").otherwise("promote")
    return first, e.select(F.col("event_id").alias("seq"), F.concat(F.when(u % 11 == 0, "zz").otherwise("a"), u).alias("ann_id"), action.alias("action"), (F.floor("value").cast("int") % 5).alias("k"))


REPLAY_SQL = S.recursive(f"""WITH {GIVEN_SQL}, num AS (SELECT *, row_number() OVER (PARTITION BY ann_id ORDER BY seq) AS n FROM act),
    fold AS (SELECT ann_id, c, state, CAST(NULL AS BIGINT) AS dismissed, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS action, '' AS outcome FROM ini
      UNION ALL SELECT f.ann_id, CASE WHEN a.action = 'promote' AND a.k BETWEEN 1 AND 2 THEN [CASE WHEN i = 1 THEN f.c[a.k + 1] WHEN i = a.k + 1 THEN f.c[1] ELSE f.c[i] END for i in [1, 2, 3]] ELSE f.c END,
        CASE WHEN a.action = 'reject' THEN 'rejected' WHEN a.action = 'restore' AND f.state = 'rejected' THEN 'confirmed' ELSE f.state END,
        CASE WHEN a.action = 'reject' AND f.state <> 'rejected' THEN a.seq WHEN a.action = 'restore' AND f.state = 'rejected' THEN NULL ELSE f.dismissed END, a.n, a.seq, a.action,
        CASE a.action WHEN 'promote' THEN CASE WHEN a.k > 2 THEN 'bad_index' WHEN a.k = 0 THEN 'already_primary' ELSE 'promoted' END
          WHEN 'reject' THEN CASE WHEN f.state = 'rejected' THEN 'already_rejected' ELSE 'rejected' END ELSE CASE WHEN f.state = 'rejected' THEN 'restored' ELSE 'not_rejected' END END
      FROM fold f JOIN num a ON a.ann_id = f.ann_id AND a.n = f.n + 1)""")


@query("l1_replay", REPLAY_SQL + """ SELECT ann_id, array_to_string(arg_max(c, n), ' ') AS concepts, arg_max(state, n) AS state, coalesce(arg_max(coalesce(dismissed, -1), n), -1) AS dismissed_seq FROM fold GROUP BY ann_id""")
def l1_replay(spark, sf_dir):
    """All changes of all events in two commits; the rows after them."""
    base, (first, changes) = fresh_dir(spark, "annotations"), given(spark, sf_dir)
    annotation_table.create(spark, base, first)
    half = changes.agg(F.expr("max(seq) div 2")).first()[0]
    for part in (F.col("seq") <= half, F.col("seq") > half):
        annotation_table.change(spark, base, lambda rows, part=part: changes.where(part))
    return annotation_table.read(spark, base).select("ann_id", F.array_join("concepts", " ").alias("concepts"), "state", F.coalesce("dismissed_seq", F.lit(-1)).alias("dismissed_seq"))


@query("l3_outcomes", REPLAY_SQL + " SELECT seq, ann_id, action, outcome FROM fold WHERE n > 0 UNION ALL SELECT seq, ann_id, action, 'not_found' FROM act ANTI JOIN ini USING (ann_id)")
def l3_outcomes(spark, sf_dir):
    base, (first, changes) = fresh_dir(spark, "annotations"), given(spark, sf_dir)
    annotation_table.create(spark, base, first)
    annotation_table.change(spark, base, lambda rows: changes)
    return annotation_table.outcomes(spark, base).select("seq", "ann_id", "action", "outcome")


@query("l2_cascade_then_bulk", f"""WITH {GIVEN_SQL}, pro AS (SELECT ann_id, CASE WHEN c[1] = 'lex:p3' AND list_contains(c[2:], 'lex:q2') THEN [c[2], c[1], c[3]] ELSE c END AS c, state FROM ini)
    SELECT ann_id, array_to_string(c, ' ') AS concepts, CASE WHEN c[1] = 'lex:q2' THEN 'rejected' ELSE state END AS state FROM pro""")
def l2_cascade(spark, sf_dir):
    base, (first, _) = fresh_dir(spark, "annotations"), given(spark, sf_dir)
    annotation_table.create(spark, base, first)
    annotation_table.change(spark, base, annotation_table.promote_everywhere("lex:p3", "lex:q2", 1))
    annotation_table.change(spark, base, annotation_table.reject_everywhere("lex:q2", 2))
    return annotation_table.read(spark, base).select("ann_id", F.array_join("concepts", " ").alias("concepts"), "state")


# --- job state on a stream ----------------------------------------------------------------------------


@query("k4_retention_stream", C.SQL["s13_job_sweep"])
def k4(spark, sf_dir):
    """The sweep by timers: a stream of the jobs' changes, and their states when it has come to the last event's time."""
    base, shape = fresh_dir(spark, "retention"), read(spark, sf_dir, "events").schema
    e = spark.readStream.schema(shape).parquet(f"{sf_dir}/events.parque[t]")
    status = F.when(F.col("event_type") == "click", "enriching").when(F.col("event_type") == "view", "completed").otherwise("pending")
    jobs = e.select(F.concat(F.lit("j"), "user_id", F.lit("-"), "event_type").alias("job_id"), status.alias("status"), F.col("ts").alias("updated_at"))
    with job_state.rocks_store(spark):
        out = job_state.retention_stream(jobs, 30, 10).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
        out.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("job_id string, status string, at_ms bigint").parquet(f"{base}/out")
    return rows.groupBy("job_id").agg(F.max_by("status", F.struct("at_ms", "status")).alias("status")).where("status <> 'expired'")


# --- labels of the given tables -----------------------------------------------------------------------


@query("o7_part_prefixes", """WITH l AS (SELECT DISTINCT lower(concat_ws(' ', p_name, p_name, p_name, p_name, p_name, p_name)) AS label_key, 'part:' || p_partkey AS iri FROM part),
    q AS (SELECT DISTINCT left(label_key, 5) AS query FROM l UNION SELECT left(label_key, 66) FROM l)
    SELECT query, count(*) AS n_labels, min(iri) AS first_iri FROM q JOIN l ON starts_with(l.label_key, trim(q.query)) GROUP BY query""")
def o7_part(spark, sf_dir):
    """Names of parts as long labels; their first 5 and first 66 characters as queries."""
    name = F.lower(F.concat_ws(" ", *["p_name"] * 6))
    rows = read(spark, sf_dir, "part").select(name.alias("label_key"), F.concat(F.lit("part:"), "p_partkey").alias("iri")).distinct()
    asked = rows.select(F.substring("label_key", 1, 5).alias("query")).union(rows.select(F.substring("label_key", 1, 66).alias("query"))).distinct()
    return ontology.by_prefix(asked, rows).groupBy("query").agg(F.count("*").alias("n_labels"), F.min("iri").alias("first_iri"))
