"""Reconciliation of two evidence sources, resolution blends and annotation states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.config import BOOST, POS_PENALTY, REJECT_BELOW, RULER_ONLY_MIN


def boosted(a: Column, b: Column) -> Column:
    base = F.greatest(a, b)
    return F.least(F.lit(1.0), base + BOOST * (1 - base))


def last_by_key(rows: DataFrame) -> DataFrame:
    """The last row (by ord) of each (doc_id, lower text, iri)."""
    key = rows.withColumns({"text": F.lower("concept_text"), "iri": F.coalesce("iri", F.lit(""))})
    return key.groupBy("doc_id", "text", "iri").agg(F.max_by("confidence", "ord").alias("confidence"), F.min("ord").alias("ord"))


def reconcile(ruler: DataFrame, llm: DataFrame) -> DataFrame:
    """(doc_id, text, iri, confidence, category) of two sources (doc_id, concept_text, iri, confidence, ord).

    Equal text and concept on both sides agree, then rows without a concept pair with rows of the same text, one to one in order;
    of the rest, dictionary rows stay from RULER_ONLY_MIN on and model rows always.
    """
    r, m = last_by_key(ruler), last_by_key(llm)
    keys = ["doc_id", "text", "iri"]
    both = r.withColumnRenamed("confidence", "rc").drop("ord").join(m.withColumnRenamed("confidence", "mc").drop("ord"), keys)
    agree = both.select(*keys, boosted(F.col("rc"), F.col("mc")).alias("confidence"), F.lit("both_agree").alias("category"))
    r1, m1 = r.join(both.select(*keys), keys, "left_anti"), m.join(both.select(*keys), keys, "left_anti")

    def pair(bare: DataFrame, other: DataFrame) -> DataFrame:
        w = Window.partitionBy("doc_id", "text").orderBy("ord", "iri")
        a = bare.where("iri = ''").withColumn("k", F.row_number().over(w)).select("doc_id", "text", "k", F.col("confidence").alias("bc"))
        b = other.withColumn("k", F.row_number().over(w)).select("doc_id", "text", "k", "iri", "confidence")
        return a.join(b, ["doc_id", "text", "k"])

    p = pair(r1, m1)
    second = p.select(*keys, boosted(F.col("bc"), F.col("confidence")).alias("confidence"), F.lit("both_agree").alias("category"))
    r2 = r1.join(p.select("doc_id", "text", F.lit("").alias("iri")), keys, "left_anti")
    m2 = m1.join(p.select(*keys), keys, "left_anti")
    q = pair(m2, r2)
    third = q.select(*keys, boosted(F.col("bc"), F.col("confidence")).alias("confidence"), F.lit("both_agree").alias("category"))
    m3 = m2.join(q.select("doc_id", "text", F.lit("").alias("iri")), keys, "left_anti")
    r3 = r2.join(q.select(*keys), keys, "left_anti")
    only_r = r3.where(F.col("confidence") >= RULER_ONLY_MIN).select(*keys, "confidence", F.lit("ruler_only").alias("category"))
    only_m = m3.select(*keys, "confidence", F.lit("llm_only").alias("category"))
    return agree.unionByName(second).unionByName(third).unionByName(only_r).unionByName(only_m)


def next_state(category: Column, state: Column) -> Column:
    """Annotation state after reconciliation."""
    return F.when(category.isin("both_agree", "conflict_resolved"), "confirmed").when(category.isNull(), "rejected").otherwise(state)


def annotation_states(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """``annotations`` (doc_id, text, iri, state, ...) with the state that reconciliation (doc_id, text, iri, category) gives the preliminary ones.

    Text and concept decide; an annotation without a concept goes by its text alone, where an agreed or settled category counts before others.
    """
    key = categories.select("doc_id", F.lower("text").alias("_t"), F.coalesce("iri", F.lit("")).alias("_i"), "category")
    strong = F.col("category").isin("both_agree", "conflict_resolved")
    exact = key.groupBy("doc_id", "_t", "_i").agg(F.min_by("category", F.struct(~strong, "category")).alias("_exact"))
    loose = key.groupBy("doc_id", "_t").agg(F.min_by("category", F.struct(~strong, "category")).alias("_loose")).withColumn("_i", F.lit(""))
    own = annotations.withColumns({"_t": F.lower("text"), "_i": F.coalesce("iri", F.lit(""))})
    met = own.join(exact, ["doc_id", "_t", "_i"], "left").join(loose, ["doc_id", "_t", "_i"], "left")
    state = F.when(F.col("state") == "preliminary", next_state(F.coalesce("_exact", "_loose"), F.col("state"))).otherwise(F.col("state"))
    return met.withColumn("state", state).drop("_t", "_i", "_exact", "_loose")


def pos_penalty(confidence: Column, text: Column, match_type: Column, majority: Column) -> tuple[Column, Column]:
    """(confidence, rejected) of single alternative labels that are tagged as verbs or adverbs."""
    hit = ~text.contains(" ") & (match_type == "alternative") & majority.isin("VERB", "ADV")
    out = F.when(hit, F.greatest(F.lit(0.0), confidence - POS_PENALTY)).otherwise(confidence)
    return out, hit & (out < REJECT_BELOW)


#: Words that do not count when definitions are compared, and the similarity from which it decides alone.
COMMON = "the a an of to in for and or is on at by with".split()
SURE = 0.85


def definition_overlap(a: Column, b: Column, stop: list[str] = COMMON) -> Column:
    """Shared words, cut at white space, over the larger word count of two texts, stop words left out; none if one has none."""
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+")), lambda w: (w != "") & ~w.isin(*stop))
    x, y = words(a), words(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))).otherwise(0.0)


def resolve_conflicts(pairs: DataFrame, similarity) -> DataFrame:
    """(doc_id, text, iri, confidence, category) of pairs (doc_id, text, r_iri, r_label, r_definition, r_confidence, m_iri, ...) of one text and two concepts.

    The more similar label wins if one is over SURE, the dictionary's on a tie, and lifts the confidence; else the definition
    that shares more words with the text; else both stay. ``similarity``: a function of two columns.
    """
    p = pairs.withColumns({"rs": similarity(F.col("text"), F.coalesce("r_label", "text")), "ms": similarity(F.col("text"), F.coalesce("m_label", "text"))})
    p = p.withColumns({"ro": definition_overlap(F.col("text"), F.col("r_definition")), "mo": definition_overlap(F.col("text"), F.col("m_definition"))})
    sure = F.greatest("rs", "ms") > SURE
    own = lambda k, c: F.struct(F.col(f"{k}_iri").alias("iri"), c.cast("double").alias("confidence"))
    by_label = F.when(F.col("rs") >= F.col("ms"), F.array(own("r", F.greatest("r_confidence", "rs")))).otherwise(F.array(own("m", F.greatest("m_confidence", "ms"))))
    r, m = own("r", F.col("r_confidence")), own("m", F.col("m_confidence"))
    by_text = F.when(F.col("ro") > F.col("mo"), F.array(r)).when(F.col("mo") > F.col("ro"), F.array(m)).otherwise(F.array(r, m))
    kept = p.select("doc_id", "text", F.explode(F.when(sure, by_label).otherwise(by_text)).alias("w"))
    return kept.select("doc_id", "text", "w.iri", "w.confidence", F.lit("conflict_resolved").alias("category"))


def reconcile_with_triage(ruler: DataFrame, llm: DataFrame, concepts: DataFrame, similarity) -> DataFrame:
    """As ``reconcile``, but rows of one text with two different concepts are a conflict, paired in order and settled by ``resolve_conflicts``."""
    r, m = last_by_key(ruler), last_by_key(llm)
    keys = ["doc_id", "text", "iri"]
    exact = r.select(*keys).join(m.select(*keys), keys)
    r1, m1 = r.join(exact, keys, "left_anti"), m.join(exact, keys, "left_anti")
    plain = lambda df: df.select("doc_id", F.col("text").alias("concept_text"), "iri", "confidence", "ord")
    told = lambda df, k: df.where("iri <> ''").withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("ord", "iri")))
    bare = r1.where("iri = ''").select("doc_id", "text").unionByName(m1.where("iri = ''").select("doc_id", "text")).distinct()
    a, b = (told(x.join(bare, ["doc_id", "text"], "left_anti"), "k") for x in (r1, m1))
    met = a.select("doc_id", "text", "k", F.col("iri").alias("r_iri"), F.col("confidence").alias("r_confidence")).join(b.select("doc_id", "text", "k", F.col("iri").alias("m_iri"), F.col("confidence").alias("m_confidence")), ["doc_id", "text", "k"])
    for side in ("r", "m"):
        met = met.join(concepts.select(F.col("iri").alias(f"{side}_iri"), F.col("label").alias(f"{side}_label"), F.col("definition").alias(f"{side}_definition")), f"{side}_iri", "left")
    settled = resolve_conflicts(met, similarity)
    rest = lambda df, side: plain(df.join(met.select("doc_id", "text", F.col(f"{side}_iri").alias("iri")), keys, "left_anti"))
    return reconcile(rest(r, "r"), rest(m, "m")).unionByName(settled)


def merge_preliminary(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` and those of ``new`` at spans (doc_id, start, end, text) that ``old`` lacks."""
    return old.unionByName(new.join(old.select("doc_id", "start", "end", "text").distinct(), ["doc_id", "start", "end", "text"], "left_anti"))


def context_blend(confidence: Column, similarity: Column) -> Column:
    return F.round(0.6 * confidence + 0.4 * F.least(F.greatest(similarity, F.lit(0.0)), F.lit(1.0)), 4)
