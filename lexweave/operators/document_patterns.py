"""Annotation by the patterns of each document's own concepts: a dictionary that differs from document to document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.operators import match
from lexweave.operators.models import best_concepts
from lexweave.sources.shared import fresh_dir, kept

#: Single words that are no pattern when they are only another label of a concept.
COMMON_LABELS = """
    act bar bill bond brief case charge claim
    code count court deed due duty fee fine
    firm fund grant hold law lien loan loss
    note order party pay plea right rule sale
    seal suit tax term title tort trust use
    wage ward will writ
""".split()
SHORTEST_LABEL = 4


def safe_label(label: Column) -> Column:
    """Whether another label of a concept may be looked for: not too short, and no common single word."""
    return (F.length(label) >= SHORTEST_LABEL) & (label.contains(" ") | ~F.lower(label).isin(*COMMON_LABELS))


def concept_patterns(resolved: DataFrame, alternatives: DataFrame) -> DataFrame:
    """(doc_id, label_key, iri, concept_text, confidence) of concepts resolved in documents (doc_id, concept_text, iri, confidence, ord).

    A concept is looked for by its text and by the other labels of its iri (iri, label, seq) that are safe. Of several concepts
    with one text and iri the first holds the place, and a surer one whose own text it is takes it. Null iris are one of their own.
    """
    own = resolved.select("doc_id", F.lower("concept_text").alias("label_key"), F.coalesce("iri", F.lit("")).alias("iri"), "concept_text", "confidence", "ord", F.lit(-1).alias("seq"))
    own, _ = kept(own, fresh_dir(resolved.sparkSession, "resolved"))  # read twice
    others = alternatives.where(safe_label(F.col("label"))).select("iri", F.lower("label").alias("_label"), F.col("seq").cast("int").alias("seq"))
    more = own.drop("label_key", "seq").join(others, "iri").withColumnRenamed("_label", "label_key").select(*own.columns)
    first = F.row_number().over(Window.partitionBy("doc_id", "label_key", "iri").orderBy("ord", "seq", "concept_text"))
    rows = own.unionByName(more).where("label_key <> ''").withColumn("_first", first).where("seq = -1 OR _first = 1")
    best = F.struct("confidence", (-F.col("ord")).alias("o"), (-F.col("seq")).alias("s"), "concept_text")
    best_of = rows.groupBy("doc_id", "label_key", "iri").agg(F.max(best).alias("b"))
    return best_of.select("doc_id", "label_key", "iri", F.col("b.concept_text").alias("concept_text"), F.col("b.confidence").alias("confidence"))


def concept_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, start, end, text, iri, confidence): where a model's concepts (doc_id, concept_text, iri, confidence) stand in the text.

    Of concepts of one text the surest counts; spans are resolved as matches of a dictionary are.
    """
    some = found if "iri" in found.columns else found.withColumn("iri", F.lit(""))
    iri = some.groupBy("doc_id", F.lower("concept_text").alias("label_key")).agg(F.max_by("iri", F.struct("confidence", "iri")).alias("iri"))
    best = best_concepts(some).join(iri, ["doc_id", "label_key"])
    spans = match.match_by_document(docs, best, resolve=True)
    return spans.join(best, ["doc_id", "label_key"]).select("doc_id", "start", "end", F.col("label_key").alias("text"), "iri", "confidence")


def annotation_id(*parts: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def attach(matches: DataFrame, existing: DataFrame) -> DataFrame:
    """Matches (doc_id, start, end, text, iri, confidence) with the id of the annotation that they confirm, and rejected ones that stay.

    ``existing`` (doc_id, ann_id, start, end, text, iri, confidence, state): at one span the last annotation (by ann_id) of the concept is
    confirmed, else the first of the same text, else a new one is made. A rejected annotation stays where its span has no match.
    """
    held = existing.withColumns({"iri": F.coalesce("iri", F.lit("")), "_text": F.lower("text")})
    by_iri = held.groupBy("doc_id", "start", "end", "iri").agg(F.max("ann_id").alias("_a"))
    by_text = held.groupBy("doc_id", "start", "end", "_text").agg(F.min("ann_id").alias("_b"))
    met = matches.withColumn("_text", F.lower("text")).join(by_iri, ["doc_id", "start", "end", "iri"], "left").join(by_text, ["doc_id", "start", "end", "_text"], "left")
    done = met.select("doc_id", F.coalesce("_a", "_b", annotation_id("doc_id", "start", "end", "iri")).alias("ann_id"), "start", "end", "text", "iri", "confidence", F.lit("confirmed").alias("state"))
    gone = held.where("state = 'rejected'").join(matches.select("doc_id", "start", "end").distinct(), ["doc_id", "start", "end"], "left_anti")
    return done.unionByName(gone.select(*done.columns))


def annotate(docs: DataFrame, resolved: DataFrame, alternatives: DataFrame, existing: DataFrame) -> DataFrame:
    """(doc_id, ann_id, start, end, text, iri, confidence, state): the documents' annotations after string matching.

    Patterns are each document's own; every match goes to all concepts of its text, is attached to the annotations there are,
    and of overlapping spans of one concept the longest, then surest stays.
    """
    base = fresh_dir(docs.sparkSession, "annotate")  # what is read more than once is made once
    patterns, _ = kept(concept_patterns(resolved, alternatives), f"{base}/patterns")
    spans = match.match_by_document(docs, patterns, resolve=True)
    every = spans.join(patterns, ["doc_id", "label_key"]).select("doc_id", "start", "end", F.col("concept_text").alias("text"), "iri", "confidence")
    every, _ = kept(every.dropDuplicates(["doc_id", "start", "end", "iri"]), f"{base}/matches")
    rows, _ = kept(attach(every, existing), f"{base}/rows")
    aside = (F.col("iri") == "") | (F.col("state") == "rejected")
    first = match.longest_first(rows.where(~aside), ["doc_id", "iri"], [F.col("start") - F.col("end"), -F.col("confidence")], ["ann_id", "text", "confidence", "state"])
    return rows.where(aside).unionByName(first.select(*rows.columns))
