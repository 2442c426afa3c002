"""Property labels in texts, with base forms of their verbs that the corpus itself shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators import match

#: Labels that are too common to be matched, the shortest label, and confidences by kind of label.
COMMON = ("not", "and", "near", "equal", "can", "has", "or")
SHORTEST = 3
CONFIDENCE = {"preferred": 0.85, "lemma": 0.72}
OTHER, SEVERAL_WORDS = 0.75, 0.05

#: Endings and what stands in their place in the base form, in order of preference.
ENDINGS = (("ied", "y"), ("ies", "y"), ("ing", "e"), ("ing", ""), ("ed", "e"), ("ed", ""), ("es", ""), ("s", ""))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words of all texts in small letters; summed in each task before they are shuffled."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def lemmas(words: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, lemma) of ``words`` (word): of the words that an ending may come from, the most frequent in ``counts``.

    Of equal counts the first ending counts, and of one ending with a doubled consonant the single one (``stopped``). The
    base form has SHORTEST letters or more and is in the texts; words without one, and null words, have no row. The
    candidates, a dozen for each word, meet the counts by equality.
    """
    w, tries = F.col("word"), []
    for k, (end, to) in enumerate(ENDINGS):
        stem = F.expr(f"left(word, length(word) - {len(end)})")
        fits = w.endswith(end)
        tries.append(F.when(fits, F.struct(F.lit(2 * k).alias("k"), F.concat(stem, F.lit(to)).alias("lemma"))))
        if not to:
            tries.append(F.when(fits & stem.rlike(r"([b-df-hj-np-tv-z])\1$"), F.struct(F.lit(2 * k + 1).alias("k"), F.expr(f"left(word, length(word) - {len(end) + 1})").alias("lemma"))))
    some = words.where("word IS NOT NULL").select("word").distinct().select("word", F.explode(F.array_compact(F.array(*tries))).alias("c")).select("word", "c.k", "c.lemma").where(F.length("lemma") >= SHORTEST)
    met = some.join(counts.select(F.col("word").alias("lemma"), "n"), "lemma")
    return met.groupBy("word").agg(F.min_by("lemma", F.struct((-F.col("n")).alias("n"), "k")).alias("lemma"))


def patterns(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label_key, iri, label_type): labels that are long enough and not too common, and base forms of labels of one word of more than three letters.

    A base form that is a label already stays that label; of several labels with one base form the first by name has it.
    """
    own = labels.where((F.length("label_key") >= SHORTEST) & ~F.col("label_key").isin(*COMMON)).select("label_key", "iri", "label_type")
    single = own.where(~F.col("label_key").contains(" ") & (F.length("label_key") > 3))
    based = lemmas(single.select(F.col("label_key").alias("word")), counts).where(~F.col("lemma").isin(*COMMON))
    based = based.join(single.select(F.col("label_key").alias("word"), "iri"), "word").groupBy("lemma").agg(F.min_by("iri", F.struct("word", "iri")).alias("iri"))
    based = based.select(F.col("lemma").alias("label_key"), "iri", F.lit("lemma").alias("label_type")).join(own.select("label_key"), "label_key", "left_anti")
    return own.unionByName(based)


def confidence(label_type: Column, label_key: Column) -> Column:
    known = F.coalesce(*[F.when(label_type == k, F.lit(v)) for k, v in CONFIDENCE.items()], F.lit(OTHER))
    return F.round(known + F.when(label_key.contains(" "), SEVERAL_WORDS).otherwise(0.0), 4)


def match_properties(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, start, end, label_key, iri, label_type, confidence) of all labels and base forms in the texts."""
    found = patterns(labels, word_counts(docs))
    hits = match.match(docs, found.select("label_key")).join(found, "label_key")
    return hits.select("doc_id", "start", "end", "label_key", "iri", "label_type", confidence(F.col("label_type"), F.col("label_key")).alias("confidence"))
