"""Part-of-speech lookups and subject-predicate-object triples over a token table.

token_pos: (doc_id, sent_idx, tok_idx, start, end, token, lemma, pos, tag, dep, head)
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.spans import overlapping


def majority_pos(spans: DataFrame, token_pos: DataFrame, column: str = "pos") -> DataFrame:
    """Spans (doc_id, start, end) with the most frequent tag of their tokens in the first sentence that has one; the first seen wins ties."""
    t = token_pos.select("doc_id", "sent_idx", "tok_idx", "start", "end", F.col(column).alias("tag"))
    met = overlapping(spans.select("doc_id", F.col("start").alias("lo"), F.col("end").alias("hi")).distinct(), t)
    met = met.select("doc_id", F.col("lo").alias("start"), F.col("hi").alias("end"), "sent_idx", "tok_idx", "tag")
    first = met.groupBy("doc_id", "start", "end").agg(F.min("sent_idx").alias("sent_idx"))
    counts = met.join(first, ["doc_id", "start", "end", "sent_idx"]).groupBy("doc_id", "start", "end", "tag").agg(F.count("*").alias("n"), F.min("tok_idx").alias("at"))
    return counts.groupBy("doc_id", "start", "end").agg(F.min_by("tag", F.struct((-F.col("n")).alias("k"), "at")).alias("majority"))


def svo(token_pos: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, subject, predicate, object, voice, confidence) around root and relative-clause verbs, by self-joins on heads."""
    key = ["doc_id", "sent_idx"]
    verbs = token_pos.where(F.col("dep").isin("ROOT", "relcl", "conj") & (F.col("pos") == "VERB")).select(*key, F.col("tok_idx").alias("v"), F.col("lemma").alias("predicate"))
    child = lambda deps, name: token_pos.where(F.col("dep").isin(*deps)).select(*key, F.col("head").alias("v"), F.col("token").alias(name), F.col("pos").alias(f"{name}_pos"))
    active = verbs.join(child(["nsubj"], "subject"), [*key, "v"]).join(child(["dobj", "attr", "oprd"], "object"), [*key, "v"]).withColumn("voice", F.lit("active"))
    agents = token_pos.where("dep = 'agent'").select(*key, F.col("head").alias("v"), F.col("tok_idx").alias("by"))
    objects = token_pos.where("dep = 'pobj'").select(*key, F.col("head").alias("by"), F.col("token").alias("subject"), F.col("pos").alias("subject_pos"))
    doers = agents.join(objects, [*key, "by"]).drop("by")
    passive = verbs.join(child(["nsubjpass"], "object"), [*key, "v"]).join(doers, [*key, "v"], "left").withColumn("voice", F.lit("passive"))
    both = active.unionByName(passive)
    noun = lambda c: F.coalesce(F.col(c).isin("NOUN", "PROPN", "PRON"), F.lit(False)).cast("double")
    sure = F.lit(0.5) + 0.1 * noun("subject_pos") + 0.1 + 0.1 * noun("object_pos") - F.when(F.col("voice") == "passive", 0.05).otherwise(0.0)
    known = F.least(F.greatest(sure, F.lit(0.30)), F.lit(0.85))
    return both.select(*key, F.coalesce("subject", F.lit("[agent]")).alias("subject"), "predicate", "object", "voice", F.round(F.when(F.col("subject").isNull(), F.greatest(F.lit(0.3), F.lit(0.5))).otherwise(known), 4).alias("confidence"))


def link_triples(triples: DataFrame, annotations: DataFrame) -> DataFrame:
    """(triple_id, role, iri): live annotations whose span meets the subject's or object's, touching ends included."""
    out = None
    for role in ("s", "o"):
        t = triples.where(F.col(f"{role}_start").isNotNull()).select("doc_id", "triple_id", F.col(f"{role}_start").alias("lo"), (F.col(f"{role}_end") + 1).alias("hi"))
        met = overlapping(t, annotations.where("state <> 'rejected'").select("doc_id", "start", (F.col("end") + 1).alias("end"), "iri")).select("triple_id", F.lit("subject" if role == "s" else "object").alias("role"), "iri")
        out = met if out is None else out.unionByName(met)
    return out.distinct()


def subtrees(token_pos: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, tok_idx, start, end, text): the span and the words of each token's subtree.

    A sentence is one row of tokens, and a token is added to each of its ancestors; a head that is itself, missing or in a circle ends the climb.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, sent, toks in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "sent_idx", "toks")], strict=True):
                by = {t["tok_idx"]: t for t in toks}
                held: dict[int, list[dict]] = {k: [] for k in by}
                for k, t in by.items():
                    at, seen = k, set()
                    while at in by and at not in seen:
                        seen.add(at)
                        held[at].append(t)
                        at = by[at]["head"]
                rows.extend((doc, sent, k, own[0]["start"], own[-1]["end"], " ".join(t["token"] for t in own)) for k, own in held.items())
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "sent_idx", "tok_idx", "start", "end", "text"])

    own = F.sort_array(F.collect_list(F.struct("tok_idx", "start", "end", "token", "head")))  # the tokens of one sentence
    return token_pos.groupBy("doc_id", "sent_idx").agg(own.alias("toks")).mapInArrow(run, "doc_id bigint, sent_idx int, tok_idx int, start int, end int, text string")


def link_texts(triples: DataFrame, individuals: DataFrame, properties: DataFrame) -> DataFrame:
    """(triple_id, role, kind, entity_id, confidence): individuals (doc_id, id, mention) whose mention is in the subject or object, for
    .8, and properties (doc_id, id, text, confidence) whose text is in the predicate, whatever the case."""
    t = triples.select("doc_id", "triple_id", *[F.lower(c).alias(c) for c in ("subject", "predicate", "object")])
    i = individuals.where(F.length("mention") > 0).select("doc_id", F.col("id").alias("entity_id"), F.lower("mention").alias("m"), F.lit(0.8).alias("confidence"))
    p = properties.where(F.length("text") > 0).select("doc_id", F.col("id").alias("entity_id"), F.lower("text").alias("m"), "confidence")
    out = None
    for role, kind, known in (("subject", "individual", i), ("object", "individual", i), ("predicate", "property", p)):
        met = t.join(known, "doc_id").where(F.contains(F.col(role), F.col("m"))).select("triple_id", F.lit(role).alias("role"), F.lit(kind).alias("kind"), "entity_id", "confidence")
        out = met if out is None else out.unionByName(met)
    return out


def flat_triples(triples: DataFrame, links: DataFrame) -> DataFrame:
    """``triples`` (triple_id, ...) with the first linked concept, individual and property (links: triple_id, role, kind, entity_id, ord), empty where none."""
    first = links.groupBy("triple_id").agg(
        *[
            F.coalesce(F.min_by("entity_id", F.when((F.col("role") == role) & (F.col("kind") == kind), F.struct("ord", "entity_id"))), F.lit("")).alias(name)
            for name, role, kind in (
                ("subject_iri", "subject", "concept"), ("object_iri", "object", "concept"), ("subject_individual", "subject", "individual"),
                ("object_individual", "object", "individual"), ("predicate_property", "predicate", "property"),
            )
        ]
    )
    return triples.join(first, "triple_id", "left").na.fill("")
