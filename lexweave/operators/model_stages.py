"""Stages that ask a model: document types, areas, metadata, quality signals, branches, individuals and properties of chunks.

A prompt is a column, an answer is parsed by SQL functions against a schema, and a failed call gives a null answer for its
row only. Rows keep their other columns through the call, so that nothing is joined back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from lexweave.functions.spans import overlapping
from lexweave.operators.models import provider_maker, register_provider, unfenced

#: Tasks that can have a provider of their own.
TASKS = ("classify", "document_type", "area_of_law", "metadata", "quality", "branch", "individuals", "properties", "concepts")
#: Metadata fields that hold one text, and fields that hold several.
TEXT_FIELDS = (
    "case_name", "court", "judge", "case_number", "jurisdiction", "procedural_posture", "cause_of_action", "relief_sought", "disposition", "standard_of_review", "governing_law",
    "author", "recipient", "date_filed", "date_signed", "date_effective", "date_due", "document_title", "docket_entry_number", "confidentiality", "contract_type", "term_duration",
    "termination_conditions", "consideration", "language", "has_exhibits",
)
LIST_FIELDS = ("parties", "claim_types", "attorneys", "signatories", "witnesses", "dates_mentioned", "related_documents", "counterparties", "addresses", "exhibit_list")
#: Words in names of branches of actions and of things.
ACTION_TERMS = ("process", "granting", "filing", "action", "procedure", "activity")
ENTITY_TERMS = ("document", "person", "organization", "role", "asset", "thing", "object")

LINKED = "confidence: double, is_new: boolean"


def route(settings: dict[str, str], default: str = "stand_in") -> dict[str, str]:
    """The provider of each task; a task without a setting has the default, a setting of another name is an error."""
    if unknown := set(settings) - set(TASKS):
        raise ValueError(f"unknown tasks: {sorted(unknown)}")
    return {task: settings.get(task, default) for task in TASKS}


def stand_in_provider():
    """A deterministic stand-in for a model: simple answers by task, from the first words or the capitalised words of the text."""

    def answer(prompt: str) -> str:
        head, _, text = prompt.partition("\nTEXT:\n")
        task, words = head.split("\n", 1)[0].removeprefix("TASK: "), text.split()
        first = words[0] if words else ""
        capital = list(dict.fromkeys(w for w in words if w[:1].isalpha() and w[:1].isupper()))
        known = dict(x.split("=", 1) for x in head.split("\n")[1:] if "=" in x)
        out = {
            "classify": {"document_type": first, "confidence": 0.8, "reasoning": "first word"},
            "document_type": {"self_identified_type": first, "confidence": 1.8, "reasoning": "first word"},
            "area_of_law": {"areas": [{"area": first, "confidence": 0.9}, {"area": "other", "confidence": 0.3}]},
            "metadata": {"document_title": first, "judge": "", "parties": capital[:2]},
            "quality": {"signals": [{"signal": "few annotations", "severity": "fatal", "details": known.get("annotations", "")}] if known.get("annotations") == "1" else []},
            "branch": {"branch": known.get("branches", "").split(",")[0] if len(words) % 2 == 0 else "", "confidence": 0.5},
            "individuals": {"individuals": [{"name": w, "mention_text": w, "individual_type": "named_entity", "class_labels": ["actor"], "confidence": 1.7, "is_new": True} for w in capital]},
            "properties": {"properties": [{"property_text": w, "label": w, "confidence": 0.6, "is_new": True} for w in dict.fromkeys(w for w in words if w in ("is", "with"))]},
        }.get(task, {})
        return json.dumps(out)

    return answer


register_provider("stand_in", stand_in_provider)


def ask(rows: DataFrame, prompt: Column, schema: str, provider: str, tries: int = 2) -> DataFrame:
    """``rows`` with ``reply``, the parsed answer to their prompt; null where the call fails or the answer is no JSON."""
    make, asked = provider_maker(provider), rows.withColumn("_prompt", prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            answers = []
            for text in batch.column("_prompt").to_pylist():
                answer = None
                for _ in range(tries):
                    try:
                        answer = call(text or "")
                        break
                    except Exception:  # noqa: BLE001, S112  a provider may raise anything; the row has no answer then
                        continue
                answers.append(answer)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], [*batch.schema.names, "_answer"])

    answered = asked.mapInArrow(run, StructType([*asked.schema.fields, StructField("_answer", StringType())]))
    return answered.withColumn("reply", F.from_json(unfenced(F.col("_answer")), schema)).drop("_prompt", "_answer")


def prompt(task: str, text: Column, **given: Column) -> Column:
    """``TASK``, a line for each given value, then the text."""
    lines = [x for name, value in given.items() for x in (F.lit(f"\n{name}="), F.coalesce(value.cast("string"), F.lit("")))]
    return F.concat(F.lit(f"TASK: {task}"), *lines, F.lit("\nTEXT:\n"), F.coalesce(text, F.lit("")))


def clamp(c: Column, otherwise: float = 0.0) -> Column:
    return F.least(F.greatest(F.coalesce(c, F.lit(otherwise)), F.lit(0.0)), F.lit(1.0))


def document_types(docs: DataFrame, provider: str) -> DataFrame:
    """(doc_id, document_type, confidence): what a text of (doc_id, text) calls itself, by its first 500 characters; none where empty or failed."""
    schema = "self_identified_type string, confidence double, reasoning string"
    some = docs.where(F.length("text") > 0).select("doc_id", F.substring("text", 1, 500).alias("text"))
    out = ask(some, prompt("document_type", F.col("text")), schema, provider)
    return out.select("doc_id", F.col("reply.self_identified_type").alias("document_type"), clamp(F.col("reply.confidence")).alias("confidence")).where(F.length("document_type") > 0)


def classify(docs: DataFrame, provider: str) -> DataFrame:
    """(doc_id, document_type, confidence, reasoning) of every text; a failed call gives ``Unknown``, 0 and ``error``."""
    schema = "document_type string, confidence double, reasoning string"
    out = ask(docs.select("doc_id", F.substring("text", 1, 500).alias("text")), prompt("classify", F.col("text")), schema, provider)
    part = lambda field, other: F.when(F.col("reply").isNull(), other).otherwise(F.col(f"reply.{field}")).alias(field)
    return out.select("doc_id", part("document_type", "Unknown"), part("confidence", 0.0), part("reasoning", "error"))


def areas_of_law(summaries: DataFrame, provider: str) -> DataFrame:
    """(doc_id, area, confidence) named for each (doc_id, summary)."""
    out = ask(summaries, prompt("area_of_law", F.col("summary")), "areas array<struct<area: string, confidence: double>>", provider)
    return out.select("doc_id", F.explode("reply.areas").alias("a")).select("doc_id", F.col("a.area").alias("area"), clamp(F.col("a.confidence")).alias("confidence"))


def metadata(contexts: DataFrame, provider: str) -> DataFrame:
    """(doc_id, field, values): the non-empty metadata fields answered for (doc_id, document_type, context)."""
    schema = ", ".join([*(f"{f} string" for f in TEXT_FIELDS), *(f"{f} array<string>" for f in LIST_FIELDS)])
    out = ask(contexts, prompt("metadata", F.col("context"), document_type=F.col("document_type")), schema, provider)
    one = [F.struct(F.lit(f).alias("field"), F.array(F.col(f"reply.{f}")).alias("values")) for f in TEXT_FIELDS]
    several = [F.struct(F.lit(f).alias("field"), F.col(f"reply.{f}").alias("values")) for f in LIST_FIELDS]
    rows = out.select("doc_id", F.explode(F.array(*one, *several)).alias("r"))
    return rows.select("doc_id", "r.field", F.filter("r.values", lambda v: F.length(v) > 0).alias("values")).where(F.size("values") > 0)


def findings(types: DataFrame, annotations: DataFrame, properties: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc_id, document_type, n_annotations, n_properties, branches, labels): counts by document, its 10 most frequent branches and 15 labels.

    types (doc_id, document_type); annotations and properties have a doc_id; concepts (doc_id, ord, branch, label). Ties go to the first seen.
    """
    out = types.select("doc_id", "document_type")
    for df, name in ((annotations, "n_annotations"), (properties, "n_properties")):
        out = out.join(df.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left").fillna(0, [name])
    for column, most, name in (("branch", 10, "branches"), ("label", 15, "labels")):
        n = concepts.where(F.length(column) > 0).groupBy("doc_id", column).agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
        top = n.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "ord", column))).where(F.col("k") <= most)
        shown = F.struct("k", F.concat(column, F.lit(" (x"), "n", F.lit(")")).alias("s"))
        shown = top.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["s"]), ", ").alias(name))
        out = out.join(shown, "doc_id", "left").fillna("none", [name])
    return out


def quality_signals(found: DataFrame, provider: str) -> DataFrame:
    """(doc_id, signal, severity, details) for documents that name their type; a severity other than ``warning`` is ``info``."""
    given = {"document_type": F.col("document_type"), "annotations": F.col("n_annotations"), "properties": F.col("n_properties"), "branches": F.col("branches")}
    out = ask(found.where(F.length("document_type") > 0), prompt("quality", F.col("labels"), **given), "signals array<struct<signal: string, severity: string, details: string>>", provider)
    s = out.select("doc_id", F.explode("reply.signals").alias("s"))
    return s.select("doc_id", F.col("s.signal").alias("signal"), F.when(F.col("s.severity") == "warning", "warning").otherwise("info").alias("severity"), F.col("s.details").alias("details"))


def pos_affinity(pos: Column, branch: Column, boost: float = 0.05) -> Column:
    """``boost`` where the part of speech suits the branch's name, its negative where it suits the other kind, else 0."""
    has = lambda terms: F.lower(branch).rlike("|".join(terms))
    verb, noun = pos.isin("VERB", "AUX"), pos.isin("NOUN", "PROPN")
    act, thing = has(ACTION_TERMS), has(ENTITY_TERMS)
    return F.when(verb & act, boost).when(verb & thing, -boost).when(noun & thing, boost).when(noun & act, -boost).otherwise(0.0)


def sentence_around(text: Column, part: Column) -> Column:
    """What stands between the full stops around the first place of ``part`` in ``text``, whatever its case; ``part`` itself if it has none."""
    at = F.instr(F.lower(text), F.lower(part))
    before = F.substring_index(F.substring(text, F.lit(1), at - 1), ".", -1)
    rest = F.substring(text, at, F.length(text))
    tail = F.substring(rest, F.length(part) + 1, F.length(rest))
    stop = F.instr(tail, ".")
    after = F.when(stop > 0, F.substring(tail, F.lit(1), stop)).otherwise(tail)
    whole = F.concat(before, F.substring(rest, F.lit(1), F.length(part)), after)
    return F.when(at > 0, F.regexp_replace(whole, r"^\s+|\s+$", "")).otherwise(part)


def judge_branches(concepts: DataFrame, docs: DataFrame, branches: str, provider: str) -> DataFrame:
    """Concepts (doc_id, ord, text, branch, pos, confidence, state): those without a branch get the judged one.

    Their confidence is 0.7 of the old and 0.3 of the judge's, moved by the part of speech's affinity; without an answered
    branch they are rejected; a failed call counts as no branch with confidence 0.5. Concepts with a branch pass as they are.
    """
    bare = F.length(F.coalesce("branch", F.lit(""))) == 0
    open_ = concepts.where(bare).join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id").withColumn("_sentence", sentence_around(F.col("_text"), F.col("text"))).drop("_text")
    out = ask(open_, prompt("branch", F.col("_sentence"), concept=F.col("text"), branches=F.lit(branches)), "branch string, confidence double", provider)
    branch = F.coalesce("reply.branch", F.lit(""))
    blend = F.least(F.lit(1.0), F.col("confidence") * 0.7 + F.when(F.col("reply").isNull(), 0.5).otherwise(F.coalesce("reply.confidence", F.lit(0.0))) * 0.3)
    sure = F.when(branch == "", blend).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend + pos_affinity(F.col("pos"), branch))))
    judged = out.select("doc_id", "ord", "text", branch.alias("branch"), "pos", sure.alias("confidence"), F.when(branch == "", "rejected").otherwise("confirmed").alias("state"))
    return judged.unionByName(concepts.where(~bare).select(*judged.columns))


def _with_context(chunks: DataFrame, known: DataFrame, shown: Column, name: str) -> DataFrame:
    """Chunks (doc_id, chunk_index, start_offset, end_offset, text) with the texts of the spans ``known`` that overlap them."""
    own = overlapping(chunks.select("doc_id", "chunk_index", F.col("start_offset").alias("lo"), F.col("end_offset").alias("hi")), known.withColumn("_shown", shown).select("doc_id", "start", "end", "_shown"))
    some = own.groupBy("doc_id", "chunk_index").agg(F.array_join(F.sort_array(F.collect_set("_shown")), "; ").alias(name))
    return chunks.join(some, ["doc_id", "chunk_index"], "left")


def _located(items: DataFrame, mention: Column) -> DataFrame:
    """Items of a chunk with their span in the document: the first exact place of the mention in the chunk, else the first in any case; others go."""
    exact = F.instr(F.col("text"), mention)
    at = F.when(exact > 0, exact).otherwise(F.instr(F.lower("text"), F.lower(mention)))
    placed = items.where(F.length(mention) > 0).withColumn("start", (F.col("start_offset") + at - 1).cast("int")).withColumn("_at", at)
    return placed.where("_at > 0").withColumn("end", (F.col("start") + F.length(mention)).cast("int")).drop("_at")


def individuals(chunks: DataFrame, annotations: DataFrame, existing: DataFrame, provider: str) -> tuple[DataFrame, DataFrame]:
    """(new, links) that a model names in chunks.

    annotations (doc_id, ann_id, start, end, text) and existing individuals (doc_id, name, mention, start, end) that overlap a
    chunk are part of its prompt. new: (doc_id, chunk_index, name, mention, start, end, individual_type, label, confidence), a row
    for each class label (null without). links: (doc_id, start, end, name, label, confidence) for existing individuals that an
    answer names again, by name or mention in any case, within the chunk.
    """
    seen = _with_context(_with_context(chunks, annotations, F.col("text"), "_classes"), existing, F.col("name"), "_known")
    item = f"struct<name: string, mention_text: string, individual_type: string, class_labels: array<string>, {LINKED}>"
    out = ask(seen, prompt("individuals", F.col("text"), classes=F.col("_classes"), known=F.col("_known")), f"individuals array<{item}>", provider)
    items = out.select("doc_id", "chunk_index", "start_offset", "end_offset", "text", F.explode("reply.individuals").alias("x"))
    mention, sure = F.col("x.mention_text"), clamp(F.col("x.confidence"), 0.5)
    is_new = F.coalesce("x.is_new", F.lit(True))
    new = _located(items.where(is_new), mention).select(
        "doc_id", "chunk_index", F.coalesce("x.name", mention).alias("name"), mention.alias("mention"), "start", "end",
        F.coalesce("x.individual_type", F.lit("named_entity")).alias("individual_type"), F.explode_outer("x.class_labels").alias("label"), sure.alias("confidence"),
    )
    again = items.where(~is_new).select("doc_id", "start_offset", "end_offset", F.lower(F.coalesce("x.name", mention)).alias("_n"), F.lower(mention).alias("_m"), F.explode("x.class_labels").alias("label"), sure.alias("confidence"))
    keys = existing.select("doc_id", "start", "end", "name", F.explode(F.array_distinct(F.array(F.struct(F.lit("n").alias("by"), F.lower("name").alias("key")), F.struct(F.lit("m").alias("by"), F.lower("mention").alias("key"))))).alias("k"))
    asked = again.select("doc_id", "start_offset", "end_offset", "label", "confidence", F.explode(F.array(F.struct(F.lit("n").alias("by"), F.col("_n").alias("key")), F.struct(F.lit("m").alias("by"), F.col("_m").alias("key")))).alias("k"))
    met = asked.join(keys, ["doc_id", "k"]).where("end > start_offset AND start < end_offset")
    links = met.groupBy("doc_id", "start", "end", "name", "label").agg(F.max("confidence").alias("confidence"))
    return new, links


def properties(chunks: DataFrame, known: DataFrame, labels: DataFrame, provider: str) -> DataFrame:
    """(doc_id, chunk_index, text, label, iri, start, end, confidence): new properties that a model names in chunks.

    known properties (doc_id, start, end, text) that overlap a chunk are part of its prompt; labels (label_key, iri) are a dictionary.
    """
    item = f"struct<property_text: string, label: string, {LINKED}>"
    out = ask(_with_context(chunks, known, F.col("text"), "_known"), prompt("properties", F.col("text"), known=F.col("_known")), f"properties array<{item}>", provider)
    items = out.select("doc_id", "chunk_index", "start_offset", "text", F.explode("reply.properties").alias("x")).where(F.coalesce("x.is_new", F.lit(True)))
    found = _located(items, F.col("x.property_text")).select("doc_id", "chunk_index", F.col("x.property_text").alias("text"), F.col("x.label").alias("label"), "start", "end", clamp(F.col("x.confidence"), 0.5).alias("confidence"))
    first = labels.groupBy("label_key").agg(F.min("iri").alias("iri"))
    return found.withColumn("label_key", F.lower("label")).join(first, "label_key", "left").drop("label_key")
