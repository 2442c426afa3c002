"""Final span annotation, metadata contexts and promotions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.config import LOW_CONFIDENCE
from lexweave.functions.text import dealt
from lexweave.operators import match
from lexweave.operators.entities import spans

#: Suffixes of names of organisations.
ORGANISATION = (
    r"(?i)\b(?:LLP|LLC|L\.L\.P\.|L\.L\.C\.|Inc|Corp|Corporation|Ltd|Limited|P\.?C\.?|P\.?A\.?|P\.?L\.?L\.?C\.?|L\.?P\.?|LTD|PLC|GmbH|AG|S\.?A\.?"
    r"|Co\.|& Co|Associates|Partners|Group|Holdings|Foundation|International|Bancorp|Bank|Trust)\b"
)
#: Phrases that are never names.
NO_NAMES = (
    "de novo", "de facto", "de jure", "de minimis", "ex parte", "ex rel", "habeas corpus", "in camera", "in forma pauperis", "in limine", "in personam", "in re", "in rem", "inter alia",
    "mens rea", "nolo contendere", "nunc pro tunc", "per curiam", "per se", "prima facie", "pro bono", "pro hac vice", "pro se", "pro tem", "pro tempore", "quantum meruit", "quasi",
    "res judicata", "stare decisis", "sua sponte", "sub judice", "sui generis", "voir dire", "appellant", "appellee", "petitioner", "respondent", "plaintiff", "defendant", "amicus curiae",
    "amici curiae",
)
PLACE = r"\b(?:County|City|State|States|Province|District|Republic|Kingdom|Island|Islands|Valley|River|Lake)$"
REPORTER = r"U\.S\.C\.|U\.S\.|F\.\d?d|F\. Supp\.(?: \dd)?|S\. Ct\."
CITATION = rf"\b\d{{1,4}}\s+(?:{REPORTER})\s*(?:§\s*)?\d+[a-z]?\b|\b[A-Z][\w.]+(?: [A-Z][\w.]+){{0,8}} v\. [A-Z][\w.]+(?: [A-Z][\w.]+){{0,8}}"
NAME = r"\b[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|[A-Z]\.|of|&)){0,8}\s+(?:Inc\.?|LLC|Ltd\.?|Corp\.?|[A-Z][a-z]+)"


def citations(docs: DataFrame) -> DataFrame:
    """Reporter, code and case citations by an own grammar: (doc_id, start, end, mention, normalized, label)."""
    found = spans(docs, {"citation": f"({CITATION})"})
    label = F.when(F.col("whole").contains("U.S.C."), "Statute").when(F.col("whole").contains(" v. "), "Case Name").otherwise("Caselaw")
    return found.select("doc_id", "start", "end", F.col("whole").alias("mention"), F.regexp_replace("whole", r"\s+", " ").alias("normalized"), label.alias("label"))


def citation_url(normalized: Column) -> Column:
    """Where a citation can be read: sections of the code and pages of reporters have an address, case names have none."""
    part = lambda k: F.regexp_extract(normalized, rf"^(\d+) ({REPORTER}) ?(?:§ ?)?(\d+[a-z]?)$", k)
    code = F.concat(F.lit("https://www.law.cornell.edu/uscode/text/"), part(1), F.lit("/"), part(3))
    page = F.concat(F.lit("https://www.courtlistener.com/c/"), F.replace(part(2), F.lit(" "), F.lit("%20")), F.lit("/"), part(1), F.lit("/"), part(3), F.lit("/"))
    return F.when(part(2) == "U.S.C.", code).when(part(2) != "", page)


def add_citations(individuals: DataFrame, found: DataFrame) -> DataFrame:
    """Individuals (doc_id, start, end, mention, normalized, url, label, confidence, source) with addresses, and the citations found elsewhere.

    An individual whose mention reads as a citation gets its address and, where it differs, its normal form. Citations of
    ``found`` at spans that no individual has are added with confidence 0.90.
    """
    plain = F.regexp_replace("mention", r"\s+", " ")
    url = citation_url(plain)
    known = individuals.withColumns({"url": F.coalesce(url, F.col("url")), "normalized": F.when(url.isNotNull() & (plain != F.col("mention")), plain).otherwise(F.col("normalized"))})
    extra = found.join(individuals.select("doc_id", "start", "end").distinct(), ["doc_id", "start", "end"], "left_anti").dropDuplicates(["doc_id", "start", "end"])
    new = extra.select(
        "doc_id", "start", "end", "mention", F.when(F.col("normalized") != F.col("mention"), F.col("normalized")).alias("normalized"), citation_url(F.col("normalized")).alias("url"),
        F.lit("Legal Citation").alias("label"), F.lit(0.90).alias("confidence"), F.lit("citeurl").alias("source"),
    )
    return known.select(*new.columns).unionByName(new)


def names(docs: DataFrame) -> DataFrame:
    """Capitalised sequences as persons, organisations or locations: a heuristic stand-in for a trained tagger, without phrases that are never names."""
    found = spans(docs, {"name": f"({NAME})"}).withColumnRenamed("whole", "mention").where(~F.lower(F.trim("mention")).isin(*NO_NAMES))
    label = F.when(F.col("mention").rlike(ORGANISATION), "Organization").when(F.col("mention").rlike(PLACE), "Location").otherwise("Person")
    return found.select("doc_id", "start", "end", "mention", label.alias("label"), F.when(label == "Person", 0.80).otherwise(0.78).alias("confidence"))


#: Labels that every run of words is compared with in place; more of them go by an index.
FEW_LABELS = 2048
RUN = "doc_id bigint, start int, end int, gram string"


def _runs(docs: DataFrame, low: int, high: int, labels: list[str] | None = None, least: float = 0.0, stop: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, start, end, gram): runs of ``low`` to ``high`` tokens; with ``labels``, those with a similar one, its name and the similarity."""
    from lexweave.operators.vectors import TEXT_BLOCK, trigram_vectors

    known = None if labels is None else (labels, trigram_vectors(labels))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, (start, token) = match.cut(batch.column("_marked").cast(pa.string()), ["start", "token"], None)
        start, end = start.to_numpy(), start.to_numpy() + pc.utf8_length(token).to_numpy()
        idle = pc.is_in(token, value_set=pa.array(list(stop), pa.string())).to_numpy(zero_copy_only=False)
        for n in range(low, high + 1):
            at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, np.int64)
            at = at[~np.logical_and.reduce([idle[at + k] for k in range(n)])] if stop else at
            for a in range(0, len(at), TEXT_BLOCK):
                own = at[a : a + TEXT_BLOCK]
                gram, more = pc.binary_join_element_wise(*[token.take(pa.array(own + k)) for k in range(n)], " "), []
                if known is not None:
                    once = gram.dictionary_encode()
                    s = np.round(trigram_vectors(once.dictionary.to_pylist()) @ known[1].T, 6)
                    best, which = s.argmax(1), once.indices.to_numpy()
                    near = s[np.arange(len(s)), best]
                    keep = np.flatnonzero(near[which] >= least)
                    own, gram, which = own[keep], gram.take(pa.array(keep)), which[keep]
                    more = [pa.array([known[0][k] for k in best[which]], pa.string()), pa.array(near[which])]
                names = ["doc_id", "start", "end", "gram", "label", "similarity"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[own])), pa.array(start[own], pa.int32()), pa.array(end[own + n - 1], pa.int32()), gram, *more], names[: 4 + len(more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in match.slices(batch, "_marked"):
                yield from rows(part)

    texts = dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", match.marked(F.col("text")).alias("_marked")).where("_marked IS NOT NULL")
    return texts.mapInArrow(run, RUN + (", label string, similarity double" if labels is not None else ""))


def _outside(runs: DataFrame, known: DataFrame) -> DataFrame:
    """Runs (start, end) that neither begin nor end in a known span (doc_id, start, end)."""
    inside = known.where("start < end").select("doc_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("_at")).distinct()  # labels are short
    for at in (F.col("start"), F.col("end") - 1):
        runs = runs.withColumn("_at", at).join(inside.hint("merge"), ["doc_id", "_at"], "left_anti").drop("_at")
    return runs


def semantic_candidates(docs: DataFrame, known: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    """(doc_id, start, end, gram): runs of ``low`` to ``high`` tokens that do not begin or end in a known span (doc_id, start, end)."""
    return _outside(_runs(docs, low, high), known)


def semantic_spans(docs: DataFrame, known: DataFrame, labels: DataFrame, least: float = 0.80, stop: tuple[str, ...] = (), low: int = 2, high: int = 4) -> DataFrame:
    """``semantic_matches`` of ``semantic_candidates``: few labels are compared with every run where its text is, and only what is similar meets the known spans."""
    names = [r[0] for r in labels.select("label_key").where("label_key IS NOT NULL").distinct().orderBy("label_key").limit(FEW_LABELS + 1).collect()]
    if not 0 < len(names) <= FEW_LABELS:
        return semantic_matches(semantic_candidates(docs, known, low, high), labels, least, stop)
    some = _outside(_runs(docs, low, high, names, least, stop), known)
    return some.join(labels.withColumnRenamed("label_key", "label"), "label").select("doc_id", "start", "end", "gram", "label", "iri", "similarity")


def semantic_matches(candidates: DataFrame, labels: DataFrame, least: float = 0.80, stop: tuple[str, ...] = ()) -> DataFrame:
    """Candidate runs (doc_id, start, end, gram) with the most similar label (label_key, iri) of at least ``least``, by hashed trigram vectors.

    Runs of stop words alone are skipped. Distinct runs are compared once, by an index of the labels.
    """
    from lexweave.operators import vector_index

    some = candidates.where(F.size(F.filter(F.split("gram", " "), lambda w: ~w.isin(*stop))) > 0) if stop else candidates
    best = vector_index.nearest(some.select(F.col("gram").alias("key")).distinct(), labels.select(F.col("label_key").alias("label")).distinct(), least)
    return some.join(best.withColumnRenamed("key", "gram"), "gram").join(labels.withColumnRenamed("label_key", "label"), "label").select("doc_id", "start", "end", "gram", "label", "iri", "similarity")


def fill_class_iris(links: DataFrame, winners: DataFrame, concepts: DataFrame) -> DataFrame:
    """Class links (..., label, iri, branch) without a concept get the one that has their label, and its branch if they have none."""
    known = winners.select("label_key", F.col("iri").alias("_iri")).join(concepts.select(F.col("iri").alias("_iri"), F.col("branch").alias("_branch")), "_iri", "left")
    missing = F.coalesce(F.col("iri"), F.lit("")) == ""
    out = links.withColumn("label_key", F.lower("label")).join(known, "label_key", "left")
    filled = missing & F.col("_iri").isNotNull()
    return out.withColumns({"iri": F.when(filled, F.col("_iri")).otherwise(F.col("iri")), "branch": F.when(filled & (F.coalesce(F.col("branch"), F.lit("")) == ""), F.col("_branch")).otherwise(F.col("branch"))}).drop("label_key", "_iri", "_branch")


def attach(matches: DataFrame, existing: DataFrame) -> DataFrame:
    """Matches (doc_id, start, end, text, iri, confidence) joined to annotations (doc_id, ann_id, start, end, text, iri, state):
    by span and concept, else by span and text, else new; rejected annotations whose span has no match stay."""
    by_iri = existing.groupBy("doc_id", "start", "end", "iri").agg(F.min("ann_id").alias("a1"), F.min_by("state", "ann_id").alias("s1"))
    by_text = existing.groupBy("doc_id", "start", "end", "text").agg(F.min("ann_id").alias("a2"), F.min_by("state", "ann_id").alias("s2"))
    out = matches.join(by_iri, ["doc_id", "start", "end", "iri"], "left").join(by_text, ["doc_id", "start", "end", "text"], "left")
    fresh = F.substring(F.sha2(F.concat_ws("|", "doc_id", "start", "end", "iri"), 256), 1, 16)
    done = out.select("doc_id", F.coalesce("a1", "a2", fresh).alias("ann_id"), "start", "end", "text", "iri", F.coalesce("s1", "s2", F.lit("confirmed")).alias("state"))
    gone = existing.where("state = 'rejected'").join(matches.select("doc_id", "start", "end").distinct(), ["doc_id", "start", "end"], "left_anti")
    return done.unionByName(gone.select("doc_id", "ann_id", "start", "end", "text", "iri", "state"))


def split_by_confidence(individuals: DataFrame, cut: float = LOW_CONFIDENCE) -> DataFrame:
    """(doc_id, kind, high, low): distinct names by first appearance, on either side of the cut."""
    first = individuals.groupBy("doc_id", "kind", F.lower("name").alias("k")).agg(F.min_by("name", "start").alias("name"), F.min("start").alias("start"), F.max("confidence").alias("confidence"))
    pick = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("start", "name")))), lambda x: x["name"]), "; ")
    return first.groupBy("doc_id", "kind").agg(pick(F.col("confidence") >= cut).alias("high"), pick(F.col("confidence") < cut).alias("low"))


#: Metadata fields and the words before a span that hint at them, in order.
HINTS = (("court", r"(?i)court|tribunal"), ("judge", r"(?i)judge|justice"), ("date_filed", r"(?i)filed|dated"), ("author", r"(?i)\bby\b|author"))


def promotions(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, field, value): first span (doc_id, start, end, mention) whose 50 characters before it hint at the field."""
    before = F.substring(F.col("text"), F.greatest(F.col("start") - 49, F.lit(1)), F.least(F.col("start"), F.lit(50)))
    hinted = spans.join(docs.select("doc_id", "text"), "doc_id").withColumn("field", F.coalesce(*[F.when(before.rlike(p), F.lit(f)) for f, p in HINTS]))
    return hinted.where("field IS NOT NULL").groupBy("doc_id", "field").agg(F.min_by("mention", F.struct("start", "end")).alias("value"))
