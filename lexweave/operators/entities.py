"""Typed entities by regular expressions, their deduplication and class links.

Native extraction marks matches with sentinels and sums piece lengths, so offsets are code points; patterns whose
repetition could exhaust the JVM's stack run in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Entity(NamedTuple):
    kind: str
    label: str
    confidence: float
    pattern: str
    ignore_case: bool = True
    least: int = 1

    @property
    def flags(self) -> str:
        return "(?iuU)" if self.ignore_case else "(?U)"


#: Entity patterns, class labels, confidences and least lengths, in the order in which they run.
ENTITIES = (
    Entity(
        "monetary_amount", "Monetary Amount", 0.93,
        r"[$€£¥₹]\s*[\d,]+(?:\.\d+)?\s*(?:(?:hundred|thousand|million|billion|trillion|[KMBTkmbt])(?:\s+dollars?)?)?"
        r"|[\d,]+(?:\.\d+)?\s*(?:dollars?|cents?|USD|EUR|GBP|JPY)"
        r"|(?:(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty"
        r"|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|trillion)[\s-]*)+(?:dollars?|cents?|pounds?|euros?)",
        True, 2,
    ),
    Entity(
        "date", "Date", 0.92,
        r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+\d{1,2},?\s+\d{4}"
        r"|\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+\d{4}"
        r"|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2}"
        r"|the\s+\d{1,2}(?:st|nd|rd|th)\s+day\s+of\s+(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?,?\s+\d{4}",
    ),
    Entity(
        "duration", "Duration", 0.90,
        r"(?:\d+(?:\.\d+)?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|twenty|thirty|sixty|ninety)"
        r"(?:\s*\(\d+\))?\s+(?:second|minute|hour|day|week|month|year|decade)s?",
    ),
    Entity(
        "percentage", "Percentage", 0.93,
        r"\d+(?:\.\d+)?\s*%|(?:one|two|three|four|five|six|seven|eight|nine|ten|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred)\s+percent"
        r"|\d+(?:\.\d+)?\s+basis\s+points?",
    ),
    Entity(
        "court", "Court", 0.91,
        r"Supreme Court of (?:the United States|[A-Z][a-z]+(?: [A-Z][a-z]+)*)|United States (?:District|Circuit|Bankruptcy|Tax) Court"
        r"|(?:First|Second|Third|Fourth|Fifth|Sixth|Seventh|Eighth|Ninth|Tenth|Eleventh|D\.?C\.?) Circuit|[SNWCE]\.D\.\s*[A-Z][a-z]+\.?"
        r"|Court of (?:Appeals?|Common Pleas|Claims|Chancery)(?:\s+(?:for|of)\s+[\w\s]+)?"
        r"|(?:Superior|District|Circuit|Appellate|Family|Probate|Surrogate(?:'s)?|Municipal|Juvenile|Small Claims) Court(?:\s+(?:of|for)\s+[\w\s]+)?",
    ),
    Entity(
        "definition", "Definition", 0.88,
        r"[\"\x{201C}]([A-Z][\w\s]{1,60}?)[\"\x{201D}]\s+(?:means?|shall mean|is defined as|refers to|shall refer to|has the meaning|hereby defined as)",
    ),
    Entity(
        "condition", "Condition", 0.85,
        r"\b(?:if|unless|provided\s+that|subject\s+to|on\s+(?:the\s+)?condition\s+that|in\s+the\s+event\s+(?:that)?|notwithstanding|except\s+(?:that|where|when|as)|contingent\s+upon)\b",
    ),
    Entity(
        "constraint", "Constraint", 0.85,
        r"\b(?:no\s+more\s+than|no\s+less\s+than|no\s+fewer\s+than|at\s+least|at\s+most|not\s+to\s+exceed|(?:shall|must|will)\s+not\s+exceed"
        r"|up\s+to\s+(?:and\s+including\s+)?\w|a\s+maximum\s+of|a\s+minimum\s+of|not\s+(?:more|less|fewer)\s+than)\b",
    ),
    Entity(
        "address", "Address", 0.87,
        r"\d{1,5}\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*\s+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Drive|Dr|Lane|Ln|Way|Court|Ct|Place|Pl|Circle|Cir|Terrace|Ter|Pike|Highway|Hwy)\.?"
        r"(?:,?\s+(?:Suite|Ste|Apt|Unit|Floor|Fl|Room|Rm)\.?\s*\d+)?(?:,?\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)?(?:,?\s+[A-Z]{2})?(?:\s+\d{5}(?:-\d{4})?)?",
        False, 10,
    ),
    Entity("trademark", "Trademark", 0.93, r"[\w]+(?:\s+[\w]+)*\s*[®™]", False),
    Entity("copyright", "Copyright", 0.93, r"(?:©|Copyright\s*(?:\(c\)|©)?)\s*\d{4}(?:\s*[-–]\s*\d{4})?(?:\s+[A-Z][\w\s,&.]+)?"),
)
BY_KIND = {e.kind: e for e in ENTITIES}
#: Of these one is in every text that a pattern matches, whatever its case; ``DIGIT`` stands for any digit.
DIGIT = "0-9"
NEEDS = {
    "monetary_amount": ("$", "€", "£", "¥", "₹", "dollar", "cent", "usd", "eur", "gbp", "jpy", "pound"),
    "date": (DIGIT,),
    "duration": ("second", "minute", "hour", "day", "week", "month", "year", "decade"),
    "percentage": ("%", "percent", "basis"),
    "court": ("court", "circuit", ".d."),
    "definition": ('"', "“", "”"),
    "condition": ("if", "unless", "provided", "subject", "condition", "event", "notwithstanding", "except", "contingent"),
    "constraint": ("than", "least", "most", "exceed", "up", "maximum", "minimum"),
    "address": (DIGIT,),
    "copyright": ("©", "copyright"),
}
#: Order of trust of the sources of individuals.
PRIORITY = {"eyecite": 100, "citeurl": 95, "regex": 80, "spacy": 70, "llm": 50}


def spans(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(doc_id, kind, start, end, whole): matches of each pattern, in one scan and without a shuffle.

    Each text is marked and cut once by pattern; starts are running sums of the pieces' lengths. Null texts and texts
    without a match give no rows; repeated rows give their own. The marks are control characters, which no pattern matches.
    A pattern runs over texts that hold one of its ``NEEDS``, which is a plain search; the characters that fold to other
    letters than their small ones are set right first, as patterns that ignore case take them.
    """
    text = F.translate("text", "\u0001\u0002", "\u0003\u0003")
    held = docs.where(F.col("text").isNotNull()).select("doc_id", text.alias("text"), F.lower(F.translate("text", "ſıİ\u212a", "siik")).alias("_low"))

    def needed(kind: str) -> Column:
        tests = [F.col("text").rlike(r"(?U)\d") if n == DIGIT else F.col("_low").contains(n) for n in NEEDS.get(kind, ("",))]
        return reduce(Column.__or__, tests)

    cut = [F.when(needed(kind), F.struct(F.lit(kind).alias("kind"), F.split(F.regexp_replace("text", p, "\u0001$1\u0002"), "\u0001").alias("pieces"))) for kind, p in patterns.items()]
    some = held.select("doc_id", F.explode(F.filter(F.array(*cut), lambda c: c.isNotNull() & (F.size(c["pieces"]) > 1))).alias("c"))
    none = F.struct(F.lit(1).alias("at"), F.expr("CAST(array() AS array<struct<start: int, whole: string>>)").alias("out"))

    def step(t, piece):
        own = F.struct(t["at"].alias("start"), F.substring_index(piece, "\u0002", 1).alias("whole"))
        return F.struct((t["at"] + F.length(piece) - 1).alias("at"), F.concat(t["out"], F.array(own)).alias("out"))

    found = some.select("doc_id", F.col("c.kind").alias("kind"), F.posexplode(F.aggregate("c.pieces", none, step)["out"]).alias("i", "m")).where("i > 0")
    return found.select("doc_id", "kind", F.col("m.start").alias("start"), (F.col("m.start") + F.length("m.whole")).alias("end"), F.col("m.whole").alias("whole"))


def extract(docs: DataFrame, *wanted: Entity) -> DataFrame:
    """(doc_id, start, end, mention, name, kind, label, confidence): matches of the patterns; a definition's name is the defined term."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    of = lambda get: F.coalesce(*[F.when(F.col("kind") == e.kind, F.lit(get(e))) for e in wanted])
    found = spans(docs, {e.kind: f"{e.flags}({e.pattern})" for e in wanted}).withColumn("mention", trim(F.col("whole")))
    term = BY_KIND["definition"]
    name = F.when(F.col("kind") == term.kind, trim(F.regexp_extract("whole", term.flags + term.pattern, 1))).otherwise(F.col("mention"))
    out = found.select("doc_id", "start", "end", "mention", name.alias("name"), "kind", of(lambda e: e.label).alias("label"), of(lambda e: e.confidence).alias("confidence"))
    return out.where(F.length("mention") >= of(lambda e: e.least))


def extract_trademarks(docs: DataFrame) -> DataFrame:
    """Words before ® or ™, in Python: the pattern's nested repetition is too deep for the JVM on long texts."""
    mark = BY_KIND["trademark"]
    pattern = re.compile(mark.pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows.extend((doc, m.start(), m.end(), m.group().strip(), m.group().strip(), mark.kind, mark.label, mark.confidence) for m in pattern.finditer(text))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "end", "mention", "name", "kind", "label", "confidence"])

    marked = docs.where(F.col("text").contains("®") | F.col("text").contains("™")).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return marked.mapInArrow(run, "doc_id bigint, start int, end int, mention string, name string, kind string, label string, confidence double")


def extract_all(docs: DataFrame) -> DataFrame:
    return extract(docs, *[e for e in ENTITIES if e.kind != "trademark"]).unionByName(extract_trademarks(docs))


def merge_individuals(rows: list[dict]) -> list[dict]:
    """Order by source priority, then start; a row joins the first kept one that overlaps it, or whose name contains its name or is in it."""
    kept: list[dict] = []
    for r in sorted(rows, key=lambda r: (-PRIORITY.get(r["source"], 0), r["start"], r["name"])):
        name = r["name"].lower().strip()
        for k in kept:
            other = k["name"].lower().strip()
            near = r["start"] < k["end"] and k["start"] < r["end"]
            if near or name == other or (name and other and (name in other or other in name)) or r["mention"] == k["mention"]:
                k["n_merged"] += 1
                if k["source"] != r["source"]:
                    k["source"] = "hybrid"
                k["url"] = k["url"] or r["url"]
                break
        else:
            kept.append({**r, "n_merged": 1})
    return kept


def dedup_individuals(individuals: DataFrame) -> DataFrame:
    """Individuals (doc_id, name, mention, start, end, source, url) merged within each document; the match is neither symmetric in effect nor transitive."""
    import pandas as pd

    schema = "doc_id bigint, name string, mention string, start int, end int, source string, url string, n_merged int"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = merge_individuals(frame.where(frame.notna(), None).to_dict("records"))
        return pd.DataFrame(rows)[["doc_id", "name", "mention", "start", "end", "source", "url", "n_merged"]]

    return individuals.groupBy("doc_id").applyInPandas(run, schema)
