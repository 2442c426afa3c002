"""Annotated pages and standoff files: spans of annotations, individuals and properties together with triples.

annotations and ann_concepts as in ``export``; concepts may have a ``definition``. individuals: (doc_id, start, end, mention, name,
kind, iri, label); properties: (doc_id, start, end, text, iri, label, definition); triples: (doc_id, subject, predicate, object,
s_start, s_end, o_start, o_end, voice, confidence, linked). Everything is native; a document's spans are gathered by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of the blocks in which a text is read, so that a mark costs a block and not the text before it.
BLOCK = 4096
SPAN = "struct<e: int, ord: int, open: string, close: string>"
STATE = f"struct<stack: array<{SPAN}>, out: array<struct<pos: int, piece: string>>>"


def escaped(c: Column | str) -> Column:
    swaps = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), swaps, F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string"))


def marked_text(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, body): each text escaped, with ``open`` and ``close`` of its ``spans`` (doc_id, start, end, ord, open, close) as nested elements.

    Elements open in order of start, the longer first, then by ``ord`` and tag. Where one ends inside another that began
    later, the later one is closed and opened again. The sweep goes over the boundaries of a document in order and holds the
    open elements; boundaries are gathered in one shuffle by document, which both groupings share. Spans without
    characters or without bounds are left out, those that reach over an end of the text are cut there; null texts are
    empty, and repeated documents are each marked.
    """
    some = spans.where("end > start AND end > 0").select("doc_id", F.greatest("start", F.lit(0)).cast("int").alias("start"), F.struct((-F.col("end")).cast("int").alias("e"), F.col("ord").cast("int").alias("ord"), "open", "close").cast(SPAN).alias("s"))
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    ends = F.array(F.struct(F.col("start").alias("pos"), F.array("s").alias("opens")), F.struct((-F.col("s.e")).alias("pos"), none.alias("opens")))
    events = some.repartition("doc_id").select("doc_id", F.explode(ends).alias("x")).groupBy("doc_id", F.col("x.pos").alias("pos")).agg(F.sort_array(F.flatten(F.collect_list("x.opens"))).alias("opens"))
    events = events.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "opens")).alias("events"))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(events, "doc_id", "left").withColumn("n", F.length("text"))
    starts = F.sequence(F.lit(0), F.floor(F.col("n") / BLOCK).cast("int"))
    blocks = F.transform(starts, lambda i: F.substring("text", i * BLOCK + 1, F.lit(BLOCK)))
    own = F.filter(F.coalesce("events", F.expr(f"CAST(array() AS array<struct<pos: int, opens: array<{SPAN}>>>)")), lambda v: v["pos"] < F.col("n"))
    stops = F.transform(F.array_append(F.transform(starts, lambda i: i * BLOCK), F.col("n")), lambda p: F.struct(p.alias("pos"), none.alias("opens")))

    def step(t: Column, v: Column) -> Column:
        stack, over = t["stack"], lambda s: (-s["e"] > v["pos"]) & (v["pos"] < F.col("n"))  # at the end of the text all are closed
        first = F.array_position(F.transform(stack, lambda s: ~over(s)), True)
        kept = F.when(first == 0, F.size(stack)).otherwise(first - 1).cast("int")
        off = F.slice(stack, kept + 1, F.size(stack))
        on = F.concat(F.filter(off, over), F.filter(v["opens"], over))
        piece = F.concat(F.array_join(F.reverse(F.transform(off, lambda s: s["close"])), ""), F.array_join(F.transform(on, lambda s: s["open"]), ""))
        return F.struct(F.concat(F.slice(stack, 1, kept), on).alias("stack"), F.array_append(t["out"], F.struct(v["pos"].alias("pos"), piece.alias("piece"))).alias("out")).cast(STATE)

    begin = F.struct(none.alias("stack"), F.expr("CAST(array() AS array<struct<pos: int, piece: string>>)").alias("out")).cast(STATE)
    swept = text.select("doc_id", blocks.alias("blocks"), F.aggregate(F.array_sort(F.concat(own, stops)), begin, step)["out"].alias("out"))

    def piece(m: Column, i: Column) -> Column:
        past = F.when(i == 0, F.lit(0)).otherwise(F.element_at("out", i)["pos"])
        block = F.element_at("blocks", F.floor(past / BLOCK).cast("int") + 1)
        return F.concat(escaped(F.substring(block, past % BLOCK + 1, m["pos"] - past)), m["piece"])

    return swept.select("doc_id", F.array_join(F.transform("out", piece), "").alias("body"))


def concept_spans(annotations: DataFrame, concepts: DataFrame) -> DataFrame:
    """A link for each annotation's first concept; the border tells the confidence."""
    if "definition" not in concepts.columns:
        concepts = concepts.withColumn("definition", F.lit(None).cast("string"))
    first = annotations.select("doc_id", "ann_id", "start", "end", "text").join(concepts.where("rank = 0").drop("state", "rank"), "ann_id")
    c = F.col("confidence")
    border = F.when(c >= 0.90, "#228B22").when(c >= 0.60, "#FFD700").when(c >= 0.45, "#FF8C00").otherwise("#D3D3D3")  # fixed values
    branch = F.coalesce("branch", F.lit(""))
    title = F.concat(F.coalesce("label", "text"), F.when(branch == "", "").otherwise(F.concat(F.lit(" ("), branch, F.lit(")"))), F.lit(" - "), F.coalesce("definition", F.lit("No definition")))
    link = F.when(F.coalesce("iri", F.lit("")) == "", "#").otherwise(F.concat(escaped("iri"), F.lit("/html")))
    iri = F.when(F.coalesce("iri", F.lit("")) == "", "#").otherwise(escaped("iri"))
    tag = F.concat(
        F.lit('<span class="annotation" style="border-bottom-color: '), border, F.lit(';" data-iri="'), iri, F.lit('" data-branch="'), escaped(branch), F.lit('" data-confidence="'),
        F.format_string("%.2f", c), F.lit('"><a href="'), link, F.lit('" title="'), escaped(title), F.lit('">'),
    )
    return first.select("doc_id", "start", "end", F.lit(0).alias("ord"), tag.alias("open"), F.lit("</a></span>").alias("close"))


def individual_spans(individuals: DataFrame) -> DataFrame:
    border = F.when(F.col("kind") == "legal_citation", "#009688").otherwise("#FF9800")  # fixed values
    title = F.concat("name", F.lit(" ("), F.coalesce("label", "kind"), F.lit(")"))
    tag = F.concat(F.lit('<span class="individual" style="border-top: 2px solid '), border, F.lit(';" data-individual-type="'), escaped("kind"), F.lit('" title="'), escaped(title), F.lit('">'))
    return individuals.select("doc_id", "start", "end", F.lit(1).alias("ord"), tag.alias("open"), F.lit("</span>").alias("close"))


def property_spans(properties: DataFrame) -> DataFrame:
    iri = F.when(F.coalesce("iri", F.lit("")) == "", "#").otherwise(escaped("iri"))
    title = F.concat(F.coalesce("label", "text"), F.lit(" - "), F.coalesce("definition", F.lit("Object property")))
    tag = F.concat(F.lit('<span class="property" style="text-decoration: underline wavy;" data-iri="'), iri, F.lit('" title="'), escaped(title), F.lit('">'))
    return properties.select("doc_id", "start", "end", F.lit(2).alias("ord"), tag.alias("open"), F.lit("</span>").alias("close"))


def triples_table(triples: DataFrame) -> DataFrame:
    """(doc_id, rows): the rows of a document's table of triples, by place of the subject."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell(escaped("subject")), cell(escaped("predicate")), cell(escaped("object")), cell(escaped("voice")), cell(F.format_string("%.2f", "confidence")), cell(F.when(F.col("linked"), "✓").otherwise("")), F.lit("</tr>"))
    t = triples.select("doc_id", F.struct("s_start", "o_start", row.alias("row")).alias("r")).groupBy("doc_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    head = F.concat(F.lit("<h2>Extracted triples ("), F.size("r").cast("string"), F.lit(")</h2><table><tr><th>Subject</th><th>Predicate</th><th>Object</th><th>Voice</th><th>Confidence</th><th>Linked</th></tr>"))
    return t.select("doc_id", F.concat(head, F.array_join(F.transform("r", lambda r: r["row"]), ""), F.lit("</table>")).alias("rows"))


def to_page(docs: DataFrame, annotations: DataFrame, concepts: DataFrame, individuals: DataFrame | None = None, properties: DataFrame | None = None, triples: DataFrame | None = None) -> DataFrame:
    """(doc_id, value): a page for each document."""
    spans = concept_spans(annotations, concepts)
    if individuals is not None:
        spans = spans.unionByName(individual_spans(individuals))
    if properties is not None:
        spans = spans.unionByName(property_spans(properties))
    body, table = marked_text(docs, spans), F.lit("")
    if triples is not None:
        body, table = body.join(triples_table(triples), "doc_id", "left"), F.coalesce("rows", F.lit(""))
    head = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Annotated document</title></head><body><pre style="white-space: pre-wrap;">'
    return body.select("doc_id", F.concat(F.lit(head), "body", F.lit("</pre>"), table, F.lit("</body></html>")).alias("value"))


ITEM = "array<struct<label: string, start: int, end: int, text: string>>"
FACTS = "array<struct<name: string, value: string>>"


def to_standoff(annotations: DataFrame, concepts: DataFrame, individuals: DataFrame | None = None, properties: DataFrame | None = None, triples: DataFrame | None = None) -> DataFrame:
    """(doc_id, n, value): lines of a document's brat file. Text lines (T), attributes (A) and relations (R) are numbered through all sections.

    Sections are annotations, individuals, properties, triples, each in order of place; an attribute stands after the line it
    is of. An annotation has the name and label of each of its concepts, an individual its name where that is not its
    mention, and its class, a property its own; a triple gives two text lines and a relation. Only triples with both places count.
    """
    tag = lambda c: F.regexp_replace(c, " ", "_")
    line = lambda label, start, end, text: F.struct(label.alias("label"), F.col(start).cast("int").alias("start"), F.col(end).cast("int").alias("end"), F.col(text).alias("text"))
    fact = lambda name, c: F.struct(F.lit(name).alias("name"), c.alias("value"))
    facts = lambda *f: F.filter(F.array(*f), lambda x: F.coalesce(x["value"], F.lit("")) != "").cast(FACTS)
    own = concepts.groupBy("ann_id").agg(F.sort_array(F.collect_list(F.struct("rank", "iri", "label", "branch"))).alias("c"))
    named = F.flatten(F.transform("c", lambda c: facts(fact("IRI", c["iri"]), fact("Label", c["label"]))))
    branch = F.coalesce(F.get("c", F.lit(0))["branch"], F.lit(""))
    no, shape = F.expr(f"CAST(array() AS {FACTS})"), ("doc_id", "section", "id", "lines", "facts", "relation")
    none = F.lit(None).cast("string")
    parts = [annotations.join(own, "ann_id", "left").select("doc_id", F.lit(0).alias("section"), F.col("ann_id").cast("string").alias("id"), F.array(line(F.when(branch == "", "CONCEPT").otherwise(tag(branch)), "start", "end", "text")).cast(ITEM).alias("lines"), F.coalesce(named, no).cast(FACTS).alias("facts"), none.alias("relation"))]
    if individuals is not None:
        label = F.when(F.coalesce("label", F.lit("")) == "", tag(F.upper("kind"))).otherwise(tag(F.col("label")))
        about = facts(fact("CanonicalName", F.when(F.col("name") != F.col("mention"), F.col("name"))), fact("IRI", F.col("iri")))
        parts.append(individuals.select("doc_id", F.lit(1).alias("section"), F.col("name").alias("id"), F.array(line(label, "start", "end", "mention")).cast(ITEM).alias("lines"), about.alias("facts"), none.alias("relation")))
    if properties is not None:
        label = tag(F.when(F.coalesce("label", F.lit("")) == "", "PROPERTY").otherwise(F.col("label")))
        parts.append(properties.select("doc_id", F.lit(2).alias("section"), F.col("text").alias("id"), F.array(line(label, "start", "end", "text")).cast(ITEM).alias("lines"), facts(fact("IRI", F.col("iri"))).alias("facts"), none.alias("relation")))
    if triples is not None:
        two = F.array(line(F.lit("TRIPLE_SUBJECT"), "s_start", "s_end", "subject"), line(F.lit("TRIPLE_OBJECT"), "o_start", "o_end", "object")).cast(ITEM)
        placed = triples.where("s_start IS NOT NULL AND s_end IS NOT NULL AND o_start IS NOT NULL AND o_end IS NOT NULL")
        parts.append(placed.select("doc_id", F.lit(3).alias("section"), F.col("predicate").alias("id"), two.alias("lines"), no.alias("facts"), tag(F.coalesce("predicate", F.lit(""))).alias("relation")))
    items = reduce(DataFrame.unionByName, [p.select(*shape) for p in parts])
    order = Window.partitionBy("doc_id").orderBy("section", F.col("lines")[0]["start"], F.desc(F.col("lines")[0]["end"]), "id", "lines", "facts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    lines = items.withColumns({"k": F.row_number().over(order), "t": count(F.size("lines")), "a": count(F.size("facts")), "r": count(F.col("relation").isNotNull().cast("int"))})
    texts = F.transform("lines", lambda x, i: F.concat(F.lit("T"), F.col("t") + i + 1, F.lit("\t"), x["label"], F.lit(" "), x["start"], F.lit(" "), x["end"], F.lit("\t"), F.coalesce(x["text"], F.lit(""))))
    about = F.transform("facts", lambda x, i: F.concat(F.lit("A"), F.col("a") + i + 1, F.lit("\t"), x["name"], F.lit(" T"), F.col("t") + 1, F.lit(" "), x["value"]))
    tie = F.when(F.col("relation").isNull(), F.expr("CAST(array() AS array<string>)")).otherwise(F.array(F.concat(F.lit("R"), F.col("r") + 1, F.lit("\t"), "relation", F.lit(" Arg1:T"), F.col("t") + 1, F.lit(" Arg2:T"), F.col("t") + 2)))
    start = F.col("t") + F.col("a") + F.col("r")
    return lines.select("doc_id", start.alias("start"), F.posexplode(F.concat(texts, about, tie)).alias("i", "value")).select("doc_id", (F.col("start") + F.col("i") + 1).alias("n"), "value")
