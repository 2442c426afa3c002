"""Export formats over the annotation tables.

annotations: (doc_id, ann_id, start, end, text, state); ann_concepts: (ann_id, rank, iri, label, branch, confidence, state).
Rejected annotations are left out unless asked for. Text formats are DataFrames of lines, ready for a writer.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from functools import reduce
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions.spans import inside
from lexweave.sinks.markup import to_page

BASE = "urn:lexweave:"


def live(annotations: DataFrame, include_dismissed: bool = False) -> DataFrame:
    return annotations if include_dismissed else annotations.where("state <> 'rejected'")


def exploded(annotations: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row per annotation and concept, in order of rank."""
    return annotations.select("doc_id", "ann_id", "start", "end", "text").join(concepts.drop("state"), "ann_id")


def to_json_documents(annotations: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc_id, value): nested JSON with statistics; null fields are left out."""
    own = concepts.groupBy("ann_id").agg(F.sort_array(F.collect_list(F.struct("rank", "iri", "label", "branch", "confidence"))).alias("concepts"))
    a = annotations.join(own, "ann_id", "left")
    iris = F.size(F.array_distinct(F.flatten(F.collect_list(F.transform("concepts", lambda c: c["iri"])))))
    rows = F.sort_array(F.collect_list(F.struct("start", "end", "ann_id", "text", "concepts")))
    docs = a.groupBy("doc_id").agg(rows.alias("annotations"), F.count("*").alias("n"), iris.alias("distinct_concepts"))
    return docs.select("doc_id", F.to_json(F.struct("doc_id", "annotations", F.struct(F.col("n").alias("annotations"), "distinct_concepts").alias("statistics"))).alias("value"))


def to_jsonld(annotations: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc_id, value): an oa:Annotation for each annotation and concept."""
    e = exploded(annotations, concepts)
    target = F.struct(F.concat(F.lit(f"{BASE}doc/"), "doc_id").alias("source"), F.struct(F.lit("oa:TextPositionSelector").alias("@type"), "start", "end").alias("selector"))
    node = F.struct(F.lit("oa:Annotation").alias("@type"), F.concat(F.lit(f"{BASE}ann/"), "ann_id").alias("@id"), F.col("iri").alias("oa:hasBody"), target.alias("oa:hasTarget"), "confidence")
    return e.select("doc_id", F.to_json(node).alias("value"))


def to_csv_rows(annotations: DataFrame, concepts: DataFrame) -> DataFrame:
    return exploded(annotations, concepts).select("doc_id", "ann_id", "start", "end", "text", "rank", "iri", "label", "branch", F.format_string("%.4f", "confidence").alias("confidence"))


def to_jsonl(annotations: DataFrame, concepts: DataFrame) -> DataFrame:
    row = lambda kind, df, *cols: df.select(F.to_json(F.struct(F.lit(kind).alias("record_type"), *cols)).alias("value"))
    return row("annotation", annotations, "doc_id", "ann_id", "start", "end", "text", "state").unionByName(row("concept", concepts, "ann_id", "rank", "iri", "label", "confidence"))


def to_bulk(annotations: DataFrame, concepts: DataFrame, individuals: DataFrame | None = None, properties: DataFrame | None = None, triples: DataFrame | None = None) -> DataFrame:
    """(id, k, value): action and document lines by turns for bulk loading into a search engine, an index for each kind.

    A document for each annotation and concept; for individuals, properties and triples (each with ``id``) one of all their columns.
    """
    main = exploded(annotations, concepts).select(F.concat_ws("-", "ann_id", "rank").alias("id"), "doc_id", "start", "end", "text", "iri", "label", "branch", "confidence")
    parts = [("annotations", main), ("individuals", individuals), ("properties", properties), ("triples", triples)]
    lines = [
        df.select("id", F.posexplode(F.array(F.lit(f'{{"index":{{"_index":"{index}"}}}}'), F.to_json(F.struct(*[c for c in df.columns if c != "id" or index != "annotations"])))).alias("k", "value"))
        for index, df in parts if df is not None
    ]
    return reduce(DataFrame.unionByName, lines)


def to_property_graph(
    annotations: DataFrame, concepts: DataFrame, individuals: DataFrame | None = None, classes: DataFrame | None = None, properties: DataFrame | None = None, triples: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations): each node once; relations to concepts only where the concept is a node.

    individuals (id, name) with classes (id, iri); properties (id, name, domain_iri, range_iri); triples (subject, predicate, object) of node ids.
    """
    e = exploded(annotations, concepts)
    known = e.groupBy(F.col("iri").alias("id")).agg(F.min("label").alias("name"))
    nodes = known.select("id", "name", F.lit("Concept").alias("kind")).unionByName(annotations.select(F.col("ann_id").alias("id"), F.col("text").alias("name"), F.lit("Annotation").alias("kind")))
    link = lambda df, src, dst, kind: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"))
    loose = []
    if individuals is not None:
        nodes = nodes.unionByName(individuals.select("id", "name", F.lit("Individual").alias("kind")))
    if classes is not None:
        loose.append(link(classes, "id", "iri", "INSTANCE_OF"))
    if properties is not None:
        nodes = nodes.unionByName(properties.select("id", "name", F.lit("Property").alias("kind")).distinct())
        loose += [link(properties, "id", "domain_iri", "HAS_DOMAIN"), link(properties, "id", "range_iri", "HAS_RANGE")]
    relations = link(e, "ann_id", "iri", "REFERS_TO").distinct()
    if loose:
        relations = relations.unionByName(reduce(DataFrame.unionByName, loose).distinct().join(known.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "kind"))
    if triples is not None:
        named = triples.where("subject IS NOT NULL AND object IS NOT NULL")
        relations = relations.unionByName(named.select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.regexp_replace(F.upper("predicate"), " ", "_").alias("kind")).distinct())
    return nodes, relations


def to_rag(chunks: DataFrame, annotations: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, n_items, items): annotations that lie inside each chunk; chunks without any have 0."""
    a = annotations.select("doc_id", "ann_id", "start", "end", F.col("text").alias("mention"))
    met = inside(chunks.select("doc_id", "chunk_index", F.col("start_offset").alias("lo"), F.col("end_offset").alias("hi")), a)
    found = met.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.struct("start", "end", "mention"))).alias("items"))
    out = chunks.select("doc_id", "chunk_index").join(found, ["doc_id", "chunk_index"], "left")
    return out.fillna(0, ["n_items"]).withColumn("items", F.coalesce("items", F.expr("CAST(array() AS array<struct<start: int, end: int, mention: string>>)")))


def literal(c: Column) -> Column:
    """A quoted literal: backslashes first, then quotes, line feeds, carriage returns and tabs."""
    for char, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(char), F.lit(shown))
    return F.concat(F.lit('"'), c, F.lit('"'))


def to_ntriples(annotations: DataFrame, concepts: DataFrame) -> DataFrame:
    e = exploded(annotations, concepts)
    s = F.concat(F.lit(f"<{BASE}ann/"), "ann_id", F.lit("> "))
    lines = F.array(
        F.concat(s, F.lit("<http://www.w3.org/ns/oa#hasBody> <"), "iri", F.lit("> .")),
        F.concat(s, F.lit("<http://www.w3.org/ns/oa#exact> "), literal(F.col("text")), F.lit(" .")),
    )
    return e.select("doc_id", F.explode(lines).alias("value")).distinct()


def to_brat(annotations: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc_id, n, value): numbered T lines by document."""
    first = exploded(annotations, concepts).where("rank = 0")
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "ann_id")
    n = F.row_number().over(w)
    return first.select("doc_id", n.alias("n"), F.concat(F.lit("T"), n, F.lit("\t"), F.regexp_replace("branch", r"\s+", "_"), F.lit(" "), "start", F.lit(" "), "end", F.lit("\t"), "text").alias("value"))


def to_xml(annotations: DataFrame, concepts: DataFrame) -> DataFrame:
    """(doc_id, value): one element per annotation and concept."""
    x = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    attrs = [p for c in ("ann_id", "start", "end", "iri", "confidence") for p in (F.lit(f' {c}="'), x(c), F.lit('"'))]
    return exploded(annotations, concepts).select("doc_id", F.concat(F.lit("<annotation"), *attrs, F.lit(">"), x("text"), F.lit("</annotation>")).alias("value"))


def xlsx(sheets: dict[str, list[list]]) -> bytes:
    """A minimal workbook with inline strings, by the standard library."""
    out, names = io.BytesIO(), list(sheets)
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        for k, name in enumerate(names, 1):
            rows = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for v in row) + "</row>" for row in sheets[name])
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.90, "high").when(c >= 0.60, "medium").when(c >= 0.45, "low").otherwise("weak")


def to_tables(annotations: DataFrame, concepts: DataFrame, individuals: DataFrame | None = None, properties: DataFrame | None = None, triples: DataFrame | None = None) -> dict[str, DataFrame]:
    """Four flat tables, each to be written as a data set of its own."""
    tables = {"annotations": exploded(annotations, concepts), "individuals": individuals, "properties": properties, "triples": triples}
    return {name: df for name, df in tables.items() if df is not None}


def to_excel(annotations: DataFrame, concepts: DataFrame, individuals: DataFrame | None = None, properties: DataFrame | None = None, triples: DataFrame | None = None) -> DataFrame:
    """(doc_id, value): a workbook for each document, a sheet for each of the four tables that has rows for it, with the band of each confidence."""
    books = None
    for name, df in to_tables(annotations, concepts, individuals, properties, triples).items():
        cols = [c for c in df.columns if c not in ("doc_id", "band")]
        banded = df.withColumn("band", confidence_band(F.col("confidence"))) if "confidence" in cols else df
        shown = [*cols, "band"] if "confidence" in cols else cols
        row = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in shown])
        first = [c for c in ("start", "end") if c in cols]
        rows = F.transform(F.sort_array(F.collect_list(F.struct(*first, row.alias("row")))), lambda x: x["row"])
        sheet = banded.groupBy("doc_id").agg(F.concat(F.array(F.array(*[F.lit(c) for c in shown])), rows).alias(name))
        books = sheet if books is None else books.join(sheet, "doc_id", "full_outer")
    names = [c for c in books.columns if c != "doc_id"]

    @F.pandas_udf("binary")
    def workbook(sheets: pd.DataFrame) -> pd.Series:
        return pd.Series([xlsx({n: [list(r) for r in rows] for n, rows in zip(sheets.columns, book, strict=True) if rows is not None}) for book in sheets.itertuples(index=False)])

    return books.select("doc_id", workbook(F.struct(*names)).alias("value"))


EXPORTERS: dict[str, Callable] = {
    "json": to_json_documents, "jsonld": to_jsonld, "csv": to_csv_rows, "jsonl": to_jsonl, "elasticsearch": to_bulk, "neo4j": to_property_graph,
    "rdf": to_ntriples, "brat": to_brat, "xml": to_xml, "rag": to_rag, "html": to_page, "parquet": to_tables, "excel": to_excel,
}


def register_exporter(name: str, exporter: Callable) -> None:
    EXPORTERS[name] = exporter


def get_exporter(name: str) -> Callable:
    if name not in EXPORTERS:
        raise ValueError(f"unknown export format: {name}")
    return EXPORTERS[name]
