"""Ingestion: one transform per format, joined by a registry; binary formats need the standard library only."""

from __future__ import annotations

import base64
import email
import email.policy
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import detect_format, repair_pdf_text, strip_markdown


class _Elements(HTMLParser):
    """Headings, paragraphs, list items and cells with the path of headings above them, and the visible text."""

    KINDS = {"p": "paragraph", "li": "list_item", "td": "table_cell", "th": "table_cell", **{f"h{k}": "heading" for k in range(1, 7)}}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[str] = []
        self.out: list[tuple[str, str, list[str], int | None]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.lines: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif tag in self.KINDS:
            if tag == "p" and self.open and self.open[-1][0] == "p":
                self.handle_endtag("p")
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.KINDS and any(t == tag for t, _ in self.open):
            while self.open:
                name, parts = self.open.pop()
                text = " ".join("".join(parts).split())
                if text:
                    level = int(name[1]) if name[0] == "h" else None
                    if level:
                        self.path = [*self.path[: level - 1], text]
                    self.out.append((text, self.KINDS[name], list(self.path), level))
                if name == tag:
                    break

    def handle_data(self, data):
        if not self.hidden:
            for _, parts in self.open:
                parts.append(data)
            self.lines.extend(s for line in data.split("\n") if (s := line.strip()))


def html_parts(page: str) -> tuple[str, list[tuple[str, str, list[str], int | None]]]:
    p = _Elements()
    p.feed(page or "")
    p.close()
    return "\n".join(p.lines), p.out


def docx_text(content: str) -> str:
    """Non-empty paragraphs of a base64 .docx, joined by blank lines."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(base64.b64decode(content))) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    texts = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    return "\n\n".join(t for t in texts if t.strip())


def rtf_text(content: str) -> str:
    """Text of an RTF document, given as it is or in base64: control words go, escapes and paragraphs are kept."""
    if not content.lstrip().startswith("{\\rtf"):
        content = base64.b64decode(content).decode("latin-1")
    content = re.sub(r"\{\\(?:\*|fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", content)
    content = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), content)
    content = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), content)
    content = re.sub(r"\\par[d]?\b ?|\\line\b ?", "\n", content)
    content = re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", content)
    return re.sub(r"\n{3,}", "\n\n", content.replace("\\~", " ")).strip()


def email_text(content: str) -> str:
    """Four headers, a blank line, the plain body, or else the HTML body as text."""
    m = email.message_from_string(content, policy=email.policy.default)
    head = [f"{k}: {m[k]}" for k in ("From", "To", "Subject", "Date") if m[k]]
    plain, rich = m.get_body(("plain",)), m.get_body(("html",))
    body = plain.get_content() if plain else html_parts(rich.get_content())[0] if rich else ""
    return "\n".join(head) + "\n\n" + body.strip()


def _python(convert: Callable[[str], str]) -> Callable[[DataFrame], DataFrame]:
    def transform(docs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, errors = [], []
                for content in batch.column("content").to_pylist():
                    try:  # a document that cannot be read must not end the job; its error is a column
                        texts.append(convert(content or "")), errors.append(None)
                    except Exception as e:  # noqa: BLE001
                        texts.append(None), errors.append(f"{type(e).__name__}: {e}"[:200])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["doc_id", "text", "error"])

        return docs.select("doc_id", "content").mapInArrow(run, "doc_id bigint, text string, error string")

    return transform


def _native(expression) -> Callable[[DataFrame], DataFrame]:
    return lambda docs: docs.select("doc_id", expression(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))


_INGESTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "plain_text": _native(lambda c: c),
    "markdown": _native(strip_markdown),
    "html": _python(lambda c: html_parts(c)[0]),
    "word": _python(docx_text),
    "rtf": _python(rtf_text),
    "email": _python(email_text),
    "pdf": _native(repair_pdf_text),
}


def register_ingestor(name: str, transform: Callable[[DataFrame], DataFrame]) -> None:
    """Add or replace the transform of a format: (doc_id, content) to (doc_id, text, error)."""
    _INGESTORS[name] = transform


def get_ingestor(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in _INGESTORS:
        raise ValueError(f"unknown format: {name}")
    return _INGESTORS[name]


def ingest(docs: DataFrame) -> DataFrame:
    """(doc_id, text, error) of (doc_id, content, filename): detect the format, then one branch of the plan per format."""
    known = docs.withColumn("format", detect_format(F.coalesce("filename", F.lit("")), F.col("content")))
    out = None
    for name, transform in _INGESTORS.items():
        part = transform(known.where(F.col("format") == name))
        out = part if out is None else out.unionByName(part)
    return out


def html_elements(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """(key, elem_idx, text, element_type, section_path, level) in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *e) for k, page in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist(), strict=True) for i, e in enumerate(html_parts(page)[1])]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [key, "elem_idx", "text", "element_type", "section_path", "level"])

    return pages.select(key, column).mapInArrow(run, f"{key} bigint, elem_idx int, text string, element_type string, section_path array<string>, level int")


def owl_tables(xml: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(concepts, labels, edges) rows of an OWL/XML document."""
    ns = {"owl": "http://www.w3.org/2002/07/owl#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "skos": "http://www.w3.org/2004/02/skos/core#"}
    about, resource = f"{{{ns['rdf']}}}about", f"{{{ns['rdf']}}}resource"
    concepts, labels, edges = [], [], []
    for n, c in enumerate(ET.fromstring(xml).iterfind("owl:Class", ns)):
        iri, text = c.get(about), lambda tag, c=c: getattr(c.find(tag, ns), "text", None)
        concepts.append((iri, text("rdfs:label"), text("skos:prefLabel"), text("skos:definition"), None, (text("owl:deprecated") or "") == "true", n))
        labels += [(iri, e.text, "alternative") for e in c.iterfind("skos:altLabel", ns)] + [(iri, e.text, "hidden") for e in c.iterfind("skos:hiddenLabel", ns)]
        edges += [(iri, e.get(resource), k) for k, e in enumerate(x for x in c.iterfind("rdfs:subClassOf", ns) if x.get(resource))]
    return concepts, labels, edges
