"""Text normalisation, sentences and chunks as column expressions and set-oriented operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions.spans import overlapping

#: White space but for the line feed, as a regular-expression class body that Java and RE2 share.
WS = r"\t\x0B\x0C\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
STRIP = rf"^[{WS}\n]+|[{WS}\n]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def dealt(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whole texts dealt by document where the scan has fewer splits than there are cores (one row group in one file); others stay where they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores, key)


def normalize_whitespace(c: Column) -> Column:
    """Collapse blanks, then runs of line feeds, then blanks around line feeds, then strip: in this order."""
    c = F.regexp_replace(c, f"[{WS}]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return strip(c)


def sentences_of(c: Column) -> Column:
    """Array of sentences: split behind ``.!?`` before an upper-case letter; blank ones are dropped."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+(?=[A-Z])"), lambda s: F.length(strip(s)) > 0)


def sentence_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, sent_idx, start, end, sentence) with code-point offsets into ``text``; one window per document.

    Texts are dealt by document before they are cut, so that the windows find their rows in place and only whole texts are shuffled.
    """
    marked = F.regexp_replace(F.col(text), r"(?<=[.!?])(\s+)(?=[A-Z])", "$1\u0001")
    pieces = docs.repartition("doc_id").select("doc_id", F.posexplode(F.split(marked, "\u0001")).alias("i", "piece"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select("doc_id", "i", "piece", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int").alias("start"))
    whole = placed.where(F.length(strip(F.col("piece"))) > 0).withColumn("sentence", F.regexp_replace("piece", r"\s+$", ""))
    order = Window.partitionBy("doc_id").orderBy("i")
    return whole.select(
        "doc_id", (F.row_number().over(order) - 1).alias("sent_idx"), "start", (F.col("start") + F.length("sentence")).cast("int").alias("end"), "sentence"
    )


def sentence_for_span(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end, ...) with the first sentence that contains them, else the one that overlaps most, else null."""
    s = sentences.select("doc_id", "sent_idx", F.col("start").alias("_s"), F.col("end").alias("_e"))
    keyed = spans.withColumn("_id", F.struct("doc_id", "start", "end"))
    ranges = s.withColumnsRenamed({"_s": "lo", "_e": "hi"})
    met = overlapping(ranges, keyed.select("_id", "doc_id", "start", "end").distinct()).withColumnsRenamed({"lo": "_s", "hi": "_e"})
    rank = F.struct(
        (~((F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e")))).cast("int").alias("outside"),
        F.when((F.col("_s") <= F.col("start")) & (F.col("end") <= F.col("_e")), F.lit(0)).otherwise(-(F.least("_e", "end") - F.greatest("_s", "start"))).alias("less"),
        F.col("sent_idx").alias("sent_idx"),
    )
    best = met.groupBy("_id").agg(F.min(rank)["sent_idx"].alias("sent_idx"))
    return keyed.join(best, "_id", "left").drop("_id")


def chunk_plan(sentences: list[str], size: int, overlap: int) -> list[tuple[int, int, str]]:
    """Greedy packing of sentences into chunks of about ``size`` characters; the tail of a chunk within ``overlap`` starts the next.

    Offsets are sums of joined lengths, so they can drift from the source where it had other white space.
    """
    chunks, held, length, start = [], [], 0, 0
    for s in sentences:
        if held and length + len(s) > size:
            text = " ".join(held)
            chunks.append((start, start + len(text), text))
            tail, used = [], 0
            for t in reversed(held):
                if used + len(t) + 1 > overlap:
                    break
                tail.insert(0, t)
                used += len(t) + 1
            start = start + len(text) - used
            held, length = tail, used
        held.append(s)
        length += len(s) + 1
    if held:
        text = " ".join(held)
        chunks.append((start, start + len(text), text))
    return chunks


def chunks(docs: DataFrame, size: int = 3000, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_index, start_offset, end_offset, n_sentences, text); a short text is one chunk."""
    split = docs.select("doc_id", "text", F.when(F.length("text") > size, sentences_of(F.col("text"))).alias("sentences"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, sentences in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "sentences")], strict=True):
                plan = [(0, len(text or ""), text or "")] if sentences is None else chunk_plan(sentences, size, overlap)
                rows.extend((doc, k, a, b, t) for k, (a, b, t) in enumerate(plan))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())],
                ["doc_id", "chunk_index", "start_offset", "end_offset", "text"],
            )

    return split.mapInArrow(run, "doc_id bigint, chunk_index int, start_offset int, end_offset int, text string")


#: The rules of markdown and what stays of their matches, in the order in which they run.
MARKDOWN_RULES = (
    (r"(?m)^#{1,6}[ \t]+", ""), (r"\*{1,3}([^*\n]+)\*{1,3}", "$1"), (r"_{1,3}([^_\n]+)_{1,3}", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (r"`{1,3}([^`]*)`{1,3}", "$1"), (r"(?m)^[-*_]{3,}[ \t]*$", ""), (r"(?m)^[ \t]*[-*+][ \t]+", ""),
    (r"(?m)^[ \t]*\d+\.[ \t]+", ""),
)


def strip_markdown(c: Column) -> Column:
    """Plain text of markdown: headers, emphasis, links, images, code, rules, bullets, numbers, in this order."""
    for pattern, to in MARKDOWN_RULES:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def repair_pdf_text(c: Column) -> Column:
    """Join words hyphenated at line ends, then soft-wrapped lines, then drop lines between others that hold a page number only."""
    c = F.regexp_replace(c, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    c = F.regexp_replace(c, r"(?<![.!?:;\n])\n(?=[a-z])", " ")
    return F.regexp_replace(c, r"\n\s*\d+\s*\n", "\n")


def normalize_and_chunk(docs: DataFrame, size: int = 3000, overlap: int = 200) -> DataFrame:
    """Chunks of the normalised texts."""
    return chunks(docs.select("doc_id", normalize_whitespace(F.col("text")).alias("text")), size, overlap)


def text_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, n_sentences, n_chunks) of normalised texts."""
    d = docs.select("doc_id", normalize_whitespace(F.col("text")).alias("text"))
    n = chunks(d).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return d.select("doc_id", F.length("text").alias("n_chars"), F.size(sentences_of(F.col("text"))).alias("n_sentences")).join(n, "doc_id", "left")


#: File extensions by format.
EXTENSIONS = {
    "txt": "plain_text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "pdf": "pdf", "docx": "word", "doc": "word", "rtf": "rtf",
    "eml": "email", "msg": "email",
}


def detect_format(filename: Column, content: Column) -> Column:
    """Format by file extension, else by how the stripped content begins, else plain text."""
    ext = F.lower(F.substring_index(filename, ".", -1))
    known = F.lit(None).cast("string")
    for k, v in EXTENSIONS.items():
        known = F.coalesce(known, F.when(filename.contains(".") & (ext == k), F.lit(v)))
    body = strip(F.coalesce(content, F.lit("")))
    sniffed = (
        F.when(body.startswith("JVBER"), "pdf")
        .when(body.startswith("UEsDB"), "word")
        .when(body.startswith("{\\rtf"), "rtf")
        .when(body.rlike(r"(?i)^(From|Subject|Date|To|Message-ID):\s"), "email")
        .when(body.startswith("<!") | F.lower(body).startswith("<html"), "html")
        .when(body.startswith("# ") | body.contains("\n## "), "markdown")
        .otherwise("plain_text")
    )
    return F.coalesce(known, sniffed)
