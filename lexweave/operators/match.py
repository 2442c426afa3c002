"""Dictionary matching: all occurrences of labels on word boundaries, overlap resolution, confidences.

Two physical forms with the same answer: an automaton per worker (dictionaries of bounded size), and a join of text tokens
to the first word of each label (dictionaries of any size).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.config import AUTOMATON_BYTES
from lexweave.functions import text as T
from lexweave.sources.shared import SMALL, fresh_dir, kept

#: Confidence by label type, for labels of several words and of one.
CONFIDENCE = {"preferred": (0.90, 0.72), "alternative": (0.65, 0.35), "translation": (0.60, 0.30)}
OTHER_CONFIDENCE = 0.50
MATCHES = "doc_id bigint, start int, end int, label_key string"


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Finder:
    """All bounded occurrences of labels in lower-cased text; an automaton if the library is there, else searches by label."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        try:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for label in labels:
                self.automaton.add_word(label, label)
            if labels:
                self.automaton.make_automaton()
        except ImportError:
            self.automaton = None

    def hits(self, text: str) -> Iterator[tuple[int, int, str]]:
        if not self.labels:
            return
        if self.automaton is not None:
            found = ((e - len(v) + 1, e + 1, v) for e, v in self.automaton.iter(text))
        else:
            found = ((i, i + len(v), v) for v in self.labels for i in self._each(text, v))
        for a, b, v in found:
            if (a == 0 or not _word(text[a - 1])) and (b == len(text) or not _word(text[b])):
                yield a, b, v

    @staticmethod
    def _each(text: str, label: str) -> Iterator[int]:
        at = text.find(label)
        while at >= 0:
            yield at
            at = text.find(label, at + 1)


def match_automaton(docs: DataFrame, labels: list[str]) -> DataFrame:
    """(doc_id, start, end, label_key) in code points of the lower-cased text."""
    labels = sorted({v for v in labels if v})
    held = docs.sparkSession.sparkContext.broadcast(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(held.value)
        for batch in batches:
            docs_, starts, ends, keys = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for a, b, v in finder.hits((text or "").lower()):
                    docs_.append(doc), starts.append(a), ends.append(b), keys.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(keys, pa.string())], ["doc_id", "start", "end", "label_key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MATCHES)


#: Bytes of marked text that are cut into tokens at once.
CUT_BYTES = 4_000_000
TOKEN_COLUMNS = {"i": "int", "start": "int", "token": "string", "gap": "string", "ahead": "string", "nxt": "string", "last": "boolean", "context": "string"}


def marked(text: Column) -> Column:
    """Lower-cased text with a sentinel before and after each word."""
    return F.regexp_replace(F.lower(text), r"([\p{L}\p{N}_]+)", "\u0001$1\u0002")


def slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most CUT_BYTES of text, or of one row."""
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CUT_BYTES, "right")))
        yield batch.slice(a, b - a)
        a = b


def cut(texts: pa.Array, wanted: list[str], heads: pa.Array | None) -> tuple[np.ndarray, list[pa.Array]]:
    """Rows of the tokens in marked texts (without nulls), and the wanted columns of TOKEN_COLUMNS; ``heads``: the only tokens wanted."""
    lists = pc.split_pattern(texts, "\u0001")
    pieces, ends = lists.flatten(), np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(ends)), ends)
    first = np.concatenate([[0], np.cumsum(ends)])[:-1]
    i = np.arange(len(row)) - first[row]
    size = pc.utf8_length(pieces).to_numpy().astype(np.int64) - (i > 0)
    before = np.cumsum(size) - size
    parts = pc.split_pattern(pieces, "\u0002")
    at, values = parts.offsets.to_numpy(), parts.flatten()
    token, gap = values.take(pa.array(at[:-1])), values.take(pa.array(at[1:] - 1))
    keep = i > 0
    if heads is not None:
        keep &= pc.is_in(token, value_set=heads).to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(keep)

    def later(column: pa.Array, k: int) -> pa.Array:
        """The column ``k`` tokens on in the same text, else null."""
        to = keep + k
        inside = (to < len(row)) & (row[np.minimum(to, len(row) - 1)] == row[keep])
        return column.take(pa.array(to, mask=~inside))

    out = []
    for name in wanted:
        if name == "i":
            out.append(pa.array(i[keep], pa.int32()))
        elif name == "start":
            out.append(pa.array((before - before[first[row]])[keep], pa.int32()))
        elif name == "last":
            out.append(pa.array(i[keep] + 1 == ends[row[keep]]))
        elif name == "ahead":
            out.append(gap.take(pa.array(keep - 1)))
        elif name == "nxt":
            out.append(later(token, 1))
        elif name == "context":
            more = [pc.fill_null(c, "") for k in range(1, NEAR + 1) for c in (later(gap, k - 1), later(token, k))]
            out.append(pc.binary_join_element_wise(token.take(pa.array(keep)), *more, ""))
        else:
            out.append((token if name == "token" else gap).take(pa.array(keep)))
    return row[keep], out


def tokens(docs: DataFrame, text: str = "text", columns: tuple[str, ...] = ("i", "start", "token", "gap", "ahead"), heads: list[str] | None = None) -> DataFrame:
    """(doc_id, columns): word tokens of the lower-cased text with what follows and precedes each, cut where the text is, without a shuffle or a sort.

    Columns are number, start, token, gap behind it and ahead of it; ``nxt``: the next token; ``last``: whether it is the text's
    last one; ``context``: the text up to the end of the NEAR-th token after it. ``heads``: only these tokens.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = ", ".join([f"doc_id {kind}", *[f"`{c}` {TOKEN_COLUMNS[c]}" for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if heads is None else pa.array(heads, pa.string())
        for batch in batches:
            for part in slices(batch, "_marked"):
                row, out = cut(part.column("_marked").cast(pa.string()), list(columns), only)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *out], ["doc_id", *columns])

    return T.dealt(docs.select("doc_id", text)).select("doc_id", marked(F.col(text)).alias("_marked")).where("_marked IS NOT NULL").mapInArrow(run, shape)


#: Words of a label that are compared with what follows its first token; those of longer labels are met one by one.
NEAR = 4
WORD = r"[\p{L}\p{N}_]"


def label_words(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label_key, head, words, gaps, tail, token): distinct labels taken apart; those without a word have no ``token``."""
    known = labels.select(*keys, "label_key").where("label_key <> ''").distinct()
    words, gaps = F.regexp_extract_all("label_key", F.lit(f"({WORD}+)"), 1), F.regexp_extract_all("body", F.lit(rf"([^\p{{L}}\p{{N}}_]+)"), 1)
    cut = known.withColumns({"words": words, "head": F.regexp_extract("label_key", r"^[^\p{L}\p{N}_]*", 0)})
    cut = cut.withColumn("body", F.substring(F.col("label_key"), F.length("head") + 1, F.length("label_key"))).withColumn("gaps", gaps)
    tail = F.when(F.size("gaps") == F.size("words"), F.element_at("gaps", -1)).otherwise("")
    return cut.select(*keys, "label_key", "head", "words", "gaps", F.when(F.size("words") > 0, tail).otherwise("").alias("tail"), F.get("words", F.lit(0)).alias("token"))


def anchored(docs: DataFrame, known: DataFrame, heads: list[str] | None, long: bool) -> DataFrame:
    """(doc_id, start, end, label_key): tokens of the texts met with labels (from ``label_words``) by the first word.

    Up to NEAR words are compared with the text that follows; what is left of longer labels (``long``: there are some) is joined
    word by word, for the few that came so far. ``heads``: the labels' first words where they are few, so that other tokens are left out.
    """
    near = tokens(docs, columns=("i", "start", "token", "ahead", "context"), heads=heads).withColumn("context", F.concat("context", F.lit("\u0003")))
    begins = F.concat("head", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(NEAR - 1)), lambda k: F.concat(F.get("words", k), F.get("gaps", k))), ""))
    asked = known.where("token IS NOT NULL").withColumns({"n_words": F.size("words"), "begins": F.when(F.size("words") > NEAR, begins).otherwise(F.col("label_key"))})
    met = near.join(F.broadcast(asked) if heads is not None else asked, "token").where(F.concat("head", "context").startswith(F.col("begins")) & F.col("ahead").endswith(F.col("head")))
    # No token may end right before the label, none go on right after it.
    met = met.where((F.col("head") == "") | (F.col("i") == 1) | (F.length("ahead") > F.length("head")))
    size, first = F.length("label_key"), (F.col("start") - F.length("head")).cast("int")
    after = F.substring(F.col("context"), size - F.length("head") + 1, F.lit(1))
    out = ["doc_id", first.alias("start"), (first + size).cast("int").alias("end"), "label_key"]
    short = met.where((F.col("n_words") <= NEAR) & ~after.rlike(WORD)).select(*out)
    if not long:
        return short
    rest = met.where(F.col("n_words") > NEAR)
    more = rest.select("doc_id", "start", "head", "label_key", "tail", "n_words", F.col("i").alias("_i"), F.col("gaps").alias("_gaps"), F.posexplode(F.slice("words", NEAR + 1, F.size("words"))).alias("_k", "token"))
    more = more.withColumns({"i": F.col("_i") + F.col("_k") + NEAR, "_gap": F.get("_gaps", F.col("_k") + NEAR), "_last": F.col("_k") + NEAR + 1 == F.col("n_words")})
    ended = tokens(docs, columns=("i", "token", "gap", "last"))
    fits = F.when(F.col("_last"), F.col("gap").startswith(F.col("tail")) & ((F.col("tail") == "") | (F.col("gap") != F.col("tail")) | F.col("last"))).otherwise(F.col("gap") == F.col("_gap"))
    whole = more.join(ended, ["doc_id", "i", "token"]).where(fits).groupBy("doc_id", "_i", "start", "head", "label_key", "n_words").agg(F.count("*").alias("_n")).where(F.col("_n") == F.col("n_words") - NEAR)
    return short.unionByName(whole.select(*out))


def match_anchor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The same for labels (label_key) of any length, by an equi-join on the first token; labels without a token go to the automaton."""
    known, n = kept(label_words(labels, []), fresh_dir(docs.sparkSession, "labels"))
    long = known.where(F.size("words") > NEAR).limit(1).count() > 0
    heads = [r[0] for r in known.select("token").where("token IS NOT NULL").distinct().collect()] if n <= SMALL else None
    found = anchored(docs, known, heads, long)
    rest = [r[0] for r in known.where("token IS NULL").select("label_key").collect()]
    return found.unionByName(match_automaton(docs, rest)) if rest else found


def _document_hits(text: str, labels: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, label): bounded occurrences of labels in a text, both marked; a label is looked for where its first word stands."""
    pieces = text.split("\u0001")
    by_word: dict[str, list[tuple[int, str]]] = {}
    bare = []
    for m in labels:
        head, word, rest = m.partition("\u0001")
        label = m.replace("\u0001", "").replace("\u0002", "")
        if word:
            by_word.setdefault(rest.split("\u0002", 1)[0], []).append((len(head), label))
        else:
            bare.append(label)
    plain = text.replace("\u0001", "").replace("\u0002", "")
    at, starts, inside = len(pieces[0]), [], [b"\0" * len(pieces[0])]
    for piece in pieces[1:]:
        token, _, gap = piece.partition("\u0002")
        if token in by_word:
            starts.append((at, token))
        inside.append(b"\1" * len(token) + b"\0" * len(gap))
        at += len(token) + len(gap)
    word_at = b"".join(inside)
    found = ((s - n, s - n + len(label), label) for s, token in starts for n, label in by_word[token] if s >= n and plain.startswith(label, s - n))
    hits = [(a, b, v) for a, b, v in found if (a == 0 or not word_at[a - 1]) and (b == len(plain) or not word_at[b])]
    return hits + [(a, a + len(v), v) for v in bare for a in Finder._each(plain, v) if (a == 0 or not word_at[a - 1]) and (a + len(v) == len(plain) or not word_at[a + len(v)])]


def _settled(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What ``keep_spans`` leaves of a document's hits, run by run of overlapping ones."""
    hits, out, run, reach = sorted(set(hits), key=lambda h: (h[0], -h[1], h[2])), [], [], -1

    def close() -> None:
        if len(run) == 1:
            out.append(run[0])
        elif run:
            some = sorted(run)
            out.extend(some[k] for k in keep_spans([(a, b, n) for n, (a, b, _) in enumerate(some)]))

    for h in hits:
        if h[0] >= reach:
            close()
            run = []
        run.append(h)
        reach = max(reach, h[1])
    close()
    return out


def match_by_document(docs: DataFrame, patterns: DataFrame, resolve: bool = False) -> DataFrame:
    """(doc_id, start, end, label_key): occurrences in each document of the labels that ``patterns`` (doc_id, label_key) has for it.

    A document meets its own patterns in one row, so that texts are shuffled and not their tokens; what is held is a batch of
    documents with their patterns. ``resolve``: what ``resolve_overlaps`` leaves of them.
    """
    own = patterns.where("label_key <> ''").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_set(marked(F.col("label_key"))).alias("labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_marked"):
                rows = []
                for doc, text, labels in zip(*[part.column(c).to_pylist() for c in ("doc_id", "_marked", "labels")], strict=True):
                    hits = _document_hits(text, labels)
                    rows += [(doc, *h) for h in (_settled(hits) if resolve else hits)]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], ["doc_id", "start", "end", "label_key"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), marked(F.col("text")).alias("_marked")).where("_marked IS NOT NULL")
    return texts.join(own.hint("merge"), "doc_id").mapInArrow(run, MATCHES)


def match(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Choose the form by the checked size of the dictionary."""
    size = labels.agg(F.coalesce(F.sum(F.octet_length("label_key")), F.lit(0))).first()[0]
    if size <= AUTOMATON_BYTES:
        return match_automaton(docs, [r[0] for r in labels.select("label_key").distinct().collect()])
    return match_anchor(docs, labels)


def confidence(label_type: Column, label: Column) -> Column:
    many = label.contains(" ")
    out = F.lit(OTHER_CONFIDENCE)
    for kind, (several, one) in CONFIDENCE.items():
        out = F.when(label_type == kind, F.when(many, several).otherwise(one)).otherwise(out)
    return out


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` with ``island``: runs of overlapping spans by key; no overlap crosses islands."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_new", (reach.isNull() | (reach <= F.col("start"))).cast("int")).withColumn("island", F.sum("_new").over(order)).drop("_new")


def keep_spans(spans: list[tuple[int, int, int]]) -> list[int]:
    """Numbers of the spans (start, end, number) that stay: equal ones once, nested ones all, of crossing ones the longer.

    Spans are taken by start, longer ones first; a longer challenger takes the slot of the first kept span it crosses.
    """
    kept: list[tuple[int, int, int]] = []
    for span in sorted(spans, key=lambda s: (s[0], s[0] - s[1], s[2])):
        a, b, _ = span
        for k, (c, d, _) in enumerate(kept):
            if a >= d or b <= c:
                continue
            if (a, b) == (c, d):
                break
            if (a >= c and b <= d) or (c >= a and d <= b):
                continue
            if b - a > d - c:
                kept[k] = span
            break
        else:
            kept.append(span)
    return [s[2] for s in kept]


def resolve_overlaps(matches: DataFrame) -> DataFrame:
    """``matches`` (doc_id, start, end, label_key) after overlap resolution, island by island."""
    isles = islands(matches, ["doc_id"])
    own = F.sort_array(F.collect_list(F.struct("start", "end", "label_key")))  # an island is one run of overlapping labels
    grouped = isles.groupBy("doc_id", "island").agg(own.alias("spans"))
    single = grouped.where(F.size("spans") == 1)
    several = grouped.where(F.size("spans") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, spans in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                for k in keep_spans([(s["start"], s["end"], i) for i, s in enumerate(spans)]):
                    rows.append((doc, spans[k]["start"], spans[k]["end"], spans[k]["label_key"]))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], ["doc_id", "start", "end", "label_key"])

    kept = several.select("doc_id", "spans").mapInArrow(run, MATCHES)
    return single.select("doc_id", F.col("spans")[0]["start"].alias("start"), F.col("spans")[0]["end"].alias("end"), F.col("spans")[0]["label_key"].alias("label_key")).unionByName(kept)


def longest_first(spans: DataFrame, keys: list[str], order: list[Column], carry: list[str]) -> DataFrame:
    """(keys, start, end, carry, n_absorbed): by ``order``, then start, end and carry, a span stays if it overlaps none that stays already.

    One that does not is absorbed by the first that it overlaps. Spans are folded island by island, natively.
    """
    own = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], "start", "end", *carry)
    rows = islands(spans, keys).groupBy(*keys, "island").agg(F.sort_array(F.collect_list(own)).alias("rows"))
    names = ["start", "end", *carry]
    kind = "array<struct<" + ", ".join(f"`{n}`: {spans.schema[n].dataType.simpleString()}" for n in names) + ", n_absorbed: int>>"

    def step(kept: Column, x: Column) -> Column:
        met = F.array_position(F.transform(kept, lambda k: (x["start"] < k["end"]) & (k["start"] < x["end"])), True)
        more = F.concat(kept, F.array(F.struct(*[x[n].alias(n) for n in names], F.lit(0).alias("n_absorbed"))))
        absorbed = F.transform(kept, lambda k, i: F.struct(*[k[n].alias(n) for n in names], (k["n_absorbed"] + (i == met - 1).cast("int")).alias("n_absorbed")))
        return F.when(met == 0, more).otherwise(absorbed).cast(kind)

    kept = rows.select(*keys, F.explode(F.aggregate("rows", F.array().cast(kind), step)).alias("s"))
    return kept.select(*keys, *[f"s.{n}" for n in names], "s.n_absorbed")


def same_iri_spans(spans: DataFrame) -> DataFrame:
    """Of overlapping spans of one concept (doc_id, iri, start, end, confidence) the longest, then surest, then first stays.

    A span stays beside it if it overlaps none that stays. Rows without a concept, and rejected ones if there is a ``state``, stay as they are.
    """
    aside = F.coalesce(F.col("iri"), F.lit("")) == ""
    if "state" in spans.columns:
        aside = aside | (F.coalesce(F.col("state"), F.lit("")) == "rejected")
    names = ["doc_id", "iri", "start", "end", "confidence"]
    kept = longest_first(spans.where(~aside).select(*names), ["doc_id", "iri"], [F.col("start") - F.col("end"), -F.col("confidence")], ["confidence"])
    return kept.unionByName(spans.where(aside).select(*names, F.lit(0).alias("n_absorbed")))
