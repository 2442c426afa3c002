"""Operator 1, line dedup by a segment-partition edit join.

Two lines within EDITS edits: if one is cut into EDITS + 1 segments, at least one segment occurs unchanged in the other, at
a place that the edits left and right of it allow. Every distinct line therefore indexes its segments by length, and
probes the indexes of its own and smaller lengths with those substrings only. Lines that meet are verified by a banded
bit-parallel edit distance; linked lines form classes, of which the first occurrence in the corpus stays. Links chain: a
removed line is within EDITS edits of another line of its class, not always of the one that stays.

1. Index and probe rows (hashes only) are shuffled by segment; segments that one line alone has are dropped.
2. Texts of the lines that are left are fetched, by a bit table of fixed size before the shuffle.
3. Segments of up to BLOCK lines are compared as they are. Lines of a more frequent segment are compared with its smallest
   line first, and then, block by block, only where they still lie in different classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import POLY, Scratch, SpanHasher, arrow_bytes, byte_slices, components, is_space, mix64, small_batches, table, text_or_empty

#: Most edits between linked lines; shorter lines (without outer white space) are linked by equality only, from EXACT_CHARS on.
EDITS, MIN_CHARS, EXACT_CHARS = 2, 20, 1
#: Bits of the table of lines to fetch (8 MB), and lines of one segment in a block.
TABLE_BITS, BLOCK = 1 << 26, 512


def line_spans(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start, end, row, line number): lines split at U+000A, spans without outer white space."""
    raw, off = arrow_bytes(column)
    lead = (raw & 0xC0) != 0x80
    at = np.append(0, np.cumsum(lead))[off]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(off) - 1
    breaks = np.flatnonzero(points == 10)
    begin = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    # A row starts one line, and each of its breaks one more; a break that ends a row starts an empty last line of that row.
    row = np.repeat(np.arange(n), 1 + np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1]))
    order_begin = np.empty(len(row), np.int64)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if n else np.zeros(0, np.int64)
    order_begin[:] = begin if len(begin) == len(row) else 0
    is_first = np.zeros(len(row), bool)
    is_first[first] = True
    order_begin[is_first] = at[:-1]
    order_begin[~is_first] = breaks + 1
    end = np.append(order_begin[1:] - 1, at[-1])
    end[np.append(first[1:], len(row)) - 1] = at[1:]
    solid = np.flatnonzero(~is_space(points))
    lo, hi = np.searchsorted(solid, order_begin), np.searchsorted(solid, end)
    some = hi > lo
    pad = np.append(solid, 0)
    start = np.where(some, pad[np.minimum(lo, len(solid))], order_begin)
    stop = np.where(some, pad[hi - 1] + 1, order_begin)
    number = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return points, start, stop, row, number


def line_keys(column, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit xxh3 of the lines' bytes, by their spans in code points."""
    raw, _ = arrow_bytes(column)
    at, body = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)), raw.tobytes()
    keys = (xxhash.xxh3_64_intdigest(body[a:b]) for a, b in zip(at[start].tolist(), at[end].tolist(), strict=True))
    return np.fromiter(keys, np.uint64, len(start))


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, number, line) of every line of ``least`` characters or more; ``line`` is the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column("text"), 4_000_000):
                part = batch.column("text").slice(a, b - a)
                _, start, end, row, number = line_spans(part)
                long = np.flatnonzero(end - start >= least)
                ids = batch.column("doc_id").slice(a, b - a).take(pa.array(row[long]))
                line = line_keys(part, start[long], end[long]).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number[long].astype(np.int32)), pa.array(line)], ["doc_id", "number", "line"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, number int, line bigint")


def segment(length: np.ndarray, k: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the k-th of ``parts`` segments of lines of the given lengths; the last ones take what is over."""
    size, over = length // parts, length % parts
    short = parts - over
    return k * size + np.maximum(k - short, 0), size + (k >= short)


def segment_rows(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """(segment, line, indexed): index rows, and probe rows of the substrings that length and position allow, of a task's distinct lines."""
    parts = edits + 1

    def keys(spans, start, size, length, k):
        return mix64(spans(start, start + size) * POLY + (length * parts + k).astype(np.uint64)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in byte_slices(batch.column("text"), 2_000_000):
                part = batch.column("text").slice(a, b - a)
                points, start, end, _, _ = line_spans(part)
                spans = SpanHasher(points)
                long = np.flatnonzero(end - start >= least)
                start, end = start[long], end[long]
                line = line_keys(part, start, end)
                fresh = np.array([not (v in seen or seen.add(v)) for v in line.tolist()], bool)
                start, line = start[fresh], line[fresh].view(np.int64)
                n = end[fresh] - start
                out = []
                for less in range(edits + 1):
                    length = n - less
                    for k in range(parts):
                        p, size = segment(length, k, parts)
                        low = np.maximum(np.maximum(p - k, p + less - (edits - k)), 0)
                        high = np.minimum(np.minimum(p + k, p + less + (edits - k)), n - size)
                        for shift in range(2 * edits + 1):
                            at = low + shift
                            ok = (at <= high) & (length >= least)
                            own = (at == p) & (less == 0)
                            if ok.any():
                                out.append((keys(spans, start[ok] + at[ok], size[ok], length[ok], k), line[ok], own[ok]))
                if out:
                    s, v, o = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(v), pa.array(o)], ["segment", "line", "indexed"])

    return docs.select("text").mapInArrow(run, "segment bigint, line bigint, indexed boolean")


def met_lines(rows: DataFrame) -> DataFrame:
    """(segment, line, indexed) of segments that different lines have, one of them in the index."""
    by_segment = Window.partitionBy("segment")
    ends = rows.withColumns({"low": F.min("line").over(by_segment), "top": F.max("line").over(by_segment), "index": F.max("indexed").over(by_segment)})
    met = ends.where("low <> top AND index").groupBy("segment", "line").agg(F.max("indexed").alias("indexed"))
    return met


def bit_table(lines: DataFrame) -> np.ndarray:
    """A bit table of fixed size in which each line sets a bit; parts are joined on executors."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(TABLE_BITS // 8, np.uint8)
        for batch in batches:
            at = batch.column("line").to_numpy().view(np.uint64) % np.uint64(TABLE_BITS)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        for k in np.flatnonzero(bits.reshape(-1, 65536).any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([bits[k * 65536 : (k + 1) * 65536].tobytes()])], ["part", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                parts[k] = parts.get(k, np.zeros(65536, np.uint8)) | np.frombuffer(v, np.uint8)
        for k, v in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()])], ["part", "bits"])

    out = np.zeros(TABLE_BITS // 8, np.uint8)
    shape = "part int, bits binary"
    for k, v in lines.select("line").coalesce(16).mapInArrow(spread, shape).repartition("part").mapInArrow(join, shape).toLocalIterator():  # 8 MB in all
        out[k * 65536 : (k + 1) * 65536] = np.frombuffer(v, np.uint8)
    return out


def line_texts(docs: DataFrame, lines: DataFrame, least: int) -> DataFrame:
    """(line, content) of the wanted lines; the bit table keeps most others out of the shuffle, the join drops the rest."""
    held = docs.sparkSession.sparkContext.broadcast(bit_table(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = held.value, set()
        for batch in batches:
            for a, b in byte_slices(batch.column("text"), 4_000_000):
                part = batch.column("text").slice(a, b - a)
                points, start, end, _, _ = line_spans(part)
                long = np.flatnonzero(end - start >= least)
                line = line_keys(part, start[long], end[long])
                at = line % np.uint64(TABLE_BITS)
                maybe = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                pick = [k for k in np.flatnonzero(maybe) if not (line[k] in seen or seen.add(line[k]))]
                words = [points[start[long[k]] : end[long[k]]].tobytes().decode("utf-32-le") for k in pick]
                yield pa.RecordBatch.from_arrays([pa.array(line[pick].view(np.int64), pa.int64()), pa.array(words, pa.string())], ["line", "content"])

    found = docs.select("text").mapInArrow(run, "line bigint, content string")
    return found.join(lines.select("line").distinct(), "line", "left_semi").groupBy("line").agg(F.min("content").alias("content"))


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 if it is larger: equal ends are trimmed, then error levels advance as bit sets over a diagonal band."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    k, n = 0, min(len(a), len(b))
    while k < n and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    n -= k
    k = 0
    while k < n and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    width, m = 2 * most + 1, len(a)
    full = (1 << width) - 1
    # Bit i of level d: the first j - most + i characters of a turn into the j read of b by d edits.
    levels = [sum(1 << (most + e) for e in range(d + 1)) & full for d in range(most + 1)]
    for j, c in enumerate(b):
        same = 0
        for i in range(width):
            at = j - most + i
            if 0 <= at < m and a[at] == c:
                same |= 1 << i
        before, lower = levels[0], levels[0] & same
        new = [lower]
        for d in range(1, most + 1):
            here = levels[d]
            lower = ((here & same) | before | (before >> 1) | (lower << 1)) & full
            new.append(lower)
            before = here
        levels = new
        if not levels[most]:
            return most + 1
    end = m - len(b) + most
    return next((d for d, v in enumerate(levels) if v >> end & 1), most + 1)


def _signs(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), 64), np.int16)
    for k, t in enumerate(texts):
        out[k] = np.bincount(np.frombuffer(t.encode("utf-32-le"), np.uint32) % 64, minlength=64)[:64]
    return out


def _compared(lists: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(src, dst) of lines of one group (segment, b, c) within ``edits`` edits that lie in different classes.

    ``lists``: segment, b, c, line, block, class, indexed; with b <> c only lines of different blocks meet.
    """

    def links(rows: list[tuple], two: bool, done: set) -> pa.RecordBatch:
        lines, blocks, classes = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        index = np.array([r[3] for r in rows], bool)
        texts = [r[4] for r in rows]
        sizes, signs = np.array([len(t) for t in texts]), _signs(texts)
        src, dst = [], []
        for i in range(len(rows)):
            ok = (lines > lines[i]) & (classes != classes[i]) & (np.abs(sizes - sizes[i]) <= edits) & (index | index[i])
            if two:
                ok &= blocks != blocks[i]
            j = np.flatnonzero(ok)
            # An edit changes two character counts by one at most.
            j = j[np.abs(signs[j] - signs[i]).sum(1) <= 2 * edits]
            for k in j:
                pair = (int(lines[i]), int(lines[k]))
                if pair not in done:
                    if len(done) > 200_000:
                        done.clear()
                    done.add(pair)
                    if edit_distance(texts[i], texts[k], edits) <= edits:
                        src.append(pair[0]), dst.append(pair[1])
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, done = [], None, set()
        for batch in batches:
            cols = ("segment", "b", "c", "line", "block", "class", "indexed", "content")
            for s, b, c, *row in zip(*[batch.column(k).to_pylist() for k in cols], strict=True):
                if (s, b, c) != group:
                    if len(held) > 1:
                        yield links(held, group[1] != group[2], done)
                    held, group = [], (s, b, c)
                held.append(tuple(row))
        if len(held) > 1:
            yield links(held, group[1] != group[2], done)

    dealt = lists.join(texts, "line").select("segment", "b", "c", "line", "block", "class", "indexed", "content")
    return dealt.repartition("segment", "b", "c").sortWithinPartitions("segment", "b", "c").mapInArrow(run, "src bigint, dst bigint").distinct()


def _star(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The (src, dst) pairs within ``edits`` edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [edit_distance(a, b, edits) <= edits for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield batch.select(["src", "dst"]).filter(pa.array(near, pa.bool_()))

    ends = pairs.join(texts.select(F.col("line").alias("dst"), F.col("content").alias("b")), "dst")
    both = ends.join(texts.select(F.col("line").alias("src"), F.col("content").alias("a")), "src")
    return both.where(F.abs(F.length("a") - F.length("b")) <= edits).select("src", "dst", "a", "b").mapInArrow(run, "src bigint, dst bigint")


def near_lines(met: DataFrame, texts: DataFrame, edits: int, scratch: Scratch) -> DataFrame:
    """(src, dst) links of lines that share a segment: enough of them to join all lines that a chain of ``edits`` edits joins."""
    sizes = met.groupBy("segment").agg(F.count("*").alias("n"), F.min(F.when(F.col("indexed"), F.col("line"))).alias("low"))
    large = scratch.save(sizes.where(F.col("n") > BLOCK), "large")
    zero = F.lit(0)
    small = met.join(large, "segment", "left_anti").select("segment", zero.alias("b"), zero.alias("c"), "line", zero.alias("block"), F.col("line").alias("class"), "indexed")
    links = scratch.save(_compared(small, texts, edits), "links-small")
    if large.isEmpty():
        return links
    listed = met.join(large, "segment")
    star = listed.where("line <> low").select(F.col("low").alias("src"), F.col("line").alias("dst")).distinct()
    links = links.unionByName(scratch.save(_star(star, texts, edits), "links-star"))
    found = scratch.save(components(links, scratch, "star"), "classes-star")
    placed = listed.join(found.withColumnRenamed("node", "line"), "line", "left").select("segment", "n", "line", "indexed", F.coalesce("component", "line").alias("class"))
    mixed = placed.groupBy("segment").agg(F.min("class").alias("low"), F.max("class").alias("top")).where("low <> top").select("segment")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = placed.join(mixed, "segment", "left_semi").withColumn("block", F.pmod(F.xxhash64("line"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(zero, blocks - 1)))
    dealt = dealt.select("segment", F.least("block", "other").alias("b"), F.greatest("block", "other").alias("c"), "line", "block", "class", "indexed")
    return links.unionByName(scratch.save(_compared(dealt, texts, edits), "links-large"))


def dedup_lines(docs: DataFrame, scratch: Scratch, edits: int = EDITS, least: int = MIN_CHARS, exact: int | None = None) -> DataFrame:
    """``docs`` with n_lines, n_removed and ``kept`` (text without removed lines); clashing columns are replaced.

    Of equal lines, and of lines linked by ``edits`` edits or fewer, the one first by (doc_id, line) stays; lines shorter than
    ``least`` characters are linked only if they are equal and have ``exact`` characters or more; without ``exact`` they stay.
    ``least`` may be as low as edits + 1, where each segment has a character. A whole line goes with its line feed. Null texts
    are empty; rows that share a doc_id are one document and lose nothing to each other at the same line; rows without a
    doc_id lose nothing. Lines of any length are compared whole. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = scratch.save(occurrences(own, least if exact is None else min(exact, least)), "lines")
    met = scratch.save(met_lines(segment_rows(own, edits, least)), "met")
    texts = scratch.save(line_texts(own, met, least), "texts")
    classes = scratch.save(components(near_lines(met, texts, edits, scratch), scratch, "class"), "classes")
    scratch.drop("met", "texts", "large", "links-small", "links-star", "classes-star", "links-large")
    named = found.join(classes.withColumnRenamed("node", "line"), "line", "left").select("doc_id", "number", F.coalesce("component", "line").alias("class"))
    place = F.struct("doc_id", "number")
    first = named.groupBy("class").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("class", "first")
    first = scratch.save(first, "first")  # a table, so that the join below can split a class that holds a large part of all lines
    gone = named.join(first, "class").where(place != F.col("first")).groupBy("doc_id").agg(F.collect_set("number").alias("_ld_gone"))  # a text's own lines
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "kept")]
    renamed = docs.select(*[F.col(c).alias(f"_in_{i}") for i, c in enumerate(kept)], F.col("doc_id").cast("long").alias("_ld_id"), text_or_empty().alias("_ld_text"))
    joined = renamed.join(gone.withColumnRenamed("doc_id", "_ld_id"), "_ld_id", "left").withColumn("_ld_lines", F.split("_ld_text", "\n"))
    rest = F.filter("_ld_lines", lambda _, i: ~F.array_contains("_ld_gone", i))
    return joined.select(
        *[F.col(f"_in_{i}").alias(c) for i, c in enumerate(kept)],
        F.size("_ld_lines").cast("long").alias("n_lines"),
        F.when(F.col("_ld_gone").isNull(), 0).otherwise(F.size("_ld_gone")).cast("long").alias("n_removed"),
        F.when(F.col("_ld_gone").isNull(), F.col("_ld_text")).otherwise(F.array_join(rest, "\n")).alias("kept"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "lines"), exact=EXACT_CHARS)
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("kept").cast("long").alias("n_kept_chars"), F.sha2("kept", 256).alias("kept_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those left without any text go, if they had some. An empty table gives none."""
    out = dedup_lines(docs, Scratch(spark, "lines-stage"), exact=EXACT_CHARS)
    out = out.where("n_removed = 0 OR length(trim(kept)) > 0")
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)
