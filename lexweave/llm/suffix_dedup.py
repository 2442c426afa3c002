"""Operator 6, suffix-array dedup: remove every byte covered by a long string that starts in two places.

A string of LENGTH bytes has one anchor: the leftmost GRAM-byte gram of minimal hash in it, which depends on the string
alone. So equal strings share an anchor at the same offset, and only occurrences of one anchor need be compared:

1. Anchors of all texts are shuffled by hash with a hash of the bytes that strings around them can cover (context).
   Anchors found once are dropped. Contexts found twice are repeats over their whole width: no text is moved for them.
   Of an anchor that a slice of texts has often, only what other slices need goes to the anchor's task (``spread``).
2. For anchors with different contexts one occurrence of each context is fetched. Their bytes, dealt by anchor, form
   shards; each gets a suffix array (Larsson-Sadakane refinement in numpy) and common prefixes (Kasai, all contexts in
   step), and strings of LENGTH bytes that neighbours in the array share are repeats.
3. An anchor with more contexts than a shard holds is dealt to several shards; their strings, in ranges of the string's
   hash, are merged by binary search.

Texts that have an exact copy are repeats as a whole and count once in steps 1 and 2. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import POLY, Scratch, arrow_bytes, byte_slices, distinct, mix64, small_batches, table, text_or_empty

LENGTH, GRAM = 200, 64
#: Bytes of contexts in one suffix array, and about so many strings in one bucket of the merge.
SHARD, RANGE = 1_000_000, 2_000_000
#: Positions that are hashed at a time, so that the numbers stay in the cache.
STRETCH = 1 << 15
#: Occurrences of an anchor, by the way that they are dealt.
BY_ANCHOR, BY_CONTEXT, WITNESS, SETTLED = 0, 1, 2, 3


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` (a power of two) bytes from each position on, by doubling; the last gram - 1 entries are void."""
    out = np.empty(len(raw), np.uint64)
    for a in range(0, len(raw), STRETCH):
        out[a : a + STRETCH] = _gram_hashes(raw[a : a + STRETCH + gram - 1], gram)[:STRETCH]
    return out


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    g = mix64((raw.astype(np.uint64) + np.uint64(1)) * POLY)
    step = 1
    while step < gram:
        nxt = g * POLY
        nxt[:-step] ^= g[step:] >> np.uint64(7)
        nxt[:-step] += g[step:]
        g = nxt ^ (nxt >> np.uint64(29))
        step *= 2
    return mix64(g)


def window_minima(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of the ``span`` values from each position on; the last span - 1 entries are void."""
    out = np.empty_like(values)
    for a in range(0, len(values), STRETCH):
        low, width = values[a : a + STRETCH + span - 1].copy(), 1
        n = len(low)
        while width * 2 <= span:
            low[:-width] = np.minimum(low[:-width], low[width:])
            width *= 2
        low[: max(n - (span - width), 0)] = np.minimum(low[: max(n - (span - width), 0)], low[span - width :])
        out[a : a + STRETCH] = low[:STRETCH]
    return out


def anchors(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in raw, gram hash, hashes of all grams) of all anchors: minima of every string of ``length`` bytes that lies in one row."""
    n, span = len(raw), length - gram + 1
    starts = np.zeros(n + 1, np.int64)
    sizes = np.diff(off)
    fits = sizes >= length
    np.add.at(starts, off[:-1][fits], 1)
    np.add.at(starts, off[1:][fits] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(starts[:-1]) > 0)
    if not len(valid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    g = gram_hashes(raw, gram)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (g >> bits << bits) | np.arange(n, dtype=np.uint64)
    at = (window_minima(low, span)[valid] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = distinct(at)
    return np.searchsorted(off, at, "right") - 1, at, g[at], g


def context_hashes(g: np.ndarray, lo: np.ndarray, hi: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each span of ``gram`` bytes or more: of the grams side by side in it, the last one ending where it ends."""
    out = (hi - lo).astype(np.uint64)
    for k in range(int(-(-(hi - lo).max(initial=0) // gram))):
        out = np.where(lo + k * gram < hi, mix64(out * POLY + g[np.minimum(lo + k * gram, hi - gram)]), out)
    return out


def spread(h: np.ndarray, ctx: np.ndarray, key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, dealt, kind): which occurrences of a slice go on, and to which task, so that no anchor's task gets all of its own.

    Of one context's places only the first and the last are compared with other slices; the rest have their copy here
    (SETTLED). If a slice has several contexts of an anchor, they are dealt by context (BY_CONTEXT), and two of its places go
    to the anchor's task besides, to tell that there are others (WITNESS). Rows may repeat; all others are BY_ANCHOR.
    """
    order = np.lexsort((pos, key, ctx, h))
    h, ctx = h[order], ctx[order]
    if not len(h):
        return order, h, np.zeros(0, np.int8)
    new_h = np.append(True, h[1:] != h[:-1])
    new = new_h | np.append(True, ctx[1:] != ctx[:-1])
    last = np.append(new[1:], True)
    kind = np.where(new | last, BY_ANCHOR, SETTLED).astype(np.int8)
    anchor = np.cumsum(new_h) - 1
    several = (np.bincount(anchor[new]) > 1)[anchor]
    kind[several & (kind == BY_ANCHOR)] = BY_CONTEXT
    mixed = mix64(h * POLY + ctx)
    dealt = np.where(kind == BY_CONTEXT, mixed, np.where(kind == SETTLED, mix64(mixed + np.arange(len(h), dtype=np.uint64)), h))
    witness = np.flatnonzero(several & (new_h | np.append(new_h[1:], True)))
    return np.append(order, order[witness]), np.append(dealt, h[witness]), np.append(kind, np.full(len(witness), WITNESS, np.int8))


def occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(dealt, h, key, pos, ctx, kind) of the anchors of distinct texts; a task skips texts that it has seen."""
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = [k for k, v in enumerate(batch.column("key").to_pylist()) if not (v in seen or seen.add(v))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            for a, b in byte_slices(batch.column("text"), 4_000_000):
                raw, off = arrow_bytes(batch.column("text").slice(a, b - a))
                row, at, h, g = anchors(raw, off, length, gram)
                lo, hi = np.maximum(at - before, off[row]), np.minimum(at + length, off[row + 1])
                ctx = mix64(context_hashes(g, lo, hi, gram) + (at - lo).astype(np.uint64))
                key, pos = batch.column("key").slice(a, b - a).to_numpy(zero_copy_only=False)[row].astype(np.int64), (at - off[row]).astype(np.int32)
                rows, dealt, kind = spread(h, ctx, key, pos)
                cols = [dealt.view(np.int64), h[rows].view(np.int64), key[rows], pos[rows], ctx[rows].view(np.int64), kind]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["dealt", "h", "key", "pos", "ctx", "kind"])

    return docs.select("key", "text").mapInArrow(run, "dealt bigint, h bigint, key bigint, pos int, ctx bigint, kind tinyint")


def marks(found: DataFrame) -> DataFrame:
    """(h, key, pos, decided, fetch) of anchors with two occurrences or more.

    decided: another occurrence has the same context; fetch: the one occurrence of its context, where it is dealt, whose bytes are needed.
    """
    own, dealt, by_context = F.struct("key", "pos"), Window.partitionBy("dealt"), Window.partitionBy("dealt", "ctx")
    seen = found.withColumns({"low": F.min(own).over(dealt), "top": F.max(own).over(dealt), "ctx_low": F.min("ctx").over(dealt), "ctx_top": F.max("ctx").over(dealt)})
    seen = seen.where((F.col("kind") != WITNESS) & ((F.col("low") != F.col("top")) | (F.col("kind") != BY_ANCHOR)))
    seen = seen.withColumns({"same_low": F.min(own).over(by_context), "same_top": F.max(own).over(by_context)})
    decided = (F.col("same_low") != F.col("same_top")) | (F.col("kind") == SETTLED)
    fetch = (F.col("same_low") == own) & (F.col("kind") != SETTLED) & ((F.col("ctx_low") != F.col("ctx_top")) | (F.col("kind") == BY_CONTEXT))
    return seen.select("h", "key", "pos", decided.alias("decided"), fetch.alias("fetch")).where("decided OR fetch")


def contexts(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, key, start, size, bytes) of the wanted (h, key, pos) occurrences: the bytes that strings around the anchor can cover."""
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in byte_slices(batch.column("text"), 4_000_000):
                part = batch.slice(a, b - a)
                raw, off = arrow_bytes(part.column("text"))
                body = raw.tobytes()
                hs, keys, starts, pieces = [], [], [], []
                for k, (key, spots) in enumerate(zip(part.column("key").to_pylist(), part.column("spots").to_pylist(), strict=True)):
                    if key in seen:
                        continue
                    seen.add(key)
                    for spot in spots:
                        lo, hi = max(0, spot["pos"] - before), min(int(off[k + 1] - off[k]), spot["pos"] + length)
                        hs.append(spot["h"]), keys.append(key), starts.append(lo), pieces.append(body[off[k] + lo : off[k] + hi])
                sizes = pa.array([len(x) for x in pieces], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), sizes, pa.array(pieces, pa.binary())], ["h", "key", "start", "size", "bytes"])

    spots = wanted.groupBy("key").agg(F.collect_set(F.struct("h", "pos")).alias("spots"))  # at most a text's own anchors
    return docs.join(spots, "key").select("key", "text", "spots").mapInArrow(run, "h bigint, key bigint, start int, size int, bytes binary")


def suffix_array(body: np.ndarray) -> np.ndarray:
    """Suffix array: groups of equal prefixes are refined by doubling until all are single.

    Only suffixes in groups of two or more are sorted again, by the rank of what follows (Larsson and Sadakane). The
    order is complete, which carrying common prefixes from one suffix to the next needs.
    """
    n = len(body)
    key = packed(body)
    order = np.argsort(key)
    head = np.ones(n + 1, bool)  # slots where a group starts
    head[1:n] = key[order[1:]] != key[order[:-1]]
    heads = np.flatnonzero(head[:n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))  # a group's rank is its first slot
    slots = np.flatnonzero(~(head[:n] & head[1:]))  # slots of groups of two or more
    h = 8
    while len(slots):
        own = order[slots]
        mixed = (rank[own] << 32) | np.where(own + h < n, rank[np.minimum(own + h, n - 1)] + 1, 0)
        turn = np.argsort(mixed)
        own, mixed = own[turn], mixed[turn]
        order[slots] = own
        start = np.append(True, mixed[1:] != mixed[:-1])
        firsts = np.flatnonzero(start)
        rank[own] = np.repeat(slots[firsts], np.diff(np.append(firsts, len(slots))))
        head[slots[firsts]] = True
        slots = slots[~(head[slots] & head[slots + 1])]
        h *= 2
    return order


def packed(body: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as numbers in byte order; zeros follow the end."""
    padded = np.append(body, np.zeros(8, np.uint8)).astype(np.uint64)
    key = np.zeros(len(body), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : len(body) + k]
    return key


def leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes on the left of each 64-bit number, by its exponent as a float; set bits after set bits go, lest it be rounded up."""
    return (64 - np.frexp(x & ~(x >> np.uint64(1)))[1]) >> 3


def common_prefixes(body: np.ndarray, order: np.ndarray, begins: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the prefix that each suffix shares with the one before it in the array (Kasai).

    Going right by one byte the length falls by one at most, so it is carried; all contexts advance in step.
    """
    n = len(body)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    key = np.append(packed(body), np.zeros(most + 8, np.uint64))
    out = np.zeros(n, np.int32)
    ends = np.append(begins[1:], n)
    carried = np.zeros(len(begins), np.int64)
    for j in range(int((ends - begins).max(initial=0))):
        alive = np.flatnonzero(begins + j < ends)
        at = begins[alive] + j
        other = before[at]
        have = np.where(other >= 0, np.maximum(carried[alive] - 1, 0), 0)
        go = np.flatnonzero((other >= 0) & (have < most))
        while len(go):
            x, y = at[go] + have[go], other[go] + have[go]
            apart = key[x] ^ key[y]
            # Equal bytes from the left among eight, and no further than the text.
            same = leading_zero_bytes(apart)
            have[go] += np.minimum(same, n - np.maximum(x, y))
            go = go[(same == 8) & (have[go] < most)]
        have = np.minimum(have, most)
        carried[alive] = have
        out[at] = have
    return out


def repeated_starts(pieces: list[bytes], owner: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of each string of ``length`` bytes in ``pieces`` that two places (owner, start + offset) have."""
    body = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    begins = np.cumsum(sizes) - sizes
    order = suffix_array(body)
    lcp = common_prefixes(body, order, begins, length)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    offset = np.arange(len(body)) - begins[piece]
    whole = offset + length <= sizes[piece]
    chosen = order[whole[order]]  # whole strings in array order; between two equal ones all suffixes share the string too
    group = np.cumsum(lcp[order] < length)[whole[order]]
    place = mix64(owner[piece[chosen]].view(np.uint64) * POLY + (start[piece[chosen]] + offset[chosen]).astype(np.uint64))
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    if not len(heads):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    several = np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)
    twice = chosen[np.repeat(several, np.diff(np.append(heads, len(group))))]
    return piece[twice], offset[twice]


#: Strings of some shards of one anchor: hashes in order, and the first place (owner, start) of each.
Strings = tuple[np.ndarray, np.ndarray, np.ndarray]


def merged(a: Strings, b: Strings) -> tuple[Strings, np.ndarray, np.ndarray]:
    """(strings of both, owner, start): one table is searched in the other; the places are those whose string the other has elsewhere."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    at = np.searchsorted(a[0], b[0])
    inside = np.minimum(at, len(a[0]) - 1)
    known = a[0][inside] == b[0]
    other = known & ((a[1][inside] != b[1]) | (a[2][inside] != b[2]))
    new = ~known
    both = tuple(np.insert(x, at[new], y[new]) for x, y in zip(a, b, strict=True))
    return both, np.append(b[1][other], a[1][inside[other]]), np.append(b[2][other], a[2][inside[other]])


def string_hashes(pieces: list[bytes], owner: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, start) of every string of ``length`` bytes in ``pieces``."""
    body = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    many = np.maximum(sizes - length + 1, 0)
    piece = np.repeat(np.arange(len(pieces)), many)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = (np.cumsum(sizes) - sizes)[piece] + offset
    gram = 1 << (length.bit_length() - 1)
    g = gram_hashes(body, gram)  # two grams cover a string
    return mix64(g[at] * POLY + g[at + length - gram]), owner[piece], start[piece] + offset


def _ranges(owner: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, lo, hi) of maximal runs of starts."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    head = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + 1)) if len(owner) else np.zeros(0, bool)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(owner)) - 1 if len(first) else first
    return owner[first], start[first], start[last] + length


def pack(strings: Strings) -> bytes:
    return b"".join(x.tobytes() for x in strings)


def unpack(packed: bytes) -> Strings:
    own = np.frombuffer(packed, np.int64).reshape(3, -1)
    return own[0].view(np.uint64), own[1], own[2]


def shard_repeats(dealt: DataFrame, length: int, shard: int) -> DataFrame:
    """(key, lo, hi, h, part, bucket, strings) of contexts that are sorted by (h, part) within partitions.

    Without ``strings``: byte runs of repeats inside a shard, which holds whole parts. With it: of anchors in several parts,
    the first place of each distinct string of a part, packed by ranges of the string's hash (buckets).
    """
    schema = pa.schema([("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("h", pa.int64()), ("part", pa.int32()), ("bucket", pa.int32()), ("strings", pa.binary())])

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        owner, start = np.array([r[2] for r in held], np.int64), np.array([r[3] for r in held], np.int64)
        piece, offset = repeated_starts([r[4] for r in held], owner, start, length)
        key, lo, hi = _ranges(owner[piece], start[piece] + offset, length)
        none = [pa.nulls(len(key), f.type) for f in list(schema)[3:]]
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lo), pa.array(hi), *none], schema=schema)
        split = [r for r in held if r[5] > 1]
        for group in sorted({r[:2] for r in split}):
            mine = [r for r in split if r[:2] == group]
            s, key, at = string_hashes([r[4] for r in mine], np.array([r[2] for r in mine], np.int64), np.array([r[3] for r in mine], np.int64), length)
            order = np.lexsort((at, key, s))
            first = order[np.append(True, s[order][1:] != s[order][:-1])] if len(s) else order
            s, key, at = s[first], key[first], at[first]
            buckets = -(-mine[0][5] * shard // (2 * RANGE))
            cuts = np.searchsorted(s, np.array([k * (1 << 64) // buckets for k in range(1, buckets)], np.uint64))
            ends = [0, *cuts.tolist(), len(s)]
            packed = [pack((s[a:b], key[a:b], at[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            empty = pa.nulls(buckets, pa.int64())
            cols = [empty, empty, empty, pa.array([group[0]] * buckets, pa.int64()), pa.array([group[1]] * buckets, pa.int32()), pa.array(range(buckets), pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, group = 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("h", "part", "key", "start", "bytes", "parts")], strict=True):
                if row[:2] != group and size >= shard // 2:
                    yield from solve(held)
                    held, size = [], 0
                group = row[:2]
                held.append(row)
                size += len(row[4])
        if held:
            yield from solve(held)

    return dealt.mapInArrow(run, "key bigint, lo bigint, hi bigint, h bigint, part int, bucket int, strings binary")


def merge_parts(strings: DataFrame, length: int) -> DataFrame:
    """(key, lo, hi) of places whose string another part of the same anchor has elsewhere; ``strings``: rows with ``strings`` of shard_repeats.

    Each bucket of an anchor is a group of its own; its parts, each in order, are merged two by two as they come, so that
    tables of like size meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[int, Strings]] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        group = None

        def fold(whole: bool) -> None:
            while len(stack) > 1 and (whole or stack[-2][0] <= stack[-1][0]):
                (n, a), (m, b) = stack.pop(), stack.pop()
                both, owner, start = merged(a, b) if len(a[0]) and len(b[0]) else (a if len(a[0]) else b, a[1][:0], a[2][:0])
                stack.append((n + m, both))
                found.append((owner, start))

        def end_group() -> Iterator[pa.RecordBatch]:
            fold(True)
            stack.clear()
            for owner, start in found:
                key, lo, hi = _ranges(owner, start, length)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["key", "lo", "hi"])
            found.clear()

        for batch in batches:
            for h, bucket, packed in zip(*[batch.column(c).to_pylist() for c in ("h", "bucket", "strings")], strict=True):
                if (h, bucket) != group:
                    yield from end_group()
                    group = (h, bucket)
                stack.append((1, unpack(packed)))
                fold(False)
        yield from end_group()

    dealt = strings.select("h", "bucket", "part", "strings").repartition("h", "bucket").sortWithinPartitions("h", "bucket", "part")
    return dealt.mapInArrow(run, "key bigint, lo bigint, hi bigint")


def text_keys(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` (doc_id, text) with ``key``: equal only for equal texts, as far as two 64-bit hashes tell.

    The key is the first hash; of texts that share it but not the second, it is the second.
    """
    two = docs.withColumns({"key": F.xxhash64("text"), "_second": F.xxhash64(F.lit(1), F.col("text"))})
    met = two.groupBy("key").agg(F.min("_second").alias("low"), F.max("_second").alias("top")).where("low <> top").select("key", F.lit(True).alias("_met"))
    met = scratch.save(met, "met-keys")
    return two.join(met, "key", "left").select("doc_id", "text", F.when(F.col("_met"), F.col("_second")).otherwise(F.col("key")).alias("key"))


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """``docs`` (doc_id, text) with n_bytes, n_removed, n_spans and ``kept`` (binary).

    A byte goes if a string of ``length`` bytes over it also starts elsewhere, in this row or another; every row counts as a
    document, repeated rows too. Null texts are empty; texts shorter than ``length`` lose nothing. Only doc_id is carried on,
    and may be null. Texts are read whole, however long; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    keyed = text_keys(docs.select("doc_id", text_or_empty().alias("text")), scratch)
    marked = scratch.save(marks(occurrences(keyed, length, gram)), "marks")
    wanted = marked.where("fetch").select("h", "key", "pos")
    fetched = scratch.save(contexts(keyed, wanted, length, gram), "contexts")
    sizes = fetched.groupBy("h").agg(F.sum("size").alias("n"))
    large = scratch.save(sizes.where(F.col("n") > shard).select("h", "n", F.ceil(2 * F.col("n") / shard).cast("int").alias("parts")), "large")
    parts = fetched.join(large.select("h", "parts"), "h", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = parts.withColumn("part", F.pmod(F.xxhash64("key", "start"), F.col("parts")).cast("int")).repartition("h", "part").sortWithinPartitions("h", "part")
    solved = scratch.save(shard_repeats(dealt, length, shard), "shards")
    shards = solved.where("strings IS NULL").select("key", "lo", "hi")
    if not large.isEmpty():
        shards = shards.unionByName(scratch.save(merge_parts(solved.where("strings IS NOT NULL"), length), "merged"))
    scratch.drop("contexts")
    decided = marked.where("decided").select("key", F.greatest(F.col("pos") - (length - gram), F.lit(0)).cast("long").alias("lo"), (F.col("pos") + length).cast("long").alias("hi"))
    copies = keyed.groupBy("key").agg(F.count("*").alias("copies"))
    runs = decided.unionByName(shards).groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))  # at most a few for each anchor of the text
    known = copies.join(runs, "key", "left").where("copies > 1 OR runs IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column("text"), 8_000_000):
                part = batch.slice(a, b - a)
                raw, off = arrow_bytes(part.column("text"))
                body, rows = raw.tobytes(), []
                for k, (copies, runs) in enumerate(zip(part.column("copies").to_pylist(), part.column("runs").to_pylist(), strict=True)):
                    text = body[off[k] : off[k + 1]]
                    rows.append(cut(text, [(0, len(text))] if (copies or 0) > 1 and len(text) >= length else [(r["lo"], r["hi"]) for r in runs or ()]))
                n, removed, spans, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return keyed.join(known, "key", "left").select("doc_id", "text", "copies", "runs").mapInArrow(run, schema)


def cut(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    """(bytes, bytes removed, maximal removed runs, rest) of a text without the given runs."""
    rest, at, removed, spans = [], 0, 0, 0
    end = -1
    for lo, hi in sorted(runs):
        hi = min(hi, len(text))
        if hi <= max(end, lo):
            continue
        if lo > end:
            spans += 1
            rest.append(text[at:lo])
            removed += hi - lo
        else:
            removed += hi - end
        end = at = hi
    rest.append(text[at:])
    return len(text), removed, spans, b"".join(rest)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "suffix"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    """For tests: the same by a dictionary of all strings."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            count[t[i : i + length]] = count.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        n, removed, spans, kept = cut(t, [(i, i + length) for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1])
        out.append((n, removed, spans, hashlib.sha256(kept).hexdigest()))
    return out
