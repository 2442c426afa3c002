"""Operator 13, detection of periodic runs of words.

A run of period q that is at least 2q long holds two neighbouring points of the grid 0, q, 2q, ... So all pairs (period, grid
point) of a batch of texts, some n ln n for a text of n words, are met at once: how far the words agree from a pair on to the
right and to the left is found by binary search over prefix hashes, all pairs in step. Pairs that agree over q words in all
make a run. Runs found under several periods are one, with the smallest; every run's words are compared in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.chunks import ragged_take
from lexweave.llm.common import _power_tables, arrow_bytes, byte_slices, mix64, small_batches, table, text_or_empty, word_spans

LEAST, LEAST_PERIODS = 12, 2
#: Pairs of a period and a grid point that are held at once, and bytes of text that are met together.
PAIRS, SLICE_BYTES = 1 << 21, 1 << 20


class WordHashes:
    """Prefix hashes of a sequence of word numbers; equal stretches have equal hashes, the reverse is checked afterwards."""

    def __init__(self, words: np.ndarray):
        up, self.down = _power_tables(len(words))
        self.words, self.total = words, np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix64(words.astype(np.uint64) + np.uint64(0x51ED27)) * up[: len(words)], out=self.total[1:])

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.total[a + length] - self.total[a]) * self.down[a] == (self.total[b + length] - self.total[b]) * self.down[b]

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from a and b on, at most ``most``; binary search for all pairs in step."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_] + 1) // 2
            same = self.same(a[open_], b[open_], mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1
            open_ = open_[low[open_] < high[open_]]
        return low

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree before a and b, at most ``most``."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_] + 1) // 2
            same = self.same(a[open_] - mid, b[open_] - mid, mid)
            low[open_[same]] = mid[same]
            high[open_[~same]] = mid[~same] - 1
            open_ = open_[low[open_] < high[open_]]
        return low


def _grid(off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (row, period, grid point): all periods up to half a row's words, points from its first word on."""
    size = np.diff(off)
    row = np.repeat(np.arange(len(size)), size // 2)
    period = np.arange(len(row)) - np.repeat(np.cumsum(size // 2) - size // 2, size // 2) + 1
    points = (size[row] - 1) // period  # i = 0, p, 2p, ... with i + p inside the row
    block = np.cumsum(points) // PAIRS
    for k in np.unique(block):
        some = np.flatnonzero(block == k)
        many = points[some]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        r, p = np.repeat(row[some], many), np.repeat(period[some], many)
        yield r, p, off[r] + step * p


def _exact(words: np.ndarray, start: int, end: int, low: int, high: int, period: int) -> tuple[int, int]:
    """(start, end) of the run of ``period`` around the pair (start, end), word by word, inside [low, high)."""
    same = words[low : high - period] == words[low + period : high]
    at, to = start - low, end - period - low
    after, before = np.flatnonzero(~same[to:]), np.flatnonzero(~same[:at])
    return (low + int(before[-1]) + 1 if len(before) else low), (low + to + int(after[0]) if len(after) else high - period) + period


def runs(words: np.ndarray, off: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(row, start, length, period) of all runs, sorted so; ``words`` are numbers, equal ones for equal words, start counts from the row's first word."""
    hashes, found = WordHashes(words), []
    for row, period, point in _grid(off):
        other, begin, end = point + period, off[row], off[row + 1]
        # The first step of both searches; a pair that agrees on neither side has no run.
        ahead = words[point] == words[other]
        behind = np.zeros(len(point), bool)
        inner = np.flatnonzero(point > begin)
        behind[inner] = words[point[inner] - 1] == words[other[inner] - 1]
        some = np.flatnonzero(ahead | behind)
        row, period, point, other, begin, end = (x[some] for x in (row, period, point, other, begin, end))
        right = hashes.forward(point, other, end - other)
        left = hashes.backward(point, other, point - begin)
        good = np.flatnonzero((right + left >= period) & (right + left + period >= least))
        found.append(_distinct(np.stack([row[good], point[good] - left[good], other[good] + right[good], period[good], point[good]], 1), 4))
    out = _distinct(np.concatenate([np.zeros((0, 5), np.int64), *found]), 4)
    # Multiples of a verified period over the same words follow from it; all others are compared word by word.
    head = _first(out, 3)
    group = np.cumsum(head) - 1
    least_period = out[head, 3][group] if len(out) else out[:, 3]
    sure = _verified(words, out[head])[group] if len(out) else head
    out = out[head | (out[:, 3] % np.maximum(least_period, 1) != 0) | ~sure]
    for k in np.flatnonzero(~_verified(words, out)):  # a hash met another: that pair anew
        r, _, _, p, point = out[k]
        out[k, 1:3] = _exact(words, int(point), int(point) + int(p), int(off[r]), int(off[r + 1]), int(p))
    out = _distinct(out[out[:, 2] - out[:, 1] >= np.maximum(least, LEAST_PERIODS * out[:, 3])], 3)
    out = np.stack([out[:, 0], out[:, 1] - off[out[:, 0]], out[:, 2] - out[:, 1], out[:, 3]], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _first(out: np.ndarray, columns: int) -> np.ndarray:
    """Where the first columns of sorted rows differ from those of the row before."""
    first = np.ones(len(out), bool)
    first[1:] = (out[1:, :columns] != out[:-1, :columns]).any(1)
    return first


def _distinct(out: np.ndarray, columns: int) -> np.ndarray:
    """Rows sorted by all columns, the first of those that agree in the first ``columns``."""
    out = out[np.lexsort(out.T[::-1])]
    return out[_first(out, columns)]


def _verified(words: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Whether the words of each (row, start, end, period, ..) agree with those one period before, in blocks."""
    size, good = found[:, 2] - found[:, 1] - found[:, 3], np.ones(len(found), bool)
    block = (np.cumsum(size) // PAIRS) if len(size) else size
    for k in np.unique(block):
        some = np.flatnonzero(block == k)
        many = size[some]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(found[some, 1], many) + step
        wrong = words[at] != words[at + np.repeat(found[some, 3], many)]
        good[some[np.repeat(np.arange(len(some)), many)[wrong]]] = False
    return good


def collapsed(n: int, found: np.ndarray) -> np.ndarray:
    """Numbers of the words that stay of ``n``: those in no (start, length, period) after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.flatnonzero(np.cumsum(edge)[:n] == 0)


def planted(n: int, h: int | None) -> np.ndarray:
    """Original word number of each word of a text of ``n``: the contract repeats the tail of every tenth document."""
    at = np.arange(n)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


_SCHEMA = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _rows(raw: np.ndarray, off: np.ndarray, sources: list, least: int) -> list[tuple]:
    """The result columns of a slice of texts; ``sources`` has the hash that plants a tail, or None, for each."""
    start, end, row = word_spans(raw, off)
    size = np.bincount(row, minlength=len(off) - 1).astype(np.int64)
    word_off = np.append(0, np.cumsum(size))
    order = np.concatenate([planted(int(n), h) + a for n, h, a in zip(size, sources, word_off, strict=False)]) if len(size) else np.zeros(0, np.int64)
    start, end = start[order], end[order]
    flat = ragged_take(raw, start, end - start) if len(start) else raw[:0]
    ends = np.append(0, np.cumsum(end - start)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
    coded = column.dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    found = runs(words, word_off, least)
    cut, out, text = np.searchsorted(found[:, 0], np.arange(len(size) + 1)), [], flat.tobytes()
    for k, n in enumerate(size):
        own, a = found[cut[k] : cut[k + 1], 1:], word_off[k]
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in own.tolist())
        keep = collapsed(int(n), own) + a
        joined = b" ".join(text[x:y] for x, y in zip(ends[keep].tolist(), ends[keep + 1].tolist(), strict=True))
        best = (None,) * 4
        if len(own):
            s, length, p = own[np.lexsort((own[:, 2], own[:, 0], -own[:, 1]))[0]].tolist()
            best = (s, length, p, 1000 * length // p)
        out.append((len(own), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(joined).hexdigest()))
    return out


def find_runs(docs: DataFrame, plant: Column | None = None, least: int = LEAST, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_runs, the longest run (start, length, period, exponent_milli; ties to the smallest start,
    then period) and digests of all runs and of the text without the repeats.

    A run has its smallest period, ``least`` words and two periods at least, and cannot be extended. Null, empty and blank texts have
    no words and no run: four nulls, the digests are of nothing. ``plant`` is an unsigned hash that repeats a text's tail as the
    contract says; null or not given: texts stay. Texts go whole to a task, however long, in n ln n pairs dealt in blocks. Repeated rows
    count each; an empty table gives no rows; input columns that share a name with an output are replaced. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    own = [c.split()[0] for c in _SCHEMA.split(", ")]
    kept = [c for c in docs.columns if c != text and c not in own]
    names = [f"_in_{i}" for i in range(len(kept))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], text_or_empty(text).alias("_text"), (F.lit(None) if plant is None else plant).cast("long").alias("_hash"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column("_text"), SLICE_BYTES):
                part = batch.slice(a, b - a)
                raw, off = arrow_bytes(part.column("_text"))
                columns = list(zip(*_rows(raw, off, part.column("_hash").to_pylist(), least), strict=True))
                arrays = [pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for c, n in zip(columns, own, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *arrays], [*names, *own])

    fields = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in names]
    out = rows.mapInArrow(find, ", ".join([*fields, _SCHEMA]))
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], *own)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_runs(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")))
