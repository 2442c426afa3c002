"""Operator 5, benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed terms over all passages of all documents, in counters of fixed size.
2. Distributed randomised SVD of the TF-IDF rows of all distinct passages: executors multiply, the driver only orthonormalises
   a (terms x rank) block of fixed size. Nothing is sampled.
3. Every window of every document, of about an item's length, is compared with the item by cosine in latent space; those that
   reach COSINE are candidates, and nothing else is.
4. Candidates are checked by an answer check, the item's answer, or else its rarest words, must mostly be in the window, and by
   longest common subsequence of words.

Shuffled are counters, the passages' terms once (two bytes a word, to find equal ones) and blocks of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import POLY, Scratch, arrow_bytes, ascii_lower, byte_slices, distinct, mix64, release, small_batches, table, word_hashes, word_spans

#: Hashed terms, rank of the latent space, spare directions, rounds of subspace iteration. The first SHARED directions, which
#: all passages of a language have in common, are left out of comparisons.
TERMS, RANK, SPARE, ROUNDS, SHARED = 1 << 15, 72, 8, 3, 8
#: In a corpus of fewer passages than LANGUAGE times the rank the first directions are single texts, not a language; all are kept there.
LANGUAGE = 10
#: Words in a block; windows start at blocks. Words in a fitted passage.
STEP, PASSAGE = 8, 48
#: Least cosine of a candidate, least share of the item's words in the common subsequence, least share of answer words.
COSINE, COMMON, ANSWER = 0.25, 0.6, 0.5
RARE = 6
#: Items up to so many bytes and so many rows are broadcast; more are searched in turns of that size.
ITEM_BYTES, ITEM_ROWS = 32_000_000, 50_000
#: Bits of an item's word signature, row slices in which blocks of the SVD are added up, and least passages for a task that makes one.
SIGNATURE, SLICES, TASK_PASSAGES = 4096, 32, 250_000
#: Passages that are multiplied at a time.
GROUP = 8
#: Windows that are compared at a time.
WINDOWS = 2048


def terms_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, row) of lower-cased words."""
    raw, off = arrow_bytes(column)
    start, end, row = word_spans(raw, off)
    return word_hashes(ascii_lower(raw), start, end), row


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(TERMS)).astype(np.int64)


def _within(row: np.ndarray) -> np.ndarray:
    """Number of each word within its row."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    return np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))


def passages_of(docs: DataFrame) -> DataFrame:
    """(h, terms) of each passage of all documents, and from each task a row (df, passages) with the counts of its passages.

    ``terms``: a passage's terms in order, repeated ones too, as unsigned 16-bit numbers; ``h``: the sum of its words' hashes.
    """
    small_batches(docs.sparkSession)
    names = ["h", "terms", "df", "passages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, passages = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for a, b in byte_slices(batch.column("text"), 4_000_000):
                h, row = terms_of(batch.column("text").slice(a, b - a))
                if not len(h):
                    continue
                k = _within(row) // PASSAGE
                new = np.append(True, (row[1:] != row[:-1]) | (k[1:] != k[:-1]))
                first = np.flatnonzero(new)
                held = np.sort((np.cumsum(new) - 1) * TERMS + slot(h))
                terms = held % TERMS
                df += np.bincount(terms[np.append(True, held[1:] != held[:-1])], minlength=TERMS)
                passages += len(first)
                bounds = (2 * np.append(first, len(h))).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(terms.astype("<u2"))])
                none = [pa.nulls(len(first), pa.binary()), pa.nulls(len(first), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.add.reduceat(h, first).view(np.int64)), packed, *none], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([df.astype("<i8").tobytes()]), pa.array([passages], pa.int64())], names)

    return docs.select("text").mapInArrow(run, "h bigint, terms binary, df binary, passages bigint")


def counts_of(passages: DataFrame) -> tuple[np.ndarray, int]:
    """(passages that hold each hashed term, passages) from the rows of ``passages_of``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, passages = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for v, n in zip(batch.column("df").to_pylist(), batch.column("passages").to_pylist(), strict=True):
                df, passages = df + np.frombuffer(v, "<i8"), passages + n
        yield pa.RecordBatch.from_arrays([pa.array([df.astype("<i8").tobytes()]), pa.array([passages], pa.int64())], ["df", "passages"])

    shape = "df binary, passages bigint"
    some = passages.where("df IS NOT NULL").select("df", "passages").repartition(8).mapInArrow(add, shape).collect()  # eight rows of 256 KB
    return sum((np.frombuffer(r["df"], "<i8") for r in some), np.zeros(TERMS, np.int64)), sum(r["passages"] for r in some)


def passage_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(passages that hold each hashed term, passages) over whole texts of all documents."""
    return counts_of(passages_of(docs))


def idf_of(df: np.ndarray, passages: int) -> np.ndarray:
    return np.log((1 + passages) / (1 + df)).astype(np.float32)


def fit_rows(passages: DataFrame) -> DataFrame:
    """(h, terms) of all distinct passages: those with the same words, in whatever order, as far as the sum of the words' hashes tells, are one."""
    return passages.where("h IS NOT NULL").select("h", "terms").dropDuplicates(["h"])


def weighted_rows(column, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, passage, weight) of the unit TF-IDF rows of a column of packed terms, by passage and term."""
    raw, off = arrow_bytes(column)
    terms = np.frombuffer(raw.tobytes(), "<u2").astype(np.int64)
    passage = np.repeat(np.arange(len(off) - 1), np.diff(off) // 2)
    first = np.flatnonzero(np.append(True, (terms[1:] != terms[:-1]) | (passage[1:] != passage[:-1])))
    ids, own = terms[first], passage[first]
    w = np.diff(np.append(first, len(terms))) * idf[ids]
    return ids, own, (w / (np.sqrt(np.bincount(own, w * w, len(off) - 1)) + 1e-9)[own]).astype(np.float32)


def signs_of(h: np.ndarray, many: int) -> np.ndarray:
    """(passages x many) of random signs that depend on a passage's hash alone."""
    parts = [mix64(h * POLY + np.uint64(k)) for k in range(1, -(-many // 64) + 1)]
    return np.unpackbits(np.stack(parts, 1).view(np.uint8), axis=1)[:, :many].astype(np.float32) * 2 - 1


def add_products(out: np.ndarray, column, idf: np.ndarray, right: np.ndarray, basis: bool) -> None:
    """Add X'X right to ``out`` if ``right`` is a basis, else X'right, which has a row for each passage; X: the rows of the column.

    X is multiplied GROUP passages at a time, as a dense block over the terms that they hold.
    """
    ids, own, w = weighted_rows(column, idf)
    group = own // GROUP
    order = np.argsort(group * TERMS + ids)
    key = (group * TERMS + ids)[order]
    new = np.append(True, key[1:] != key[:-1])
    terms, groups = key[new] % TERMS, np.arange(-(-len(column) // GROUP) + 1)
    first = np.searchsorted(key[new] // TERMS, groups)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    at = (own - group * GROUP) * np.diff(first)[group] + place - first[group]
    first, cuts = first.tolist(), np.searchsorted(group, groups).tolist()
    for g in range(len(first) - 1):
        some = terms[first[g] : first[g + 1]]
        block = np.zeros(GROUP * len(some), np.float32)
        block[at[cuts[g] : cuts[g + 1]]] = w[cuts[g] : cuts[g + 1]]
        block = block.reshape(GROUP, len(some))
        mine = right[g * GROUP : (g + 1) * GROUP]
        out[some] += block.T @ (block @ right.take(some, 0)) if basis else block[: len(mine)].T @ mine


def orthonormal(z: np.ndarray) -> None:
    """Put an orthonormal basis of z's columns in their place: slices of rows are factored one by one, then their triangles together, so that no whole copy is made."""
    wide = z.shape[1]
    parts = np.array_split(z, max(1, min(SLICES, len(z) // wide)))
    turn = np.linalg.qr(np.vstack([np.linalg.qr(x.astype(np.float64), mode="r") for x in parts]))[0]
    for k, x in enumerate(parts):
        x[:] = np.linalg.qr(x.astype(np.float64))[0] @ turn[k * wide : (k + 1) * wide]


def latent_basis(rows: DataFrame, idf: np.ndarray, rank: int = RANK, rounds: int = ROUNDS, shared: int = SHARED) -> np.ndarray:
    """(TERMS x (rank - shared)) right singular vectors of the TF-IDF rows by randomised subspace iteration.

    The first of ``rounds`` passes adds up the rows with random signs, the others multiply. Products and their sums are made on
    executors, slice by slice; the driver gets one block of TERMS x (rank + SPARE) numbers for each round, as Arrow batches, and
    holds it once; what the round before has left in the JVM goes first.
    """
    spark, each, wide = rows.sparkSession, TERMS // SLICES, rank + SPARE
    q = None
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((q, idf))  # of fixed size, whatever the input

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            basis, weights = held.value
            out = np.zeros((TERMS, wide), np.float32)
            for batch in batches:
                right = signs_of(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), wide) if basis is None else basis
                if len(right):
                    add_products(out, batch.column("terms"), weights, right, basis is not None)
            for k in range(SLICES):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out[k * each : (k + 1) * each].tobytes()], pa.binary())], ["slice", "block"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, v in zip(batch.column("slice").to_pylist(), batch.column("block").to_pylist(), strict=True):
                    sums[k] = sums.get(k, 0) + np.frombuffer(v, np.float32)
            for k, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["slice", "block"])

        q = None
        shape = "slice int, block binary"
        found = rows.mapInArrow(run, shape).repartition(8, "slice").mapInArrow(add, shape).toArrow()  # SLICES rows, 10 MB in all
        held.destroy()
        q = np.zeros((TERMS, wide), np.float32)
        for batch in found.to_batches():
            slices, raw = batch.column("slice").to_pylist(), arrow_bytes(batch.column("block"))[0].view(np.float32)
            for k, block in zip(slices, raw.reshape(len(slices), each, wide), strict=True):
                q[k * each : (k + 1) * each] = block
        del found
        release(spark)
        if not q.any():  # nothing to fit on: any basis will do
            q = np.eye(*q.shape, dtype=np.float32)
        orthonormal(q)
    return np.ascontiguousarray(q[:, shared:rank], np.float32)


@dataclass
class Items:
    """Benchmark items: ids, word hashes, latent unit vectors grouped by window size, answer words, word signatures."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    sizes: np.ndarray
    vectors: np.ndarray
    signs: np.ndarray


def bits_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % SIGNATURE


def prepare_items(rows: list, idf: np.ndarray, basis: np.ndarray) -> Items:
    """From (item_id, text, answer) rows; items without words are left out. Without an answer the rarest words stand for it."""
    ids, words, answers, sizes, vectors = [], [], [], [], []
    for item, text, answer in rows:
        h, _ = terms_of(pa.array([text or ""]))
        if not len(h) or item is None:
            continue
        asked = np.unique(terms_of(pa.array([answer or ""]))[0])
        if not len(asked):
            distinct = np.unique(h)
            asked = distinct[np.argsort(-idf[slot(distinct)], kind="stable")[:RARE]]
        v = idf[slot(h)] @ basis[slot(h)]
        ids.append(item), words.append(h), answers.append(asked), sizes.append(-(-len(h) // STEP) + 1), vectors.append(v / (np.linalg.norm(v) + 1e-9))
    signs = np.zeros((len(ids), SIGNATURE // 8), np.uint8)  # a bit for each word, so that a signature never misses one
    for i, w in enumerate(words):
        at = bits_of(w)
        np.bitwise_or.at(signs[i], at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return Items(ids, words, answers, np.array(sizes, np.int64), np.array(vectors, np.float32).reshape(len(ids), basis.shape[1]), signs)


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def answered(h: np.ndarray, block: np.ndarray, row: np.ndarray, row_start: np.ndarray, items: Items, answer: float) -> tuple[np.ndarray, np.ndarray]:
    """(window, item), by window: windows, named by their first block, that hold at least ``answer`` of the item's distinct answer words."""
    asked, owner = np.concatenate(items.answers), np.repeat(np.arange(len(items.ids)), [len(a) for a in items.answers])
    order, least, n = np.argsort(asked, kind="stable"), answer * np.bincount(owner), len(asked)
    low = np.searchsorted(asked[order], h, "left")
    at = np.flatnonzero(asked[order][np.minimum(low, n - 1)] == h)
    low = low[at]
    count = np.searchsorted(asked[order], h[at], "right") - low
    word = order[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]

    def enough(place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """place * items + item of places that hold enough different answer words."""
        one = distinct(place * n + word)
        pair, hits = np.unique(one // n * len(items.ids) + owner[one % n], return_counts=True)
        return pair[hits >= least[pair % len(items.ids)]]

    at = np.repeat(at, count)
    some = np.isin(row[at] * len(items.ids) + owner[word], enough(row[at], word))  # the whole text has them
    held = distinct(block[at[some]] * n + word[some])
    b, word = held // n, held % n
    size = items.sizes[owner[word]]
    window = np.repeat(b, size) - (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    inside = window >= np.repeat(row_start[b], size)
    return np.divmod(enough(window[inside], np.repeat(word, size)[inside]), len(items.ids))


def running_sums(x: np.ndarray, stretch: int = 32) -> None:
    """Running sums down the rows, in place: within stretches of rows, all of them side by side, then over stretches."""
    n = len(x) // stretch * stretch
    parts = x[:n].reshape(-1, stretch, x.shape[1])
    for k in range(1, stretch):
        parts[:, k] += parts[:, k - 1]
    parts[1:] += np.cumsum(parts[:, -1], axis=0)[:-1, None]
    if n:
        x[n : n + 1] += x[n - 1]
    np.cumsum(x[n:], axis=0, out=x[n:])


def window_sums(sums: np.ndarray, at: np.ndarray, size: int, row_end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stop, sums of the blocks from each of ``at`` to its stop): ``size`` blocks, or those up to the row's end where ``first`` says that the row begins there.

    ``at``: consecutive blocks; ``sums``: running sums by block, with ``size`` rows of the last one after it. Other windows over a
    row's end are no windows: their sums mean nothing, and are made because neighbours are read in one stretch.
    """
    a, n = at[0], len(at)
    stop = np.minimum(at + size, row_end[at])
    out = np.empty((n, sums.shape[1]), np.float32)
    np.subtract(sums[a + size : a + size + n], sums[a : a + n], out=out, casting="same_kind")
    short = np.flatnonzero(first & (stop - at < size))
    out[short] = sums[stop[short]] - sums[at[short]]
    return stop, out


def lengths_of(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v)) + np.float32(1e-9)


def search(column, items: Items, weighted: np.ndarray, cosine: float, common: float, answer: float) -> Iterator[tuple[int, int, float, float]]:
    """(row, item, cosine, common share) of verified matches, the best window of each pair of row and item.

    ``weighted``: the basis times each term's weight, and a row of zeros.
    """
    h, row = terms_of(column)
    if not len(h) or not len(items.ids):
        return
    ids = slot(h)
    inner = _within(row)
    firsts = np.flatnonzero(inner % STEP == 0)
    block_row = row[firsts]
    row_end = np.searchsorted(block_row, block_row, "right")
    largest = int(items.sizes.max())
    sums = np.zeros((len(firsts) + 1 + largest, weighted.shape[1]))
    padded = np.full((len(firsts), STEP), TERMS)  # blocks of STEP words; short ones end with a term of no weight
    padded[np.cumsum(inner % STEP == 0) - 1, inner % STEP] = ids
    for a in range(0, len(firsts), 1024):
        total = weighted.take(padded[a : a + 1024, 0], 0)
        for k in range(1, STEP):
            total += weighted.take(padded[a : a + 1024, k], 0)
        sums[a + 1 : a + 1 + len(total)] = total
    running_sums(sums)
    starts = np.append(firsts, len(h))
    windows, theirs = answered(h, np.cumsum(inner % STEP == 0) - 1, row, np.searchsorted(block_row, block_row, "left"), items, answer)
    known = np.append(bits_of(h), np.zeros(STEP * largest, np.int64))
    lengths = np.array([len(w) for w in items.words])
    best: dict[tuple[int, int], tuple[float, float]] = {}
    groups = []
    for size in np.unique(items.sizes).tolist():
        mine, asking = np.flatnonzero(items.sizes == size), items.sizes[theirs] == size
        own = windows[asking]  # by window, then item
        groups.append((size, mine, items.vectors[mine].T, own, np.searchsorted(mine, theirs[asking]), np.searchsorted(own, np.arange(0, len(firsts) + WINDOWS, WINDOWS))))
    for turn, a in enumerate(range(0, len(firsts), WINDOWS)):  # all sizes of the same windows in turn, while their sums are in the cache
        chosen = np.arange(a, min(a + WINDOWS, len(firsts)))
        for size, mine, vectors, own_windows, own_items, cuts in groups:
            stop, v = window_sums(sums, chosen, size, row_end, inner[firsts[chosen]] == 0)
            score = v @ vectors
            whole = (stop - chosen == size) | (inner[firsts[chosen]] == 0)
            if answer > 0:  # of the candidates, those that pass the answer check
                own = slice(cuts[turn], cuts[turn + 1])
                near, which = own_windows[own] - a, own_items[own]
                near, which = near[whole[near]], which[whole[near]]
                cosines = score[near, which] / lengths_of(v[near])
                near, which, cosines = (x[cosines >= cosine] for x in (near, which, cosines))
            else:
                score /= lengths_of(v)[:, None]
                near, which = np.nonzero((score >= cosine) & whole[:, None])
                cosines = score[near, which]
            if not len(near):
                continue
            # Window words that the item has bound the common subsequence from above.
            words = starts[chosen[near]][:, None] + np.arange(STEP * size)
            inside = words < starts[stop[near]][:, None]
            bit = known[words]
            bound = ((items.signs[mine[which][:, None], bit >> 3] >> (bit & 7).astype(np.uint8)) & inside).sum(1)
            some = bound >= common * lengths[mine[which]]
            for i, j, near_by in zip(near[some], which[some], cosines[some], strict=True):
                block, item = chosen[i], mine[j]
                window, asked = h[starts[block] : starts[stop[i]]], items.words[item]
                if np.isin(items.answers[item], window).sum() < answer * len(items.answers[item]):
                    continue
                share = common_words(asked, window) / len(asked)
                key = (int(block_row[block]), int(item))
                if share >= common and share > best.get(key, (0.0, 0.0))[1]:
                    best[key] = (float(near_by), share)
    for (r, item), (score, share) in best.items():
        yield r, items.ids[item], score, share


def contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, cosine: float = COSINE, common: float = COMMON, answer: float = ANSWER) -> DataFrame:
    """(doc_id, item_id, cosine, common) of documents that hold an item's text, changed in part or not.

    Whole texts are searched; null and empty texts and items match nothing; repeated rows give repeated pairs; extra columns are
    ignored. ``benchmark`` has item_id, text and perhaps answer; larger than ITEM_BYTES or ITEM_ROWS it is searched in several
    passes over the texts. Pairs are written to the shared folder, so that the blocks sent to executors can go.
    """
    spark = docs.sparkSession
    small_batches(spark)
    every = scratch.save(passages_of(docs), "passages")
    df, passages = counts_of(every)
    idf = idf_of(df, passages)
    rows = scratch.save(fit_rows(every), "fit").coalesce(max(8, passages // TASK_PASSAGES))
    scratch.drop("passages")
    basis = latent_basis(rows, idf, shared=SHARED if passages >= LANGUAGE * RANK else 0)
    asked = benchmark.select("item_id", "text", (F.col("answer") if "answer" in benchmark.columns else F.lit(None)).cast("string").alias("answer"))
    size, many = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    turns = max(1, -(-size // ITEM_BYTES), -(-many // ITEM_ROWS))
    weighted = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]), basis.dtype)])
    parts = []
    for k in range(turns):
        part = asked if turns == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == k)
        items = prepare_items(sorted(map(tuple, part.collect()), key=lambda r: (r[0] is None, r[0])), idf, basis)  # about ITEM_BYTES and ITEM_ROWS at most
        held = spark.sparkContext.broadcast((items, weighted))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items, weighted = held.value
            for batch in batches:
                for a, b in byte_slices(batch.column("text"), 2_000_000):
                    ids = batch.column("doc_id").slice(a, b - a).to_pylist()
                    found = list(search(batch.column("text").slice(a, b - a), items, weighted, cosine, common, answer))
                    cols = list(zip(*found, strict=True)) or [[], [], [], []]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[r] for r in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                        ["doc_id", "item_id", "cosine", "common"],
                    )

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, item_id bigint, cosine double, common double")
        parts.append(scratch.save(found, f"found-{k}"))
        held.destroy()
    scratch.drop("fit")
    return reduce(DataFrame.unionByName, parts)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without a doc_id stay, repeated rows stay or go together, an empty table gives none."""
    bad = contaminated(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate-stage")).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
