"""Operator 7, n-gram Jaccard self-join with adaptive multi-match prefixes.

1. Each text becomes a set of hashed word shingles; texts with equal sets form one class, of which the smallest doc_id
   goes on. The prefix of a set holds its first tokens in a global order: ascending count in a fixed-size sketch over
   all documents, then hash. Two sets that reach the threshold with overlap o share at least l tokens among their first
   ``size - o + l`` ones, for any l.
2. From the true document frequencies of prefix tokens each document takes the l of least estimated candidate cost: a
   longer prefix means more list entries to scan, but l shared tokens before a pair is verified.
3. Verification in two rounds, so that a group of m copies costs m checks, not m squared: first every document against
   the smallest document of each of its token lists, then, across the components found, only pairs of different
   components. Those lists are cut into blocks, and a pair is put forward only if parity signatures of both sets (bits
   that tokens toggle) allow the threshold: differing bits never exceed differing tokens. No pair that could join two
   components is left out.

Shingles are 64-bit hashes of hashed words, mixed after each step, so that no structure of a text makes two meet; sets are
compared token by token on them. A list of one token holds at most one row per class and document; a document spreads over
its whole prefix, so even a group with a third of all documents gives no token more than a small part of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import POLY, Scratch, arrow_bytes, ascii_lower, byte_slices, components, mix64, small_batches, table, word_hashes, word_spans

WORDS, PERCENT = 4, 85
#: Most shared prefix tokens that a document may ask for; counters of the sketch (2 MB); rows of counters sent at once.
MOST_SHARED, SKETCH, BLOCK = 4, 1 << 18, 4096
#: Bits of a set's parity signature, and rows of one list that are compared in one block.
SIGNATURE, LIST_BLOCK = 1024, 2048
#: Estimated cost of verifying a candidate, in list entries.
VERIFY_COST = 50


def shingle_sets(column, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row: all runs of ``words`` words, or the whole text if it has fewer."""
    raw, off = arrow_bytes(column)
    start, end, row = word_spans(raw, off)
    hashes = word_hashes(ascii_lower(raw), start, end)
    first = np.searchsorted(row, np.arange(len(off)))
    many = len(hashes) - words + 1
    if many > 0:
        grams = np.zeros(many, np.uint64)
        for k in range(words):
            grams = mix64(grams * POLY + hashes[k : k + many])
    for k in range(len(off) - 1):
        a, b = first[k], first[k + 1]
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                whole = mix64(whole * POLY + h)
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def signature(tokens: np.ndarray) -> bytes:
    """Each token toggles one bit; the bits in which two signatures differ are at most the tokens in which two sets differ."""
    bits = (tokens >> np.uint64(20)) % np.uint64(SIGNATURE)
    return np.packbits(np.bincount(bits.astype(np.int64), minlength=SIGNATURE) & 1).tobytes()


def least_overlap(n, percent: int):
    return (percent * n + 99) // 100


def frequency_sketch(docs: DataFrame, words: int) -> np.ndarray:
    """Counts of shingles by hash bucket over all documents: fixed size, whatever the input; summed by block on executors."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for a, b in byte_slices(batch.column("text")):
                sets = list(shingle_sets(batch.column("text").slice(a, b - a), words))
                if sets:
                    total += np.bincount((np.concatenate(sets) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        yield from blocks(total)

    def blocks(total: np.ndarray, which=range(SKETCH // BLOCK)) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(list(which), pa.int32()), pa.array([total[k * BLOCK : (k + 1) * BLOCK].astype("<i8").tobytes() for k in which], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(v, "<i8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"])

    shape = "block int, counts binary"
    out = np.zeros(SKETCH, np.int64)
    for block, counts in docs.select("text").mapInArrow(count, shape).repartition("block").mapInArrow(add, shape).collect():  # 2 MB in all
        out[block * BLOCK : (block + 1) * BLOCK] += np.frombuffer(counts, "<i8")
    return out


def prefixes(docs: DataFrame, words: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """(doc_id, n, key, prefix, sign): set size, digest (null if empty), the longest prefix that may be asked for, parity signature."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value
        for batch in batches:
            for a, b in byte_slices(batch.column("text")):
                sizes, keys, tokens, signs = [], [], [], []
                for s in shingle_sets(batch.column("text").slice(a, b - a), words):
                    n = len(s)
                    take = min(n, n - least_overlap(n, percent) + MOST_SHARED)
                    rank = np.argsort(order[(s % np.uint64(SKETCH)).astype(np.int64)], kind="stable")[:take]
                    sizes.append(n)
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                    tokens.append(s[rank].view(np.int64))
                    signs.append(signature(s))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                    ["doc_id", "n", "key", "prefix", "sign"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n bigint, key binary, prefix array<bigint>, sign binary")


def token_lists(classes: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, shared, low): entries of the lists with two documents or more, cut to each document's own prefix.

    ``shared``: tokens that the document asks for; ``low``: smallest document of the list.
    """
    entries = classes.select("node", "n", F.posexplode("prefix").alias("i", "token"))
    by_token = Window.partitionBy("token")
    lists = entries.withColumns({"df": F.count("*").over(by_token), "low": F.min("node").over(by_token)}).where("df > 1")
    scanned = [F.sum(F.when(F.col("i") < F.col("n") - least(percent) + k, F.col("df") - 1).otherwise(0)).alias(f"s{k}") for k in range(1, MOST_SHARED + 1)]
    costs = [F.struct((F.col(f"s{k}") + F.col(f"s{k}") / F.lit(k) * VERIFY_COST).alias("cost"), F.lit(k).alias("shared")) for k in range(1, MOST_SHARED + 1)]
    usable = [F.when(least(percent) >= k, c) for k, c in zip(range(1, MOST_SHARED + 1), costs, strict=True)]
    chosen = lists.groupBy("node", "n").agg(*scanned).select("node", F.least(*usable)["shared"].alias("shared"))
    return lists.join(chosen, "node").where(F.col("i") < F.col("n") - least(percent) + F.col("shared")).select("token", "node", "n", "shared", "low")


def least(percent: int):
    return F.floor((F.col("n") * percent + 99) / 100)


def verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The (x, y) pairs whose sets reach the threshold; hot ``x`` are split by adaptive skew joins, rows stay single pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column("x_text"), 4_000_000):
                part = batch.slice(a, b - a)
                xs = shingle_sets(part.column("x_text"), words)
                ys = shingle_sets(part.column("y_text"), words)
                keep = []
                for x, y in zip(xs, ys, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
                yield part.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    ys = pairs.join(texts.select(F.col("node").alias("y"), F.col("text").alias("y_text")), "y")
    both = ys.join(texts.select(F.col("node").alias("x"), F.col("text").alias("x_text")), "x")
    return both.select("x", "y", "x_text", "y_text").mapInArrow(run, "x bigint, y bigint")


def cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(x, y, shared) for pairs of different components in one list whose signatures allow the threshold.

    ``lists``: token, node, n, shared, component, sign. Lists over LIST_BLOCK rows are cut into blocks and every pair of
    blocks is a group of its own, so that no task holds more than two blocks of a list.
    """

    def pairs(rows: list[tuple], two: bool) -> pa.RecordBatch:
        node, n, shared, comp, block = (np.array(c, np.int64) for c in zip(*[r[:5] for r in rows], strict=True))
        sign = np.frombuffer(b"".join(r[5] for r in rows), np.uint64).reshape(len(rows), -1)
        xs, ys = [], []
        for a in range(0, len(rows), 256):
            i = np.arange(a, min(a + 256, len(rows)))[:, None]
            j = np.arange(len(rows))[None, :]
            fits = (node[i] < node[j]) & (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            if two:
                fits &= block[i] != block[j]
            x, y = np.nonzero(fits)
            for k in range(0, len(x), 100_000):
                p, q = x[k : k + 100_000] + a, y[k : k + 100_000]
                apart = np.bitwise_count(sign[p] ^ sign[q]).sum(1, dtype=np.int64)
                some = apart * (100 + percent) <= (100 - percent) * (n[p] + n[q])
                xs.append(p[some]), ys.append(q[some])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
        return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y]), pa.array(np.minimum(shared[x], shared[y]))], ["x", "y", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            cols = ("token", "b", "c", "node", "n", "shared", "component", "block", "sign")
            for token, b, c, *row in zip(*[batch.column(k).to_pylist() for k in cols], strict=True):
                if (token, b, c) != group:
                    if len(held) > 1:
                        yield pairs(held, group[1] != group[2])
                    held, group = [], (token, b, c)
                held.append(tuple(row))
        if len(held) > 1:
            yield pairs(held, group[1] != group[2])

    sizes = lists.groupBy("token").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks"), F.min("component").alias("low"), F.max("component").alias("top"))
    mixed = lists.join(sizes.where("low <> top").select("token", "blocks"), "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("block", "other").alias("b"), F.greatest("block", "other").alias("c"), "node", "n", "shared", "component", "block", "sign")
    return dealt.repartition("token", "b", "c").sortWithinPartitions("token", "b", "c").mapInArrow(run, "x bigint, y bigint, shared bigint")


def _sizes_fit(percent: int):
    return 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs`` (doc_id, text); other columns are ignored.

    Documents link when 100 * |intersection| >= percent * |union| of their sets; component_id is the smallest doc_id
    reachable by links. Null, empty and blank texts have empty sets and link with nothing. Repeated rows come out as
    often as they come in; a null doc_id is never linked and is its own (null) component. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = scratch.save(prefixes(docs, words, percent, frequency_sketch(docs, words)), "sets")
    classes = sets.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "n", "prefix", "sign")).alias("c"))
    classes = scratch.save(classes.select(F.col("c.doc_id").alias("node"), "c.n", "c.prefix", "c.sign"), "classes")
    lists = scratch.save(token_lists(classes.select("node", "n", "prefix"), percent), "lists")

    texts = docs.join(lists.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = scratch.save(texts.groupBy("doc_id").agg(F.min("text").alias("text")).withColumnRenamed("doc_id", "node"), "texts")

    sizes = lists.groupBy("node").agg(F.first("n").alias("n"))
    star = lists.where("node <> low").groupBy(F.col("low").alias("x"), F.col("node").alias("y"), F.col("n").alias("y_n")).agg(F.count("*").alias("seen"), F.first("shared").alias("shared")).where("seen >= shared")
    star = star.join(sizes.select(F.col("node").alias("x"), F.col("n").alias("x_n")), "x").where(_sizes_fit(percent)).select("x", "y")
    star = scratch.save(star, "star")
    links = scratch.save(verify(star, texts, words, percent), "links-1")
    found = scratch.save(components(links.select(F.col("x").alias("src"), F.col("y").alias("dst")), scratch, "first"), "components-1")

    grouped = lists.join(found, "node", "left").select("token", "node", "n", "shared", F.coalesce("component", "node").alias("component"))
    met = cross_pairs(grouped.join(classes.select("node", "sign"), "node"), percent)
    pairs = met.groupBy("x", "y").agg(F.count("*").alias("seen"), F.min("shared").alias("shared")).where("seen >= shared").select("x", "y")
    checked = star.unionByName(star.select(F.col("y").alias("x"), F.col("x").alias("y")))
    pairs = scratch.save(pairs.join(checked, ["x", "y"], "left_anti"), "pairs")
    links = links.unionByName(scratch.save(verify(pairs, texts, words, percent), "links-2"))
    found = scratch.save(components(links.select(F.col("x").alias("src"), F.col("y").alias("dst")), scratch, "last"), "components-2")
    scratch.drop("classes", "lists", "texts", "star", "links-1", "components-1", "pairs", "links-2")

    named = sets.groupBy("key").agg(F.min("doc_id").alias("node")).where("key IS NOT NULL").join(found, "node", "left")
    named = named.select("key", F.coalesce("component", "node").alias("component"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "jaccard"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), the one with the smallest doc_id.

    Rows without a set and rows without a doc_id stay; rows that share a doc_id stay or go together; an empty table gives none.
    """
    keep = near_duplicates(docs, Scratch(spark, "jaccard-stage"), 5, 80).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_anti").select(*docs.columns)
