"""Shared helpers of the training-data operators: inputs, scratch tables, byte kernels, components.

Nothing here reads an input with anything but Spark's readers, and nothing keeps a table in a folder
that only one machine sees: scratch tables go below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in the contracts: blank and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Odd multipliers of the 64-bit mixers (fixed values).
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
POLY = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table by Spark's Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 64 << 20) -> None:
    """Bound the rows and bytes that Arrow hands to Python at once; texts can be long.

    The settings hold for the session from here on: a lazy result reads them only when it runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; where unset one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lexweave-checkpoint"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles nothing refers to any more; their files go."""
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Tables written once below the shared folder, so that lineage ends there and lost executors cost no more than a reread."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lexweave-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        schema = df.schema
        del df
        self.release()
        return self.load(name, schema)

    def release(self) -> None:
        release(self.spark)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path(name))

    def size(self, name: str) -> int:
        """Bytes on disk, by Hadoop's file system."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return where.getFileSystem(conf).getContentSummary(where).getLength()

    def drop(self, *names: str) -> None:
        """Delete tables that no result still reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            where = jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(conf).delete(where, True)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


# --- byte kernels -----------------------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; wraps on purpose."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct numbers in order; ``np.unique`` took ten times as long for terms of passages."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array without copying; a null is an empty slice.

    ``bytes[offsets[i]:offsets[i + 1]]`` is row i.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def byte_slices(column, most: int = 16_000_000):
    """Cut an Arrow column into runs of rows of about ``most`` bytes: yields (first row, last row + 1)."""
    _, off = arrow_bytes(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n + 1:
        size = max(n + 1, 1 << 20)
        up = np.full(size, POLY, np.uint64)
        up[0] = 1
        inverse = np.uint64(pow(int(POLY), -1, 1 << 64))
        down = np.full(size, inverse, np.uint64)
        down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


class SpanHasher:
    """64-bit hashes of spans [start, end) by one pass of prefix sums; equal spans get equal hashes.

    For candidates that are compared afterwards only: texts can be made whose polynomials modulo 2**64 meet.
    """

    def __init__(self, raw: np.ndarray):
        up, self.down = _power_tables(len(raw))
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return SpanHasher(raw)(start, end)


#: Longer words are hashed by the library, one by one; equal words have equal lengths, so they take the same way.
LONG_WORD = 64


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span [start, end), eight bytes at a time with a mixer after each, so that no structure of the text makes two meet."""
    size = end - start
    buffer = np.append(raw, np.zeros(8, np.uint8)).tobytes()
    eight = np.ndarray((len(raw) + 1,), "<u8", buffer, strides=(1,))  # the eight bytes from each position on
    out = size.astype(np.uint64) * MIX_A
    some = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at = 0
    while len(some):
        rest = size[some] - at
        part = eight[start[some] + at]
        part &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(rest, 8)) * 8).astype(np.uint64)
        out[some] = mix64(out[some] * POLY + part)
        some, at = some[rest > 8], at + 8
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(buffer[start[k] : end[k]])
    return out


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))


def ascii_lower(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of all words ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~is_space(raw)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[cuts - 1] = solid[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


# --- connected components ---------------------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch, label: str, most_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable over undirected ``edges(src, dst)``; only nodes that have edges.

    Alternates "large star" and "small star": each round points every neighbour of a node to the smallest node
    it sees, and stops when the edges are stars. Every step is a shuffled aggregate or join on a node, so a hub
    costs partial minima rather than one task with all its edges in memory. Each round is written to the shared folder.
    """
    spark = scratch.spark
    now = scratch.save(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(),
        f"{label}-0",
    )
    stats = None
    for k in range(most_rounds):
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        near = large.where("src <> dst").distinct()
        least = near.groupBy("src").agg(F.min("dst").alias("low"))
        small = near.join(least, "src").select(
            F.explode(F.array(F.struct(F.col("src"), F.col("low")), F.struct(F.col("dst").alias("src"), F.col("low")))).alias("e")
        )
        nxt = small.select("e.src", F.col("e.low").alias("dst")).where("src <> dst").distinct()
        nxt = scratch.save(nxt, f"{label}-{k + 1}")
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if k:
            scratch.drop(f"{label}-{k}")
        now = nxt
        if tuple(seen) == stats:
            break
        stats = tuple(seen)
    else:
        raise RuntimeError(f"components of {label} did not settle in {most_rounds} rounds")
    members = now.groupBy("src").agg(F.min("dst").alias("component"))
    roots = now.select(F.col("dst").alias("node")).distinct()
    return members.select(F.col("src").alias("node"), "component").unionByName(roots.select("node", F.col("node").alias("component")))
