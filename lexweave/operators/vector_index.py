"""A vector index of coarse cells: fitted and stored by Spark, probed cell by cell, exact where asked.

The vectors are stored by cell, so that a probe reads the folders of its cells only; a filter over stored columns works inside
the probe. Each cell knows its centre and its radius, so no vector in it can score more than ``q.c + |q| r``: a second pass
over the cells that could still hold a better vector makes a search exact, and finds k rows wherever k pass the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.operators.vectors import trigram_vectors
from lexweave.sources.shared import fresh_dir

#: Most cells of an index; their centres are what the driver and every task hold.
MOST_CELLS = 4096
#: Vectors, and queries, that a task compares at once.
GROUP_ROWS, QUERY_ROWS = 16_384, 4096
ROUNDS = 5
#: Part of the cells that a first pass probes, and by how much a cell is taken to reach out in the second, in deviations of a
#: residual of any direction: its radius over the root of the number of components. The whole radius would be a proof.
#: This is the least; see ``reach_of``.
PROBED, REACH = 0.05, 3.5
_SLACK = 2e-6  # similarities are rounded to six digits


def _matrix(column, width: int = 0) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if len(column) else width)


def _cell_of(m: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest cell, distance) of each row."""
    d = np.maximum((m * m).sum(1)[:, None] - 2 * m @ centres.T + (centres * centres).sum(1)[None, :], 0)
    cell = d.argmin(1)
    return cell, np.linalg.norm(m - centres[cell], axis=1)


def reach_of(rows: int) -> float:
    """Deviations beyond which one residual of so many lies, if they are normal: the more vectors, the further out the best of them are."""
    return max(REACH, NormalDist().inv_cdf(1 - 1 / max(rows, 2)))


def fit_cells(vectors: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds over all rows: sums by cell are added within batches, then by a shuffle; the driver gets the centres."""
    heads = vectors.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(cells).select("embedding").toArrow()
    centres = np.unique(_matrix(heads.column("embedding")), axis=0) if heads.num_rows else np.zeros((0, 0))
    width = centres.shape[1]
    for _ in range(rounds if len(centres) else 0):

        def add(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    m = _matrix(batch.column("embedding"))
                    cell, _ = _cell_of(m, centres)
                    used, where, n = np.unique(cell, return_inverse=True, return_counts=True)
                    total = np.zeros((len(used), m.shape[1]))
                    np.add.at(total, where, m)
                    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n, pa.int64()), pa.array(list(total), pa.list_(pa.float64()))], ["cell", "n", "sums"])

        part = vectors.select("embedding").mapInArrow(add, "cell bigint, n bigint, sums array<double>")
        moved = part.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums"))
        centres = centres.copy()
        for cell, n, sums in moved.collect():
            centres[cell] = np.array(sums) / n
    return centres


def build(vectors: DataFrame, path: str, cells: int | None = None, rounds: int = ROUNDS) -> None:
    """Store ``vectors`` (vec_id, embedding, and columns for filters) under ``path``, by cell; null vectors are left out.

    All vectors have one length. The number of cells is the root of the number of rows, up to MOST_CELLS.
    """
    spark, rows = vectors.sparkSession, vectors.where(F.col("embedding").isNotNull())
    count = rows.count()
    centres = fit_cells(rows, max(1, min(MOST_CELLS, cells or int(count**0.5))), rounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("embedding"), centres.shape[1])
            cell, far = _cell_of(m, centres) if len(m) else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], [*batch.schema.names, "cell", "_far"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.mapInArrow(place, f"{fields}, cell int, _far double")
    # By ranges of cell and id, so that a large cell is several files and a small one shares its task.
    placed.repartitionByRange("cell", "vec_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema(f"{fields}, cell int, _far double").parquet(f"{path}/vectors")
    sizes = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("_far").alias("radius"))
    known = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
    known.join(sizes, "cell").write.mode("overwrite").parquet(f"{path}/cells")


def _compare(k: int):
    names = ["query_id", "vec_id", "similarity"]

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows.num_rows and asked.num_rows:
            ids, q = rows.column("vec_id").to_numpy(), asked.column("query_id").to_numpy()
            s = np.round(_matrix(asked.column("_q")) @ _matrix(rows.column("embedding")).T, 6)
            for at in range(len(q)):
                some = np.flatnonzero(s[at] >= np.partition(s[at], -k)[-k]) if len(ids) > k else np.arange(len(ids))
                best = some[np.lexsort((ids[some], -s[at, some]))][:k]
                out[0].append(np.full(len(best), q[at])), out[1].append(ids[best]), out[2].append(s[at, best])
        flat = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, flat, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return run


class VectorIndex:
    """A stored index: ``search`` and the cells that it probes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
        self.cells, self.radius = cells.column("cell").to_numpy(), cells.column("radius").to_numpy()
        self.centres = _matrix(cells.column("centre"))
        self.groups = np.maximum(1, -(-cells.column("n").to_numpy() // GROUP_ROWS))
        self.reach = reach_of(int(cells.column("n").to_numpy().sum()))

    def _probes(self, asked: DataFrame, first: int, second: bool, reach: float = 1.0) -> DataFrame:
        """(query_id, _q, cell, groups): the ``first`` cells of highest bound; ``second``: the others whose bound reaches ``kth``."""
        cells, centres, radius, groups = self.cells, self.centres, self.radius * reach, self.groups
        names = ["query_id", "_q", "cell", "groups"]

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(cells):
                    continue
                q = _matrix(batch.column("_q"))
                near = q @ centres.T
                bound = near + np.linalg.norm(q, axis=1)[:, None] * radius[None, :]
                rank = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1)
                taken = rank < first
                if second:
                    taken = ~taken & (bound + _SLACK >= batch.column("kth").to_numpy()[:, None])
                row, at = np.nonzero(taken)
                for a in range(0, len(row), 50_000):
                    r = pa.array(row[a : a + 50_000])
                    yield pa.RecordBatch.from_arrays([batch.column("query_id").take(r), batch.column("_q").take(r), pa.array(cells[at[a : a + 50_000]], pa.int32()), pa.array(groups[at[a : a + 50_000]], pa.int64())], names)

        return asked.mapInArrow(choose, "query_id bigint, _q array<double>, cell int, groups bigint")

    def _pass(self, probes: DataFrame, k: int, where: Column | None) -> DataFrame:
        if not len(self.cells):  # an index of no vectors
            return self.spark.createDataFrame([], "query_id bigint, vec_id bigint, similarity double")
        stored = self.spark.read.parquet(f"{self.path}/vectors")
        stored = stored.where(where) if where is not None else stored
        sizes = self.spark.createDataFrame([(int(c), int(g)) for c, g in zip(self.cells, self.groups, strict=True)], "cell int, groups long")
        # Large cells are dealt in groups of rows, much asked ones in groups of queries; a task holds one of each.
        many = probes.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("asks"))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
        rows = stored.select("cell", "vec_id", "embedding").join(F.broadcast(sizes), "cell").join(F.broadcast(many), "cell")  # one small row for each of at most MOST_CELLS cells
        rows = rows.withColumn("g", deal("vec_id", "groups")).withColumn("h", each("asks")).select("cell", "g", "h", "vec_id", "embedding")
        asked = probes.join(F.broadcast(many), "cell").withColumn("h", deal("query_id", "asks")).withColumn("g", each("groups")).select("cell", "g", "h", "query_id", "_q")
        return rows.groupBy("cell", "g", "h").cogroup(asked.groupBy("cell", "g", "h")).applyInArrow(_compare(k), "query_id bigint, vec_id bigint, similarity double")

    def search(self, queries: DataFrame, k: int, where: Column | None = None, exact: bool = False, reach: float | None = None, least: float | None = None) -> DataFrame:
        """(query_id, vec_id, similarity, rank): the k best stored vectors of each query (query_id, embedding) that pass ``where``.

        Ties to the smaller id; similarities are rounded to six digits. A first pass over a few cells gives each query its k-th similarity,
        a second takes the other cells that could hold a better one: surely (``exact``), or by ``reach``, which grows with the index where it is not given. Queries that find fewer than k are
        led to all cells. ``least``: only rows of that similarity, found exactly. Queries without a vector find nothing.
        """
        asked = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("_q"))
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if least is not None:
            found = self._pass(self._probes(asked.withColumn("kth", F.lit(float(least))), 0, True), k, where)
            return ranked(found.where(F.col("similarity") >= least))
        first = max(1, int(np.ceil(PROBED * len(self.cells))))
        kept = fresh_dir(self.spark, "probe")
        ranked(self._pass(self._probes(asked, first, False), k, where)).write.parquet(kept)
        near = self.spark.read.parquet(kept)
        edge = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("kth"))
        share = 1.0 if exact else min(1.0, (self.reach if reach is None else reach) / max(1, self.centres.shape[1]) ** 0.5)
        again = asked.join(edge, "query_id", "left").select("query_id", "_q", F.when(F.coalesce("n", F.lit(0)) < k, float("-inf")).otherwise(F.col("kth")).alias("kth"))
        more = self._pass(self._probes(again, first, True, share), k, where)
        return ranked(near.drop("rank").unionByName(more))


def nearest(rows: DataFrame, known: DataFrame, least: float, embed: Callable[[list[str]], np.ndarray] = trigram_vectors) -> DataFrame:
    """(key, label, similarity): for each distinct text (key) the most similar label of ``known`` (label) that reaches ``least``; ties to the first label.

    Labels and texts are embedded on executors; the labels' index tells which cells can reach ``least``.
    """
    spark, path = rows.sparkSession, fresh_dir(rows.sparkSession, "labels")

    def vectors_of(df: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = embed(batch.column(name).to_pylist()) if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(v) for v in made], pa.list_(pa.float64()))], [*batch.schema.names, "embedding"])

        return df.mapInArrow(run, f"{name} string, id bigint, embedding array<double>")

    def numbered(df: DataFrame, name: str) -> DataFrame:
        """A table of its own, so that numbers stay."""
        vectors_of(df.withColumn("id", F.monotonically_increasing_id()), name).write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    some = lambda df, name: df.select(name).where(F.col(name).isNotNull()).distinct()
    labels, keys = numbered(some(known, "label").orderBy("label"), "label"), numbered(some(rows, "key"), "key")  # numbers of labels rise with the text, as ties need
    build(labels.select(F.col("id").alias("vec_id"), "embedding"), f"{path}/index")
    found = VectorIndex(spark, f"{path}/index").search(keys.select(F.col("id").alias("query_id"), "embedding"), 1, least=least)
    out = found.join(keys.select(F.col("id").alias("query_id"), "key"), "query_id").join(labels.select(F.col("id").alias("vec_id"), "label"), "vec_id")
    return out.select("key", "label", "similarity")
