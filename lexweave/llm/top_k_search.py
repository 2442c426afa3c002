"""Operator 11, exact top-k search by MaxScore over integer vectors.

A shard of vectors is an inverted index: each component has a list of the rows where it is positive and one of those where
it is negative, with the greatest value as a bound. A query's terms are the lists whose rows gain by it. Terms of high bound
are essential: a row that is in none of them cannot reach the k-th score so far, since the other bounds together stay below
it. Essential lists are traversed; the other components of the rows found are probed while their partial score and the
bounds left still reach that score. The best k rows of each shard are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.common import table
from lexweave.llm.vector_ints import MOST_PARTS, integers, kept_vectors, longest

SCALE, TOP, QUERY_STEP = 256, 5, 50
#: Bytes of integers in a shard, and in a block of queries; a task holds one of each.
SHARD_BYTES = 64 << 20
#: A shard smaller than this is not worth a task of its own.
SHARD_ROWS = 512
#: Lists that are traversed before the first bound, rows that are then scored to find it, and components probed between two prunings.
FIRST_LISTS, PROBE_STEP = 6, 4


class Postings:
    """Inverted index of a shard: rows are numbered from 0, in the order of ``ids``."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(matrix.T)
        self.lists = []
        for column in self.columns:
            up, down = np.flatnonzero(column > 0), np.flatnonzero(column < 0)
            self.lists.append(((up, column[up], int(column.max(initial=0))), (down, -column[down], int(-column.min(initial=0)))))

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows whose id is not ``own``; ties to the smaller id."""
        others = np.flatnonzero(self.ids != own)
        if not len(others):
            return others, np.zeros(0, np.int64)
        used = np.flatnonzero(query)
        weight = np.abs(query[used])
        gains = [self.lists[d][0 if query[d] > 0 else 1] for d in used]
        bound = weight * np.array([g[2] for g in gains], np.int64)
        order = np.argsort(-bound, kind="stable")
        used, weight, bound, gains = used[order], weight[order], bound[order], [gains[j] for j in order]
        left = np.append(np.cumsum(bound[::-1])[::-1], 0)  # left[j]: bounds of the terms from j on

        partial, done = np.zeros(len(self.ids), np.int64), 0

        def traverse(upto: int) -> None:
            nonlocal done
            for j in range(done, upto):
                partial[gains[j][0]] += gains[j][1] * weight[j]
            done = max(done, upto)

        traverse(min(FIRST_LISTS, len(used)))
        least = None
        if len(others) > k:
            some = others[np.argpartition(-partial[others], min(4 * k, len(others)) - 1)[: 4 * k]]
            least = int(np.partition(query @ self.columns[:, some], -k)[-k])
        # A row outside the essential lists scores at most left[essential]; it stays out only if that is below the k-th score.
        essential = len(used) if least is None else int(np.searchsorted(-left, -least, "right"))
        if least is None or essential > len(used):  # scores of zero or less compete: rows in no list at all take part
            traverse(len(used))
            rows, essential = others, len(used)
        else:
            traverse(essential)
            essential = done
            rows = others[(partial[others] > 0) & (partial[others] + left[essential] >= least)]
        score = partial[rows]
        # Losses of the traversed components first, then the terms that are not essential, by bound.
        for at in range(0, len(used), PROBE_STEP):
            for j in range(at, min(at + PROBE_STEP, len(used))):
                value = self.columns[used[j], rows] * query[used[j]]
                score += np.minimum(value, 0) if j < essential else value
            if least is not None:
                alive = score + left[max(min(at + PROBE_STEP, len(used)), essential)] >= least
                if not alive.all():
                    rows, score = rows[alive], score[alive]
        if len(rows) > k:
            edge = np.partition(score, -k)[-k]
            rows, score = rows[score >= edge], score[score >= edge]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return rows[best], score[best]


FOUND_SCHEMA = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def _searcher(k: int, scale: int, width: int):
    names = ["query_row", "query_id", "vec_id", "score"]

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        index = Postings(shard.column("_id").to_numpy(), integers(shard.column("_vector"), scale, width))
        vectors, found = integers(block.column("_vector"), scale, width), []
        row, own = block.column("_row").to_numpy(), block.column("_id").to_numpy()
        for q in range(block.num_rows):
            rows, score = index.search(vectors[q], own[q], k)
            found.append((np.full(len(rows), row[q]), np.full(len(rows), own[q]), index.ids[rows], score))
        return pa.table({n: pa.array(np.concatenate(c), pa.int64()) for n, c in zip(names, zip(*found, strict=True), strict=True)})

    return search


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, scale: int = SCALE, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): for each row of ``queries`` its k best rows of ``vectors`` by inner product of
    the floored components; ties to the smaller id. Rows of the query's own id are no candidates.

    Null vectors, and those with null or non-finite components, take no part on either side; so do rows with a null id.
    Missing components of shorter vectors count as zero. Repeated rows are candidates each, and as queries each has its own
    list (told apart by ``query_row``). Fewer than k candidates: all of them; an empty table: no rows. Other columns, whatever
    their names, are not read.

    Shards times blocks of queries: rows are dealt to shards, queries to blocks, evenly whatever their values; every block
    meets every shard in one task that holds one of each. So the queries are shuffled once a shard, and the rows once a block.
    """
    spark = vectors.sparkSession
    pick = lambda df: kept_vectors(df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(vector).alias("_vector")), "_vector")
    rows, asked = pick(vectors), pick(queries)
    (n, wide), (m, wide_asked) = longest(rows, "_vector"), longest(asked, "_vector")
    width = max(wide, wide_asked, 1)
    if width > MOST_PARTS:
        raise ArithmeticError(f"{width} components; at most {MOST_PARTS} are summed without a wrap")
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-m * width * 8 // SHARD_BYTES))
    shards = max(1, -(-n * width * 8 // SHARD_BYTES), min(-(-3 * cores // blocks), -(-n // SHARD_ROWS)))
    dealt = lambda count: F.pmod(F.xxhash64("_id", "_row"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    numbered = lambda df: df.withColumn("_row", F.monotonically_increasing_id())
    left = numbered(rows).withColumn("_shard", dealt(shards)).withColumn("_block", every(blocks)).select("_shard", "_block", "_id", "_vector")
    right = numbered(asked).withColumn("_block", dealt(blocks)).withColumn("_shard", every(shards)).select("_shard", "_block", "_row", "_id", "_vector")
    found = left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInArrow(_searcher(k, scale, width), FOUND_SCHEMA)
    merged = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k).select("query_row", "query_id", "rank", "vec_id", "score")


def op11_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0)).select("query_id", "rank", "vec_id", "score")


OP11_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
      FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}"""
