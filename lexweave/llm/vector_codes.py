"""Operator 12, vector code compression: product codes by integer codebooks.

Each vector is cut into equal parts; each part position has a codebook of integer entries. A round assigns every part to its
nearest entry and moves each entry to the floored mean of its parts. The codebooks are small and go out with each round's
task; distances come from |x|^2 - 2xc + |c|^2 in exact int64 matrix products; sums by entry are added within a batch, then by
a shuffle that carries at most one row for each entry and batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import Scratch, small_batches, table
from lexweave.llm.vector_ints import MOST_PARTS, integers, kept_vectors, longest

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def nearest(parts: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), both (rows, positions), of parts (rows, positions, size); ties to the lower index."""
    n, positions, _ = parts.shape
    codes, error = np.zeros((n, positions), np.int64), np.zeros((n, positions), np.int64)
    for p in range(positions):
        x, c = parts[:, p], codebooks[p]
        distance = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
        codes[:, p] = distance.argmin(1)
        error[:, p] = distance[np.arange(n), codes[:, p]]
    return codes, error


def _parts(batch: pa.RecordBatch, scale: int, codebooks: np.ndarray) -> np.ndarray:
    positions, _, size = codebooks.shape
    return integers(batch.column("_vector"), scale, positions * size).reshape(-1, positions, size)


def first_codebooks(rows: DataFrame, id_col: str, scale: int, parts: int, entries: int, size: int) -> np.ndarray:
    """(parts, entries, size): the parts of the vectors of the smallest ids; of a repeated id the smallest vector counts."""
    first = [r[0] for r in rows.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(id_col).limit(entries).collect()]  # ids are shuffled, not vectors
    heads = rows.where(F.col(id_col).isin(first)).groupBy(id_col).agg(F.min("_vector").alias("_vector")).orderBy(id_col).select("_vector").toArrow()
    return np.ascontiguousarray(integers(heads.column("_vector"), scale, parts * size).reshape(-1, parts, size).transpose(1, 0, 2))


def entry_sums(rows: DataFrame, scale: int, codebooks: np.ndarray) -> DataFrame:
    """(position, entry, n, sums): parts assigned to each entry, counted and summed by component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = _parts(batch, scale, codebooks)
            codes, _ = nearest(parts, codebooks)
            out = [[], [], [], []]
            for p in range(codebooks.shape[0]):
                used, where, count = np.unique(codes[:, p], return_inverse=True, return_counts=True)
                total = np.zeros((len(used), codebooks.shape[2]), np.int64)
                np.add.at(total, where, parts[:, p])
                for column, values in zip(out, ([p] * len(used), used, count, total.tolist()), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.list_(pa.int64()))], ["position", "entry", "n", "sums"])

    by_batch = rows.select("_vector").mapInArrow(add, "position bigint, entry bigint, n bigint, sums array<bigint>")
    size = codebooks.shape[2]
    summed = by_batch.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(size)])
    return summed.select("position", "entry", "n", F.array(*[f"s{j}" for j in range(size)]).alias("sums"))


def fit_codebooks(rows: DataFrame, scale: int, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """``rounds`` rounds over all rows; the driver gets at most one row for each entry and round."""
    for _ in range(rounds):
        moved = codebooks.copy()
        for position, entry, n, sums in entry_sums(rows, scale, codebooks).collect():
            moved[position, entry] = np.array(sums, np.int64) // n
        codebooks = moved
    return codebooks


def encode(rows: DataFrame, scale: int, codebooks: np.ndarray, keys: list[str]) -> DataFrame:
    """``keys`` of rows with code (two hex digits a part) and error (squared distances summed over parts)."""
    digits = np.array([f"{k:02x}" for k in range(codebooks.shape[1])])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, error = nearest(_parts(batch, scale, codebooks), codebooks)
            text = ["".join(c) for c in digits[codes].tolist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(text, pa.string()), pa.array(error.sum(1), pa.int64())], [*keys, "code", "error"])

    fields = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.select(*keys, "_vector").mapInArrow(code, ", ".join([*fields, "code string", "error bigint"]))


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error), codebooks): every usable vector coded by codebooks fitted on all of them.

    Null vectors and those with null or non-finite components are dropped; null ids start no entry, null labels are values like others. The
    length of the longest vector, rounded up to a multiple of ``parts``, is cut; components missing from shorter ones count as
    zero. Fewer ids than ``entries``: so many entries. Repeated rows count and are coded each. An empty table: no rows.
    Columns that are not named are not read. A component beyond 2**26 after scaling raises ArithmeticError.
    """
    small_batches(vectors.sparkSession, 20_000)
    rows = kept_vectors(vectors.select(F.col(id_col).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_vector")), "_vector")
    _, wide = longest(rows, "_vector")
    size = max(1, -(-wide // parts))
    if size * parts > MOST_PARTS:
        raise ArithmeticError(f"{wide} components; at most {MOST_PARTS} are summed without a wrap")
    codebooks = fit_codebooks(rows, scale, first_codebooks(rows, "_id", scale, parts, entries, size), rounds)
    coded = encode(rows, scale, codebooks, ["_id", "_label"])
    return coded.select(F.col("_id").alias(id_col), F.col("_label").alias(label), "code", "error"), codebooks


def with_label_errors(coded: DataFrame, scratch: Scratch, label: str = "label") -> DataFrame:
    """``coded`` with label_error, the error summed over equal labels, nulls together.

    Codes and sums are tables of their own, so that the join knows their sizes and can split a label that a large part of all rows has.
    """
    rows = scratch.save(coded.withColumn("_null", F.col(label).isNull()).withColumn("_key", F.coalesce(label, F.lit(0).cast(coded.schema[label].dataType))), "codes")
    sums = scratch.save(rows.groupBy("_null", "_key").agg(F.sum("error").alias("label_error")), "label-errors")
    return rows.join(sums, ["_null", "_key"]).drop("_null", "_key")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = compress(table(spark, sf_dir, "embeddings"))
    out = with_label_errors(coded, Scratch(spark, "vector-codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after another; components in rows."""
    size = "(SELECT max(len(embedding)) // 8 FROM k)"
    steps = f"""
WITH k AS (SELECT vec_id, label, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM k),
v AS MATERIALIZED (SELECT vec_id, label, i // {size} AS part, i % {size} AS j, x FROM c),
b0 AS (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, j, x FROM v WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES}))"""
    for r in range(ROUNDS + 1):
        steps += f""",
d{r} AS (SELECT v.vec_id, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS dist FROM v JOIN b{r} AS b USING (part, j) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT vec_id, part, entry, dist FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) = 1)"""
        if r < ROUNDS:
            steps += f""",
m{r} AS (SELECT part, a.entry, j, sum(x) AS s, count(*) AS n FROM v JOIN a{r} AS a USING (vec_id, part) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, b.entry, j, CAST(CASE WHEN n IS NULL THEN b.x ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS x
       FROM b{r} AS b LEFT JOIN m{r} USING (part, entry, j))"""
    return f"""{steps},
o AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, j)) FROM b{ROUNDS}) AS codebooks_sha256
FROM o JOIN k USING (vec_id)"""


OP12_SQL = _sql()
