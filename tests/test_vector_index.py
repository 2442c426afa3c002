"""The vector index against all products: exact, filtered, approximate; a cell of half the rows; nearest labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import vector_index, vectors

SHAPE = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    m = r.normal(0, 0.2, (600, 12)).astype(np.float32)
    m[300:] = m[300] + r.normal(0, 0.001, (300, 12))  # half of all rows lie in one cell
    m[400:420] = m[400]  # ties
    return [(k, v.tolist(), k % 7) for k, v in enumerate(m)] + [(900, None, 1)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    vector_index.build(spark.createDataFrame(rows, SHAPE), path)
    return vector_index.VectorIndex(spark, path)


def best(rows, asked, k, where=lambda r: True):
    out = set()
    for q in asked:
        s = sorted((-round(float(np.dot(np.float64(rows[q][1]), np.float64(v))), 6), i) for i, v, label in rows if v is not None and where((i, v, label)))
        out |= {(q, i, n + 1) for n, (_, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("group", [16_384, 50])
def test_exact_search_equals_all_products(spark, rows, index, monkeypatch, group):
    monkeypatch.setattr(vector_index, "QUERY_ROWS", group)
    index.groups = np.maximum(1, index.groups * 16_384 // group // 8)
    asked = [0, 7, 300, 400, 599]
    q = spark.createDataFrame([(k, rows[k][1]) for k in asked] + [(1000, None)], "query_id bigint, embedding array<float>")
    got = {(r.query_id, r.vec_id, r.rank) for r in index.search(q, 6, exact=True).collect()}
    assert got == best(rows, asked, 6)
    got = {(r.query_id, r.vec_id, r.rank) for r in index.search(q, 100, where=F.col("label") == 3).collect()}  # 86 rows pass: all of them, for every query
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in best(rows, asked, 100, lambda r: r[2] == 3)} and len(got) == 5 * 86


def test_filter_before_the_best(spark, rows):
    v = spark.createDataFrame(rows[:600], SHAPE)
    got = vectors.top_k_in_branch(v, v.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 30, F.col("label") == 3)
    assert {(r.query_id, r.vec_id, r.rank) for r in got.collect()} == best(rows[:600], [0], 30, lambda r: r[2] == 3)


def test_recall_without_proof(spark, rows, index):
    asked = list(range(0, 600, 20))
    q = spark.createDataFrame([(k, rows[k][1]) for k in asked], "query_id bigint, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in index.search(q, 5).collect()}
    want = {(a, b) for a, b, _ in best(rows, asked, 5)}
    assert len(got & want) >= 0.95 * len(want)


def test_nearest_labels_equal_all_pairs(spark):
    labels = ["breach of contract", "breach of contracts", "contract", "the rule of law", "rule", "aaa", "bbb", "aaa "]
    keys = ["breach of contract", "breach contract", "rule of law", "xyz", "aaa", "", "breach of contract"]
    got = vector_index.nearest(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(v,) for v in labels], "label string"), 0.7)
    a, b = vectors.trigram_vectors(sorted(set(keys))), vectors.trigram_vectors(sorted(labels))
    want = []
    for key, row in zip(sorted(set(keys)), np.round(a @ b.T, 6), strict=True):
        if row.max() >= 0.7:
            want.append((key, sorted(labels)[int(row.argmax())], float(row.max())))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) >= 3
    assert vector_index.nearest(spark.createDataFrame([], "key string"), spark.createDataFrame([], "label string"), 0.7).collect() == []
