"""Top-k search, vector codes and periodic runs on small tables with nulls, ties, repeated rows, odd lengths, against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lexweave.llm import periodic_runs, top_k_search, vector_codes
from lexweave.llm.common import Scratch
from lexweave.llm.registry import SQL
from tests.duck import connect, rows

VECTORS = "vec_id bigint, embedding array<float>, label int, score string, query_id string"


def vectors() -> list[tuple]:
    r = random.Random(3)
    out = [(k, [r.gauss(0, 0.3) for _ in range(16)], r.choice([0, 1, 2, None]), "x", "y") for k in range(90)]
    out += [(100 + k, out[7][1], 1, "x", "y") for k in range(30)]  # one vector of many rows: ties
    out += [(200, None, 1, "x", "y"), (250, [0.1, None] + [0.0] * 14, 1, "x", "y"), (300, [math.nan] * 16, 1, "x", "y"), (350, [math.inf] + [0.0] * 15, None, "x", "y")]
    out += [(400, [0.0] * 16, 2, "x", "y"), (450, [-0.5] * 16, 2, "x", "y"), (500, [0.5] * 16, None, "x", "y"), (50, out[50][1], 1, "x", "y")]
    return out


def usable(data: list[tuple]) -> list[tuple]:
    return [v for v in data if v[1] is not None and all(x is not None and math.isfinite(x) for x in v[1])]


def floored(v, scale):
    return [math.floor(float(np.float32(x)) * scale) for x in v]


@pytest.mark.parametrize("k", [1, 5, 200])
@pytest.mark.parametrize("shard_rows, shard_bytes", [(512, 1 << 26), (8, 1 << 11)])
def test_top_k_is_that_of_all_products(spark, monkeypatch, k, shard_rows, shard_bytes):
    monkeypatch.setattr(top_k_search, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(top_k_search, "SHARD_BYTES", shard_bytes)
    data = vectors()
    df = spark.createDataFrame(data, VECTORS).repartition(3)
    got = top_k_search.exact_top_k(df, df.where("vec_id % 50 = 0"), k).collect()
    fine, want = usable(data), []
    for q in (v for v in fine if v[0] % 50 == 0):
        a = floored(q[1], 256)
        scored = sorted((-sum(x * y for x, y in zip(a, floored(v[1], 256), strict=True)), v[0]) for v in fine if v[0] != q[0])
        want += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert len({r.query_row for r in got if r.query_id == 50}) == 2  # a repeated query has a list each


def test_top_k_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert top_k_search.exact_top_k(empty, empty).collect() == []
    df = spark.createDataFrame([(0, [], 1, "", ""), (1, [1.0], 1, "", ""), (2, [1.0, -1.0], 1, "", ""), (None, [1.0], 1, "", "")], VECTORS)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k_search.exact_top_k(df, df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0), (1, 1, 2, 65536), (1, 2, 0, 0), (2, 1, 1, 65536), (2, 2, 0, 0)]


def test_max_score_equals_products_for_random_shards():
    r = np.random.default_rng(1)
    for n, d in ((1, 3), (7, 1), (300, 12), (2000, 40)):
        m = r.integers(-90, 90, (n, d))
        m[:: max(1, n // 20)] = m[0]
        index = top_k_search.Postings(np.arange(n) * 3, m)
        for q in (m[0], -m[0], np.zeros(d, np.int64), r.integers(-9, 9, d)):
            rows_, score = index.search(q, 3, 5)
            s = m @ q
            want = sorted((-s[k], k) for k in range(n) if k != 1)[:5]
            assert [(-int(b), int(a)) for a, b in zip(rows_, score, strict=True)] == want


def brute_codes(data: list[tuple]) -> tuple[dict, str]:
    fine = [(v[0], floored(v[1], 4096), v[2]) for v in usable(data)]
    size = len(fine[0][1]) // 8
    heads = {}
    for i, v, _ in sorted(fine, key=lambda x: (x[0], x[1])):
        heads.setdefault(i, v)
    books = [[heads[i][p * size : p * size + size] for i in sorted(heads)[:16]] for p in range(8)]

    def assign(v, p):
        part = v[p * size : p * size + size]
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), k) for k, c in enumerate(books[p]))

    for _ in range(6):
        members = {}
        for _, v, _ in fine:
            for p in range(8):
                members.setdefault((p, assign(v, p)[1]), []).append(v[p * size : p * size + size])
        for (p, k), parts in members.items():
            books[p][k] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    out, labels = [], {}
    for i, v, label in fine:
        best = [assign(v, p) for p in range(8)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(e for e, _ in best)))
        labels[label] = labels.get(label, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((i, code, error, labels[label]) for i, label, code, error in out), digest


def test_vector_codes_equal_plain_loops(spark):
    data = vectors()
    coded, books = vector_codes.compress(spark.createDataFrame(data, VECTORS).repartition(3))
    got = vector_codes.with_label_errors(coded, Scratch(spark, "t"))
    want, digest = brute_codes(data)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()) == want
    assert vector_codes.codebooks_digest(books) == digest


def test_vector_codes_of_odd_tables(spark):
    coded, _ = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert vector_codes.with_label_errors(coded, Scratch(spark, "t")).collect() == []
    df = spark.createDataFrame([(5, [0.5] * 3, None, "", ""), (6, [], None, "", ""), (7, [0.5] * 3, 1, "", "")], VECTORS)
    coded, books = vector_codes.compress(df)
    assert books.shape == (8, 3, 1)
    got = {r.vec_id: (r.code, r.error) for r in coded.collect()}
    assert got[5] == got[7] == ("00" * 8, 0) and got[6][1] == 0
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30], 1, "", "")], VECTORS))


@pytest.mark.parametrize("name", ["op11_top_k_search", "op12_vector_codes"])
def test_vector_queries_equal_their_sql(spark, data, name):
    from lexweave.llm.registry import QUERIES

    assert rows(QUERIES[name](spark, data).toPandas()) == rows(connect(data).sql(SQL[name]).df())


def brute_runs(words: list[str], h: int | None, least: int = 12) -> tuple:
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    runs = sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def thue_morse(n: int) -> list[str]:
    return ["ab"[bin(k).count("1") % 2] for k in range(n)]


def texts() -> list:
    r, out = random.Random(8), [None, "", " \n\t", "one", "x " * 11, "x " * 12, "y " * 700, "a b c " * 30, "é ü " * 9 + "é", "a b a b a b a b a b a b a", "x" * 4000]
    out += [" ".join(thue_morse(1 << 13)), " ".join(["a"] + thue_morse(600) * 2), " ".join(["b", "c"] + thue_morse(1 << 11) + thue_morse(1 << 11)[::-1])]
    for _ in range(60):
        words, kinds = [], r.choice(["ab", "abc", "abcdefgh"])
        while len(words) < r.randint(0, 150):
            piece = [r.choice(kinds) for _ in range(r.randint(1, 9))]
            words += (piece * r.randint(1, 5))[: r.randint(1, 40)]
        out.append(r.choice([" ", "  ", "\n", "\t "]).join(words))
    return out


def test_runs_equal_brute_force(spark):
    data = [(k, t, "clash", 1) for k, t in enumerate(texts())] + [(3, "a b " * 20, "again", 1), (3, "a b " * 20, "again", 1), (None, "c d " * 20, None, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, start string, n_runs int").repartition(3)
    from pyspark.sql import functions as F

    got = periodic_runs.find_runs(df, F.crc32(F.col("doc_id").cast("string").cast("binary")))
    assert got.columns.count("start") == 1 and len(got.columns) == 8
    want = []
    for i, t, *_ in data:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if len(words) < 3000:
            want.append((i, *brute_runs(words, None if i is None else zlib.crc32(str(i).encode()))))
    have = [tuple(r) for r in got.collect()]
    assert len(have) == len(data)
    big = {i for i, t, *_ in data if i is not None and len((t or "").split()) >= 3000}
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((r for r in have if r[0] not in big), key=key) == sorted(want, key=key)
    assert periodic_runs.find_runs(df.limit(0)).collect() == []


def test_runs_where_prefix_hashes_meet():
    """Thue-Morse words have equal polynomials modulo 2**64 from 2,048 words or so on; the words decide."""
    a, b = thue_morse(4096), thue_morse(4096)
    b = ["a" if x == "b" else "b" for x in b]
    words = np.array([ord(x) for x in a + b])
    assert periodic_runs.WordHashes(words).same(np.array([0]), np.array([4096]), np.array([4096]))[0]
    off = np.array([0, len(words)])
    found = periodic_runs.runs(words, off)
    x = "".join(a + b)
    for _, s, n, q in found.tolist():
        part = x[s : s + n]
        assert part[q:] == part[:-q] and n >= max(12, 2 * q)
        assert s == 0 or x[s - 1] != x[s + q - 1]
        assert s + n == len(x) or x[s + n] != x[s + n - q]


def test_grid_in_blocks_gives_the_same(monkeypatch):
    r = random.Random(2)
    words = np.array([r.randrange(3) for _ in range(900)])
    off = np.array([0, 0, 300, 301, 900])
    want = periodic_runs.runs(words, off)
    monkeypatch.setattr(periodic_runs, "PAIRS", 100)
    assert (periodic_runs.runs(words, off) == want).all() and len(want)
