"""Operator 9, byte-level BPE encoding and decoding by DuckDB recursive queries per partition.

Each worker keeps a merge table in an in-process DuckDB. Distinct pieces of a batch become (word, position, token)
rows; a recursive query joins neighbouring tokens to the merge table and contracts each word's leftmost pair of
minimum rank until none is left; ordered aggregation gives the ids, and, joined to the token table, the bytes.

A round contracts all pairs of the minimum rank, from left to right, where that comes to the same as one by one: unless one
of them makes a neighbour pair of lower rank, which would have come before the rest; then only the leftmost goes. Pieces are
first cut between bytes that no token has side by side, since no merge can cross such a place. Pieces of any length take
this way; a piece of n letters without any cut needs as many rounds as it has merges of different ranks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexweave.llm.chunks import chunk_array, piece_cuts, row_of, row_sums
from lexweave.llm.common import arrow_bytes, byte_slices, small_batches, table, word_hashes

RANKS = "byte_bpe_50k.tiktoken"
#: Unicode white space as the pattern's ``\s`` means it (fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct pieces in one query, chunks that a worker remembers, and bytes of text that are encoded at a time.
BLOCK, MEMO, SLICE = 40_000, 1_500_000, 2_000_000

#: Rows know their right neighbour (token and position). ``merges.safe``: no pair with the merged token has a lower rank; ``lower``: pairs that have.
ENCODE = """
WITH RECURSIVE step(word, pos, tok, nxt, npos, done) AS (
    SELECT word, pos, tok, lead(tok) OVER w, lead(pos) OVER w, false FROM seed WINDOW w AS (PARTITION BY word ORDER BY pos)
  UNION ALL (
    WITH live AS MATERIALIZED (SELECT word, pos, tok, nxt, npos FROM step WHERE NOT done),
    hits AS (SELECT word, pos, npos, rank, safe, min(rank) OVER (PARTITION BY word) AS low FROM live JOIN merges ON l = tok AND r = nxt),
    least AS (
        SELECT *, row_number() OVER w AS k, coalesce(lag(npos) OVER w = pos, false) AS meets
        FROM hits WHERE rank = low WINDOW w AS (PARTITION BY word ORDER BY pos)
    ),
    runs AS (SELECT *, max(CASE WHEN meets THEN 0 ELSE k END) OVER (PARTITION BY word ORDER BY pos) AS head FROM least),
    apart AS MATERIALIZED (SELECT word, pos, npos, rank, safe, k FROM runs WHERE (k - head) % 2 = 0),
    wary AS MATERIALIZED (SELECT * FROM apart WHERE NOT safe AND word IN (SELECT word FROM apart WHERE k > 1)),
    single AS (
        SELECT w.word FROM wary w JOIN live p ON p.word = w.word AND p.npos = w.pos LEFT JOIN apart x ON x.word = p.word AND x.npos = p.pos
        JOIN lower m ON m.l = coalesce(x.rank, p.tok) AND m.r = w.rank AND m.rank < w.rank
        UNION SELECT w.word FROM wary w JOIN live q ON q.word = w.word AND q.pos = w.npos JOIN lower m ON m.l = w.rank AND m.r = q.nxt AND m.rank < w.rank
    ),
    chosen AS MATERIALIZED (SELECT word, pos, npos, rank FROM apart WHERE k = 1 OR word NOT IN (SELECT word FROM single)),
    going AS (SELECT DISTINCT word FROM chosen)
    SELECT r.word, r.pos, coalesce(c.rank, r.tok), coalesce(d.rank, CASE WHEN c.rank IS NULL THEN r.nxt ELSE q.nxt END),
           CASE WHEN c.rank IS NULL THEN r.npos ELSE q.npos END, g.word IS NULL
    FROM live r
    LEFT JOIN going g ON g.word = r.word
    LEFT JOIN chosen c ON c.word = r.word AND c.pos = r.pos
    LEFT JOIN live q ON q.word = c.word AND q.pos = c.npos
    LEFT JOIN chosen d ON d.word = r.word AND d.pos = CASE WHEN c.rank IS NULL THEN r.npos ELSE q.npos END
    WHERE NOT EXISTS (SELECT 1 FROM chosen x WHERE x.word = r.word AND x.npos = r.pos)
  )
)
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE done GROUP BY word ORDER BY word
"""
DECODE = """
SELECT word, unhex(string_agg(hex, '' ORDER BY pos)) AS text
FROM (SELECT word, unnest(ids) AS tok, generate_subscripts(ids, 1) AS pos FROM coded) JOIN tokens USING (tok)
GROUP BY word ORDER BY word
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Growing:
    """An array that is appended to in place."""

    def __init__(self, kind):
        self.data, self.n = np.empty(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            wider = np.empty(max(need, len(self.data) * 3 // 2), self.data.dtype)
            wider[: self.n] = self.data[: self.n]
            self.data = wider
        self.data[self.n : need] = values
        self.n = need


class Memo:
    """Ids and decoded bytes of chunks by 64-bit hash, in flat arrays: some 50 bytes a chunk."""

    def __init__(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat = [Growing("<u4"), Growing(np.uint8)]
        self.ends = [Growing(np.int64), Growing(np.int64)]
        for e in self.ends:
            e.extend(np.zeros(1, np.int64))

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.slots[at], -1).astype(np.int64)

    def add(self, hashes: np.ndarray, *parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Slots of new chunks; ``parts``: (flat values, sizes) of ids and of bytes."""
        fresh = np.arange(len(self.keys), len(self.keys) + len(hashes))
        for k, (flat, size) in enumerate(parts):
            self.ends[k].extend(self.flat[k].n + np.cumsum(size))
            self.flat[k].extend(flat)
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.keys, hashes[order])
        self.keys, self.slots = np.insert(self.keys, at, hashes[order]), np.insert(self.slots, at, fresh[order])
        return fresh

    def sizes(self, k: int, slots: np.ndarray) -> np.ndarray:
        return self.ends[k].data[slots + 1] - self.ends[k].data[slots]

    def take(self, k: int, slots: np.ndarray) -> np.ndarray:
        flat, ends = self.flat[k].data, self.ends[k]
        bounds = ends.data[: ends.n] * flat.itemsize
        every = pa.Array.from_buffers(pa.large_binary(), ends.n - 1, [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
        return arrow_bytes(every.take(pa.array(slots)))[0].view(flat.dtype)


class Codec:
    """Encoder and decoder of one worker. Tables come from the rank file; nothing grows with the corpus but the bounded memo.

    The database is open from the first new chunk to ``close``, which each task calls at its end: what DuckDB keeps for further
    queries is not held by a worker that waits, or that runs another operator's tasks.
    """

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        plain = pattern.replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"\s", WHITE)
        # Outside brackets a bare run of the class needs brackets of its own.
        plain = plain.replace(f"|{WHITE}+", f"|[{WHITE}]+")
        self.pattern = regex.compile(plain)
        self.memo = Memo()
        self.open = None
        left, right, rank = [], [], []
        self.beside = np.zeros((256, 256), bool)  # bytes that some token has side by side
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                self.beside[token[k - 1], token[k]] = True
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        l, r, m = (np.array(v, np.int32) for v in (left, right, rank))
        unsafe = np.unique(np.append(l[l > m], r[r > m]))
        lower = (l > m) | (r > m)
        merges = pa.table({"l": l, "r": r, "rank": m, "safe": ~np.isin(m, unsafe)})
        tokens = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in self.ranks])})
        self.tables = {"merges": merges, "lower": pa.table({"l": l[lower], "r": r[lower], "rank": m[lower]}), "tokens": tokens}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    @property
    def db(self):
        import duckdb

        if self.open is None:
            self.open = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})  # nothing is written beside the worker
            for name, data in self.tables.items():
                self.open.register("incoming", data)
                self.open.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
                self.open.unregister("incoming")
        return self.open

    def close(self) -> None:
        """Give back what only a running task needs; the remembered chunks stay."""
        if self.open is not None:
            self.open.close()
            self.open = None
        pa.default_memory_pool().release_unused()

    def pieces(self, chunk: bytes) -> list[bytes]:
        return [p.encode() for p in self.pattern.findall(chunk.decode("utf-8"))]

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct pieces: a whole token at once, else by merges."""
        out = {p: [self.ranks[p]] for p in pieces if p in self.ranks}
        rest = [p for p in pieces if p not in out]
        if rest:
            raw, off = arrow_bytes(pa.array(rest, pa.binary()))
            cut = np.append(True, ~self.beside[raw[:-1], raw[1:]])
            cut[off[:-1]] = True
            starts = np.flatnonzero(cut)
            coded = chunk_array(raw, starts).dictionary_encode()
            own = self._merged(coded.dictionary.to_pylist())
            parts = coded.indices.to_pylist()
            first = np.searchsorted(starts, off).tolist()
            out.update((p, [t for k in parts[a:b] for t in own[k]]) for p, a, b in zip(rest, first[:-1], first[1:], strict=True))
        return out

    def _merged(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each non-empty word, by the recursive query."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        out: list[list[int]] = [[]] * len(words)
        for k in range(0, len(order), BLOCK):
            part = [words[i] for i in order[k : k + BLOCK]]
            lengths = np.array([len(p) for p in part])
            ends = np.cumsum(lengths)
            seed = pa.table(
                {
                    "word": pa.array(np.repeat(np.arange(len(part), dtype=np.int32), lengths)),
                    "pos": pa.array((np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype(np.int32)),
                    "tok": pa.array(self.byte_ids[np.frombuffer(b"".join(part), np.uint8)]),
                }
            )
            self.db.register("seed", seed)
            ids = self.db.sql(ENCODE).to_arrow_table().column("ids").to_pylist()
            self.db.unregister("seed")
            for i, own in zip(order[k : k + BLOCK], ids, strict=True):
                out[i] = own
        return out

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """Bytes of each non-empty list of ids, by ordered aggregation over the token table."""
        coded = pa.table({"word": pa.array(np.arange(len(ids), dtype=np.int32)), "ids": pa.array(ids, pa.list_(pa.int32()))})
        self.db.register("coded", coded)
        out = self.db.sql(DECODE).to_arrow_table().column("text").to_pylist()
        self.db.unregister("coded")
        return out

    def slots(self, chunks: pa.Array) -> np.ndarray:
        """Slots in the memo of distinct chunks; a hit counts only if its decoded bytes are the chunk's."""
        raw, off = arrow_bytes(chunks)
        hashes, size = word_hashes(raw, off[:-1], off[1:]), np.diff(off)
        slots = self.memo.find(hashes)
        same = slots >= 0
        same[same] = self.memo.sizes(1, slots[same]) == size[same]
        hit = np.flatnonzero(same)
        apart = self.memo.take(1, slots[hit]) != arrow_bytes(chunks.take(pa.array(hit)))[0]
        same[hit[np.unique(np.repeat(np.arange(len(hit)), size[hit])[apart])]] = False
        new = np.flatnonzero(~same)
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = Memo(), np.arange(len(chunks))
        body = raw.tobytes()
        for k in range(0, len(new), BLOCK):
            part = new[k : k + BLOCK]
            split = [self.pieces(body[off[i] : off[i + 1]]) for i in part]
            ids = self.encode_pieces(list(dict.fromkeys(p for s in split for p in s)))
            joined = [[i for p in s for i in ids[p]] for s in split]
            texts = self.decode(joined)
            many, chars = np.array([len(j) for j in joined]), np.array([len(t) for t in texts])
            flat = np.fromiter((i for j in joined for i in j), "<u4", int(many.sum()))
            slots[part] = self.memo.add(hashes[part], (flat, many), (np.frombuffer(b"".join(texts), np.uint8), chars))
        return slots


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_column(column, own: Codec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, id offsets by row, decoded bytes, byte offsets by row) of an Arrow text column."""
    raw, off = arrow_bytes(column)
    n = len(off) - 1
    starts = piece_cuts(raw, off)
    if not len(starts):
        return np.zeros(0, "<u4"), np.zeros(n + 1, np.int64), np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    coded = chunk_array(raw, starts).dictionary_encode()
    slots = own.slots(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    rows, out = row_of(starts, off), []
    for k in (0, 1):
        out += [own.memo.take(k, slots), np.append(0, np.cumsum(row_sums(own.memo.sizes(k, slots), rows, n)))]
    return tuple(out)


def coded_slices(batches: Iterator[pa.RecordBatch], text: str, ranks_path: str, pattern: str) -> Iterator[tuple]:
    """(rows, ids, id offsets, decoded bytes, byte offsets) of each run of rows of about SLICE bytes, with this worker's codec."""
    own = codec(ranks_path, pattern)
    try:
        for batch in batches:
            for a, b in byte_slices(batch.column(text), SLICE):
                part = batch.slice(a, b - a)
                yield part, *encode_column(part.column(text), own)
    finally:
        own.close()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (binary); null texts as empty ones, which have no ids.

    One row out per row in; clashing columns named ids or decoded are replaced.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = docs.select(*kept).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, id_off, decoded, off in coded_slices(batches, text, ranks_path, pattern):
            lists = pa.ListArray.from_arrays(pa.array(id_off.astype(np.int32)), pa.array(ids.astype(np.int32)))
            blobs = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(decoded)])
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists, blobs], [*kept, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests of ``encode``'s output, made where it is made.

    One row out per row in, repeated rows and null ids included; null texts as empty ones; other columns are ignored, and an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, id_off, decoded, off in coded_slices(batches, "text", ranks_path, pattern):
            view, chars = memoryview(np.ascontiguousarray(ids)).cast("B"), memoryview(np.ascontiguousarray(decoded))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(id_off)),
                    pa.array([hashlib.sha256(view[4 * x : 4 * y]).hexdigest() for x, y in zip(id_off[:-1], id_off[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(chars[x:y]).hexdigest() for x, y in zip(off[:-1], off[1:], strict=True)], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: digests of the ids and of the decoded bytes of each row (``encode_digests``), without the other columns."""
    import public_tokenizers

    return encode_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
