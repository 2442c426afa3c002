"""Operator 10, token counts by digest cache.

Digests of the normalised content and of the tokenizer file are joined to stored counts; only distinct contents
without a stored count are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.chunks import blank_cuts, distinct_chunks, row_of, row_sums
from lexweave.llm.common import Scratch, arrow_bytes, byte_slices, small_batches, table, text_or_empty

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Distinct chunks whose counts a Python worker remembers.
MEMO = 400_000
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"

_state: dict = {}


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: str = "text") -> Column:
    """Content that has the same count: runs of ASCII white space become one blank (the tokenizer drops white space)."""
    return F.trim(F.regexp_replace(text_or_empty(text), r"[\x09-\x0D\x20]+", " "))


def _tokenizer(path: str):
    if _state.get("path") != path:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _state.update(path=path, own=Tokenizer.from_file(path), memo={})
    return _state["own"], _state["memo"]


def chunk_counts(chunks: list[bytes], path: str) -> np.ndarray:
    """Tokens of each distinct chunk by the library; counts are remembered up to a bound."""
    own, memo = _tokenizer(path)
    new = [c for c in chunks if c not in memo]
    if len(memo) + len(new) > MEMO:
        memo.clear()
        new = chunks
    fresh = {}
    for k in range(0, len(new), 4096):
        part = new[k : k + 4096]
        fresh.update(zip(part, (len(e) for e in own.encode_batch_fast([c.decode("utf-8") for c in part], add_special_tokens=False)), strict=True))
    out = np.array([memo[c] if c in memo else fresh[c] for c in chunks], np.int64)
    if len(fresh) <= MEMO:
        memo.update(fresh)
    return out


def text_counts(column, path: str) -> np.ndarray:
    """Token counts of an Arrow column of normalised texts."""
    raw, off = arrow_bytes(column)
    starts = blank_cuts(raw, off)
    chunks, index = distinct_chunks(raw, starts)
    if not chunks:
        return np.zeros(len(off) - 1, np.int64)
    return row_sums(chunk_counts(chunks, path)[index], row_of(starts, off), len(off) - 1)


def encode_misses(misses: DataFrame, path: str, version: str) -> DataFrame:
    """(digest, tokenizer, n_tokens) of (digest, content) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in byte_slices(batch.column("content")):
                part = batch.slice(a, b - a)
                n = text_counts(part.column("content"), path)
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array([version] * len(n), pa.string()), pa.array(n)], ["digest", "tokenizer", "n_tokens"])

    return misses.select("digest", "content").mapInArrow(count, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_dir: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens, over_limit; the cache at ``cache_dir`` gains the counts that it lacked.

    Null and empty texts: 0 bytes, 0 tokens. One row out per row in, repeated rows included; copies are encoded once;
    clashing input columns are replaced; an empty table gives no rows. Texts go to the encoder whole, however long. Appending is one Parquet write, so a lost
    executor costs a retry; should two runs append the same content, the counts are equal and one is read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    small_batches(spark)
    version = version_of(tokenizer_path)
    own = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c not in own]
    names = [f"_in_{i}" for i in range(len(kept))]
    content = normalised(text)
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    where = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    known = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).where(F.col("tokenizer") == version)
    wanted = docs.select(content.alias("content")).withColumn("digest", F.unhex(F.sha2(F.col("content").cast("binary"), 256)))
    misses = wanted.join(stored().select("digest"), "digest", "left_anti") if known else wanted
    encode_misses(misses.dropDuplicates(["digest"]), tokenizer_path, version).write.mode("append").parquet(cache_dir)
    # A table of its own, so that the join can split a content that a large part of all rows shares.
    counts = scratch.save(stored().groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "counts")
    asked = docs.select(*[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)], F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), digest.alias("digest"))
    out = asked.join(counts, "digest", "left")
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with a cache of its own that starts empty, so that a run does not live on an earlier one's counts."""
    import public_tokenizers

    cache = Scratch(spark, "token-cache").path("counts")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(TOKENIZER), cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def token_counts_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a cache that an earlier run over every second document (by doc_id) has filled: hits and misses meet."""
    import public_tokenizers

    cache, path = Scratch(spark, "token-cache").path("counts"), public_tokenizers.path(TOKENIZER)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count_tokens(docs.where("doc_id % 2 = 0"), path, cache)
    return count_tokens(docs, path, cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")
