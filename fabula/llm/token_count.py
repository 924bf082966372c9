"""Token counts through a digest cache.

The cache is a table (content_sha256, tokenizer_sha256, n_tokens) in the shared folder. Texts are joined to it
by the digest of their normalised content and of the tokenizer's file and library version; only distinct texts
that it lacks are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.shared import scratch, stored, texts
from fabula.llm.textkit import parts

CACHE = "content_sha256 string, tokenizer_sha256 string, n_tokens long"


def tokenizer_digest(model_path: str) -> str:
    """Digest of the model's bytes and the library's version: a change of either makes other cache keys."""
    library = "tokenizers" if model_path.endswith(".json") else "sentencepiece"
    with open(model_path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {version(library)}".encode()).hexdigest()


def load_counter(model_path: str) -> Callable[[list[str]], list[int]]:
    """Counts as the library gives them, without added special tokens."""
    if model_path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(model_path)
        t.no_truncation()
        t.no_padding()
        return lambda xs: [len(e.ids) for e in t.encode_batch(xs, add_special_tokens=False)]
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return lambda xs: [len(ids) for ids in p.encode(xs, num_threads=1)]


def empty_cache(spark: SparkSession, path: str) -> str:
    spark.createDataFrame([], CACHE).write.mode("append").parquet(path)
    return path


def count_tokens(docs: DataFrame, model_path: str, cache_path: str | None = None, limit: int = 4096, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs`.

    `cache_path` names a cache that outlives the call; without it the call makes its own. `normalise` maps the
    text before digest and count; by default it is unchanged. Null text counts as empty (0 bytes); repeated rows
    give repeated result rows; a null doc_id stays null; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(model_path)
    cache_path = cache_path or scratch(spark, "token-cache")
    empty_cache(spark, cache_path)
    base = texts(docs)
    if normalise is not None:
        base = base.withColumn("text", normalise(F.col("text")))
    keyed = base.withColumns({"content_sha256": F.sha2("text", 256), "row_key": F.coalesce("doc_id", F.lit(-(2**63)))})
    seen = stored(keyed.select("doc_id", "row_key", "content_sha256", F.octet_length("text").cast("long").alias("n_bytes")), "token-digests")

    def cached() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer_sha256") == tokenizer).select("content_sha256", "n_tokens")

    # Of each text that the cache lacks, the row of the smallest doc_id is encoded. Only ids are grouped; texts are dealt out by id once.
    misses = seen.groupBy("content_sha256").agg(F.min("row_key").alias("row_key")).join(cached(), "content_sha256", "left_anti")
    work = keyed.join(misses.hint("shuffle_hash"), ["row_key", "content_sha256"], "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(model_path)
        done: set[str] = set()
        for b in parts(batches):
            keys = b.column("content_sha256").to_pylist()
            fresh = [i for i, k in enumerate(keys) if k not in done and not done.add(k)]
            b = b.take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("content_sha256"), pa.array([tokenizer] * b.num_rows, pa.string()), pa.array(count(b.column("text").to_pylist()), pa.int64())], names=["content_sha256", "tokenizer_sha256", "n_tokens"])

    work.select("content_sha256", "text").mapInArrow(encode, CACHE).write.mode("append").parquet(cache_path)
    # Written, so that the join below reads both sides from exchanges of its own, whose hot keys Spark can split.
    counts = stored(cached().groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    return seen.join(counts, "content_sha256").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


