"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer, digest, n_tokens): tokenizer is the SHA-256 of the vocabulary file and
the settings, digest the SHA-256 of the content (null becomes empty; nothing else is changed, since any other
change could change the count).  Only texts whose digest is missing are encoded, one row for each distinct text,
and their counts are appended; a Spark append appears whole or not at all, so a lost job leaves a sound cache.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm import common

#: Digests (32 bytes each) up to which those of repeated rows are broadcast; beyond, their texts are shuffled.
BROADCAST_DIGESTS = 100_000
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens bigint"


def tokenizer_version(json_path: str) -> str:
    with open(json_path, "rb") as f:
        return hashlib.sha256(f.read() + b"|add_special_tokens=False|no truncation|no padding").hexdigest()


def read_cache(spark, cache_path: str) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def encode_misses(texts: DataFrame, json_path: str) -> DataFrame:
    """(digest, text) -> (digest, n_tokens); batches stream, so memory holds one Arrow batch."""

    def count(batches):
        packed = common.byte_bpe(json_path).packed
        for batch in batches:
            batch["n_tokens"] = [len(packed(t)) // 2 for t in batch["text"]]
            yield batch[["digest", "n_tokens"]]

    return texts.mapInPandas(count, "digest binary, n_tokens bigint")


def token_counts(docs: DataFrame, cache_path: str, json_path: str | None = None, limit: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens.  Rows with equal texts share one encoding, whatever their ids;
    null and repeated ids are kept as they are.  An empty table adds nothing to the cache.
    """
    spark = docs.sparkSession
    json_path = json_path or common.default_tokenizer()
    version = tokenizer_version(json_path)
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    texts = docs.select("doc_id", common.text_or_empty().alias("text")).select("doc_id", "text", digest)
    listed = common.settle(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    cached = read_cache(spark, cache_path).where(F.col("tokenizer") == version)
    by_id = listed.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "n")).alias("first")
    missing = by_id.groupBy("digest").agg(first).join(cached.select("digest"), "digest", "left_anti")
    missing = common.settle(missing.select(F.col("digest").alias("missing_digest"), F.col("first.doc_id").alias("first_id"), F.col("first.n").alias("n")), "misses")
    # Each missing text's first row brings its text: ids are unique there, so a group of copies moves one text.
    once = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("missing_digest"))
    wanted = texts.join(missing.where("n = 1"), once, "left_semi").select("digest", "text")
    # Where the first id is repeated (or null) with its text, one row is taken in every task, and then one of those.
    repeated = missing.where("n > 1").select(F.col("missing_digest").alias("digest"))
    n_repeated = repeated.count()
    if n_repeated:
        held = texts.join(F.broadcast(repeated) if n_repeated <= BROADCAST_DIGESTS else repeated, "digest", "left_semi")
        wanted = wanted.unionByName(held.select("digest", "text").dropDuplicates(["digest"]))
    fresh = encode_misses(wanted, json_path).select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
    fresh.write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    found = common.lookup(listed, counts, ["digest"], ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that what is measured is the whole work."""
    return token_counts(common.table(spark, sf_dir, "documents"), common.fresh_path(spark, "token-cache"))
