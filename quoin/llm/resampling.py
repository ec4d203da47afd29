"""Importance resampling toward the distribution of a target set, on hashed n-grams.

A document's words, lower-cased and joined by single spaces, are scanned once; the CRC-32 of every prefix that ends
with a word is kept.  CRCs are linear over GF(2): crc(AB) = shift(crc(A), bytes of B) xor crc(B), where shift appends
zero bytes.  So the CRC of any n-gram is that of the prefix that ends with it, from which the shifted CRC of the
prefix before it is cancelled; no n-gram is built or scanned.  Counts of buckets are added up in every task and then
by Spark; the gains of all buckets (BUCKETS numbers, whatever the corpus) go to the tasks that add them up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm import common

BUCKETS, LONGEST = 10_000, 3
#: Bytes of a document that are split into words at a time.
PIECE = 1 << 20
_WORD = [c for c in range(256) if c > 0x7F or chr(c).isalnum()]
#: Bytes of words to themselves, A-Z to a-z, all others to a space.
_NORMAL = bytes(ord(chr(c).lower()) if c in _WORD and c < 0x80 else c if c > 0x7F else 0x20 for c in range(256))
_STEP = np.array([zlib.crc32(bytes([c])) ^ zlib.crc32(b"\0") for c in range(256)], dtype=np.uint32)


def _applied(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map, given by what each byte of a value contributes (4 x 256), of many values."""
    return tables[0][values & 0xFF] ^ tables[1][values >> 8 & 0xFF] ^ tables[2][values >> 16 & 0xFF] ^ tables[3][values >> 24]


class Shift:
    """Appends zero bytes to messages of which only the CRC is known."""

    NEAR = 256

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        now = np.stack([step << np.uint32(8 * k) for k in range(4)])
        near = []
        for _ in range(self.NEAR):
            near.append(now)
            now = (now >> np.uint32(8)) ^ _STEP[now & np.uint32(0xFF)]
        #: near[n]: by n bytes; far[k]: by NEAR * 2**k bytes.
        self.near, self.far = np.stack(near), [now]

    def __call__(self, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        n = lengths % self.NEAR
        out = self.near[n, 0, values & 0xFF] ^ self.near[n, 1, values >> 8 & 0xFF] ^ self.near[n, 2, values >> 16 & 0xFF] ^ self.near[n, 3, values >> 24]
        rest, k = lengths // self.NEAR, 0
        while rest.any():
            if k == len(self.far):
                self.far.append(_applied(self.far[-1], self.far[-1]))
            odd = (rest & 1).astype(bool)
            out[odd] = _applied(self.far[k], out[odd])
            rest, k = rest >> 1, k + 1
        return out


def prefixes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For every word: the CRC of the normalised text up to its end, and its length in bytes."""
    data = text.encode("utf-8", "surrogatepass").translate(_NORMAL)
    crc32, crc, low, crcs, lengths = zlib.crc32, 0, 0, [], []
    while low < len(data):
        high = data.find(b" ", low + PIECE)
        high = len(data) if high < 0 else high
        words, found = data[low:high].split(), []
        for word in words:
            crc = crc32(word, crc)
            found.append(crc)
            crc = crc32(b" ", crc)
        crcs.append(np.array(found, dtype=np.uint32))
        lengths.append(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        low = high
    if not crcs:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    return np.concatenate(crcs), np.concatenate(lengths)


def ngram_crcs(ends: np.ndarray, lengths: np.ndarray, doc: np.ndarray, shift: Shift) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to LONGEST: (index of the first word, CRC) of all runs of n words of one document."""
    first = np.ones(len(doc), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    # The prefix before a word is the one up to the word before, and a space.
    before = np.zeros(len(ends), dtype=np.uint32)
    spaced = ends ^ np.uint32(0xFFFFFFFF)
    spaced = ((spaced >> np.uint32(8)) ^ _STEP[(spaced ^ np.uint32(0x20)) & np.uint32(0xFF)]) ^ np.uint32(0xFFFFFFFF)
    before[1:] = spaced[:-1]
    before[first] = 0
    until = np.cumsum(lengths + 1)
    for n in range(1, LONGEST + 1):
        at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
        size = until[at + n - 1] - until[at] + lengths[at]
        yield at, ends[at + n - 1] ^ shift(before[at], size)


def features(texts, shift: Shift) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and (text of the first word, bucket) of all n-grams, for each n."""
    found = [prefixes(t) for t in texts]
    n_words = np.array([len(ends) for ends, _ in found], dtype=np.int64)
    doc = np.repeat(np.arange(len(found)), n_words)
    if not len(doc):
        return n_words, []
    grams = ngram_crcs(np.concatenate([e for e, _ in found]), np.concatenate([n for _, n in found]), doc, shift)
    return n_words, [(doc[at], (crc % np.uint32(BUCKETS)).astype(np.int64)) for at, crc in grams]


def runs(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts that hold up to PIECE characters together, one text at least."""
    held, first = 0, 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > PIECE:
            yield texts[first:i]
            held, first = 0, i
        held += len(text)
    if texts:
        yield texts[first:]


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket; buckets without any are left out."""
    common.bound_batches(rows.sparkSession)

    def run(batches):
        shift, total = Shift(), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for texts in runs(batch.column(0).to_pylist()):
                for _, buckets in features(texts, shift)[1]:
                    total += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    partial = rows.select(common.text_or_empty().alias("text")).mapInArrow(run, "bucket long, n long")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Thousandths of the log-ratio of target and corpus, for each bucket; BUCKETS numbers, the model's whole size."""
    spark = docs.sparkSession
    s, t = common.settle(bucket_counts(docs), "corpus-buckets"), common.settle(bucket_counts(target), "target-buckets")
    total = [x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (s, t)]
    both = spark.range(BUCKETS).toDF("bucket").join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left")
    n_s, n_t = (F.coalesce(c, F.lit(0)).cast("double") + 1 for c in ("s", "t"))
    ratio = n_t * F.lit(float(total[0] + BUCKETS)) / (n_s * F.lit(float(total[1] + BUCKETS)))
    found = np.zeros(BUCKETS, dtype=np.int64)
    for r in both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():
        found[r["bucket"]] = r["gain"]
    return found


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight for each row."""
    common.bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        shift = Shift()
        for batch in batches:
            words, number, weight = [], [], []
            for texts in runs(batch.column(1).to_pylist()):
                n_words, grams = features(texts, shift)
                n, w = np.zeros(len(n_words), dtype=np.int64), np.zeros(len(n_words), dtype=np.int64)
                for doc, buckets in grams:  # doc rises: sums of runs are differences of running sums
                    bounds = np.searchsorted(doc, np.arange(len(n_words) + 1))
                    n += np.diff(bounds)
                    w += np.diff(np.concatenate([[0], np.cumsum(gain[buckets])])[bounds])
                words.append(n_words), number.append(n), weight.append(w)
            if words:
                found = [pa.array(np.concatenate(x)) for x in (words, number, weight)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["doc_id", "n_words", "n_features", "weight"])

    ready = docs.select("doc_id", common.text_or_empty().alias("text"))
    return ready.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def numbered(rows: DataFrame, order: list, least: int) -> DataFrame:
    """rank: 1, 2, 3... in this order for the first `least` rows, in range partitions; null for the others."""
    from pyspark.sql import Window

    spark = rows.sparkSession
    dealt = common.settle(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()), "sorted")
    counts = sorted(map(tuple, dealt.groupBy("_part").count().collect()))  # a row a partition
    bases, base = [], 0
    for part, n in counts:
        bases.append((part, base))
        base += n
    held = F.broadcast(spark.createDataFrame(bases, "_part int, _base long"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_base")
    drawn = dealt.join(held.where(F.col("_base") < least), "_part").withColumn("rank", place.cast("long"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= least, F.col("rank")))
    rest = dealt.join(held.where(F.col("_base") >= least), "_part").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("_part", "_base")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of docs.

    weight is the sum of the gains of a document's n-grams, score adds Gumbel noise from the SHA-256 of seed and
    doc_id, and the floor(percent * N / 100) highest scores of the N documents with min_words words or more get ranks
    (ties by smaller doc_id; null ids last).  That is sampling without replacement by weight, the same in every run.
    Null and empty texts have no features and weight 0.  Rows that repeat an id are documents of their own, with the
    same noise; of equal rows any may come first.  A null id is hashed as no digits.  An empty target has no features.
    Other columns are left out.  An empty table gives an empty result.
    """
    gain = gains(docs, target)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights(docs, gain).withColumn("score", (F.col("weight") + noise).cast("long"))
    scored = common.settle(scored, "scored")
    long_enough = F.col("n_words") >= min_words
    n = scored.where(long_enough).count()
    # The last key parts rows that agree in all others, so that many null ids spread over tasks.
    keyed = scored.where(long_enough).withColumn("_row", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"), F.desc("n_words"), F.asc("_row")]
    ranked = numbered(keyed, order, percent * n // 100).drop("_row")
    return ranked.unionByName(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long")))


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    found = resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
