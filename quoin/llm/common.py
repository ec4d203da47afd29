"""Helpers that the operators share: durable cuts of lineage, text bytes, words and a fast exact tokenizer."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, as the contracts spell it: space and \x09 to \x0D.
WHITE = " \t\n\x0b\f\r"
ROWS_A_BATCH = 1_000
WHITE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, else one of our own (tests, one machine)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="quoin-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quoin/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def settle(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df once to the shared folder and read it back, so that later steps neither recompute nor lose it."""
    spark = df.sparkSession
    bound_batches(spark)
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows.

    createDataFrame([]) makes one from a Python RDD, for which each executor starts a Python daemon and workers besides
    those of SQL; the daemon stays.
    """
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


#: What modules keep in a Python worker from task to task, by name.
KEPT: dict[str, dict] = {}


def make_room(keep: str | None = None) -> None:
    """Let go of what is KEPT by other names than `keep`, and give the system the memory that was freed.

    Workers are used again by later jobs and wait beside the JVM meanwhile; malloc and Arrow would hold on to what tasks
    have freed.
    """
    import pyarrow as pa

    for name, kept in KEPT.items():
        if name != keep:
            kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def roomy(run, keep: str | None = None):
    """run(batches) for mapInPandas, with room made before and after."""

    def made(batches):
        make_room(keep)
        yield from run(batches)
        make_room(keep)

    return made


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the jobs within; then as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened until none is taken (in any case)."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def bound_batches(spark: SparkSession) -> None:
    """Texts may be long: an Arrow batch takes ROWS_A_BATCH rows, which bounds what a Python worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_A_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; bytes.lower and bytes.split touch ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class ByteBpe:
    """Ids of a byte-level BPE given as a tokenizers .json file, with the ranks of the same vocabulary for speed.

    Splitting before a single space never changes the ids of this vocabulary's pattern, so a text is cut at
    its spaces and each piece is looked up; pieces not seen yet go to tiktoken.  Texts with a space before
    other white space or at the end, special strings, or characters outside Latin and general punctuation (whose Unicode classes may
    differ between the two libraries' versions) take the tokenizers library itself.
    """

    #: A space before one of these may belong to a longer run of white space.
    RUNS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c", " \x85", " \xa0")
    WIDE = re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")
    #: Pieces of which the ids are kept, about 200 bytes each in every worker.
    CACHED = 100_000

    def __init__(self, json_path: str, ranks_path: str | None = None):
        self.json_path, self._slow = json_path, None
        ranks_path = ranks_path or os.path.splitext(json_path)[0] + ".tiktoken"
        self._fast = self._open_ranks(ranks_path) if os.path.exists(ranks_path) else None
        self._seen = _Pieces(self._fast._core_bpe.encode_ordinary) if self._fast else {}

    @staticmethod
    def _open_ranks(path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        return tiktoken.Encoding(
            "bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)}
        )

    def _library(self, text: str) -> list[int]:
        if self._slow is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.json_path)
            self._slow.no_truncation()
            self._slow.no_padding()
        return self._slow.encode(text, add_special_tokens=False).ids

    def packed(self, text: str) -> bytes:
        """Little-endian unsigned 16-bit ids."""
        if not text:
            return b""
        if self._fast is None or self._odd(text):
            return array("H", self._library(text)).tobytes()
        if len(self._seen) > self.CACHED:
            self._seen.clear()
        first, *rest = text.split(" ")
        return array("H", self._fast._core_bpe.encode_ordinary(first)).tobytes() + b"".join(map(self._seen.__getitem__, rest))

    def _odd(self, text: str) -> bool:
        if text[-1] == " " or "<|endoftext|" in text or any(run in text for run in self.RUNS):
            return True
        try:
            text.encode("latin-1")
            return False
        except UnicodeEncodeError:
            return self.WIDE.search(text) is not None


class _Pieces(dict):
    """Ids of the pieces seen so far, each piece without the space before it."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = array("H", self._encode(" " + piece)).tobytes()
        return found


_OPEN: dict[str, ByteBpe] = {}
KEPT["tokenizers"] = _OPEN


def byte_bpe(json_path: str) -> ByteBpe:
    """One tokenizer for each Python worker and file."""
    if json_path not in _OPEN:
        _OPEN[json_path] = ByteBpe(json_path)
    return _OPEN[json_path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fan-out of a key's rows in lookup() and the digest trees: no task holds over 1/64 of one key.
RUNS = 64


def run_of(*columns):
    return F.pmod(F.xxhash64(*columns), F.lit(RUNS)).cast("int")


def lookup(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """rows LEFT JOIN keyed (unique by keys) when one key may hold a third of all rows.

    Rows are dealt by key and run; the distinct (key, run) leaves, at most RUNS to a key, fetch the value first.
    `rows` is read twice, so it should be settled.
    """
    dealt = rows.withColumn("_run", run_of(*spread))
    leaves = dealt.select(*keys, "_run").distinct().join(keyed, keys)
    return dealt.join(leaves, [*keys, "_run"], "left").drop("_run")


def ranked(rows: DataFrame, group: list[str], block, order: list, name: str) -> DataFrame:
    """Gapless positions from 0 within group, in the order of (block, order); a task holds one block, never a group.

    `block` is a column that is monotone in the wanted order and bounds how many rows share it.
    """
    from pyspark.sql import Window

    rows = rows.withColumn("_block", block)
    counts = rows.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_block").orderBy(*order)
    same = F.lit(True)
    for key in [*group, "_block"]:
        same = same & F.col(f"r.{key}").eqNullSafe(F.col(f"b.{key}"))
    numbered = rows.withColumn("_in", F.row_number().over(inside) - 1)
    joined = numbered.alias("r").join(bases.alias("b"), same).select("r.*", F.col("b._base"))
    return joined.withColumn(name, F.col("_base") + F.col("_in")).drop("_base", "_in", "_block")
