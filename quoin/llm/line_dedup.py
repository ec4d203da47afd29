"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased; keys of MIN_CHARS code
points or more count.  The index in the shared folder has two parts:

* log: exact references (digest, doc_id, sign), append-only; a reference is live if its signs add up to more than 0;
* filters: for each shard of the digest space a cuckoo filter of the digests that have live references.

insert() sends a batch's keys through their shards' filters.  A key that its filter doesn't know, and that one
document of the batch holds, is unique: it needs no exact look-up.  All others are counted exactly in the log.
delete() takes references back, and with a key's last reference its fingerprint, so a later state is the same as if
the document had never come.  A batch's filters are written after its log and name it, so an index that is opened at
its path again sees whole batches only; as it grows, shards split.  Only digests and line numbers are moved until the
drop lists meet their texts.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import common, cuckoo

MIN_CHARS = 10
#: Expected keys of a shard; a shard's keys and filter are what one task holds.
SHARD_KEYS = 100_000
#: Inserts of a set of documents into a new index.
BATCHES = 2
REFS = "doc_id long, text_hash long, digest binary, lines array<int>"
LOG = "digest binary, doc_id long, sign int"
STATE = "shard int, filter binary, n long, full boolean, digest binary, known boolean"
FILTERS = ["shard", "filter", "n"]
SAVED = "batch int, log string, shards int, shard int, filter binary, n long"


def line_key(line: str) -> bytes | None:
    stripped = line.strip(common.WHITE)
    return stripped.encode("utf-8", "surrogatepass").lower() if len(stripped) >= MIN_CHARS else None


def references(docs: DataFrame) -> DataFrame:
    """REFS: one row for each document row and distinct key, with the key's line numbers."""

    def run(batches):
        blake = hashlib.blake2b
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
                held: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.split("\n")):
                    key = line_key(line)
                    if key is not None:
                        held.setdefault(key, []).append(i)
                rows += [(doc_id, text_hash, blake(key, digest_size=16).digest(), lines) for key, lines in held.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "digest", "lines"])

    ready = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return ready.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInPandas(common.roomy(run), REFS)


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


class LineIndex:
    """An index at `path`, which is opened if it is there, or else in a new folder that goes with the session."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or common.fresh_path(spark, "lines")
        self.filters: DataFrame | None = None
        self.shards, self.logs = 0, []
        if path and common.exists(spark, f"{path}/filters"):
            held = spark.read.schema(SAVED).parquet(f"{path}/filters")
            batches = held.select("batch", "log", "shards").distinct().orderBy("batch").collect()  # a row a batch
            self.logs, self.shards = [r["log"] for r in batches], batches[-1]["shards"]
            self.filters = held.where(F.col("batch") == batches[-1]["batch"]).select(*FILTERS)

    def log(self) -> DataFrame:
        if not self.logs:
            return common.empty(self.spark, LOG)
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/{name}" for name in self.logs])

    def _append(self, rows: DataFrame, sign: int) -> None:
        name = f"log-{uuid.uuid4().hex}"
        rows.select("digest", "doc_id", F.lit(sign).alias("sign")).write.parquet(f"{self.path}/{name}")
        self.logs.append(name)

    def _commit(self) -> None:
        """The filters of all shards, with the batch that they stand for."""
        rows = self.filters.select(F.lit(len(self.logs)).alias("batch"), F.lit(self.logs[-1]).alias("log"), F.lit(self.shards).alias("shards"), *FILTERS)
        rows.write.mode("append").parquet(f"{self.path}/filters")

    def live(self, digests: DataFrame | None = None) -> DataFrame:
        """Live references (digest, doc_id), of some digests or all."""
        log = self.log()
        if digests is not None:
            wanted = digests.select("digest", F.lit(True).alias("_wanted")).distinct()
            log = common.lookup(log, wanted, ["digest"], ["doc_id"]).where("_wanted")
        return log.groupBy("digest", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0").drop("n")

    def counts(self, digests: DataFrame | None = None) -> DataFrame:
        """The exact reference-count table: digest, n_docs, owner (smallest doc_id)."""
        return self.live(digests).groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("owner"))

    def insert(self, refs: DataFrame) -> DataFrame:
        """Add settled references; digests that two or more documents may hold now.

        A reference that is live already stays as it is.
        """
        held = refs.select("digest", "doc_id").withColumn("run", common.run_of("doc_id"))
        leaves = held.groupBy("digest", "run").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        keys = common.settle(
            leaves.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most")).select("digest", (F.col("least") != F.col("most")).alias("many")),
            "keys",
        )
        self._split(keys.count())
        state = self._pass(keys, "insert")
        seen = state.where("digest is not null").select("digest")
        fresh = refs.select("digest", "doc_id").distinct()
        false = None
        if self.logs:
            # A key that its filter doesn't know has no live reference.
            known = common.settle(state.where("known").select("digest", F.lit(True).alias("known")), "known")
            marked = common.settle(common.lookup(refs.select("digest", "doc_id"), known, ["digest"], ["doc_id"]).distinct(), "marked")
            live = common.settle(self.live(known), "live")
            again = marked.where("known").join(live, ["digest", "doc_id"], "left_anti")
            fresh = marked.where("known is null").unionByName(again).drop("known")
            # Keys that a filter took for known while the log holds none: they must get fingerprints of their own.
            false = known.join(live.select("digest").distinct(), "digest", "left_anti").select("digest", F.lit(True).alias("many"))
            false = common.settle(false, "false")
        self._append(fresh, 1)
        rebuilt = self._keep(state)
        if false is not None:
            # Shards rebuilt from the log have those keys already.
            rest = false.withColumn("shard", _shard(self.shards)).join(rebuilt, "shard", "left_anti") if rebuilt is not None else false
            self._keep(self._pass(rest.select("digest", "many"), "force"))
        self._commit()
        return seen

    def delete(self, docs: DataFrame) -> None:
        """Take back the references of these documents, by doc_id."""
        if not self.logs:
            return
        gone = self.log().join(docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("digest", "doc_id").agg(F.sum("sign").alias("n"))
        gone = common.settle(gone.where("n > 0").select("digest", "doc_id"), "gone")
        self._append(gone, -1)
        dead = gone.select("digest").distinct().join(self.live(gone), "digest", "left_anti").select("digest", F.lit(True).alias("many"))
        self._keep(self._pass(common.settle(dead, "dead"), "delete"))
        self._commit()

    def _split(self, coming: int) -> None:
        """As many shards as keep SHARD_KEYS keys or so each; filters of more shards are made from the log."""
        if not self.shards:
            self.shards = max(1, coming // SHARD_KEYS)
            return
        total = coming + (self.filters.agg(F.sum("n")).first()[0] or 0)
        if total > 2 * SHARD_KEYS * self.shards:
            self.shards = total // SHARD_KEYS
            self.filters = self._rebuilt(self.live().select("digest").distinct().withColumn("shard", _shard(self.shards)))

    def _pass(self, keys: DataFrame, action: str) -> DataFrame:
        """Each shard's keys (digest, many) meet its filter; STATE rows with the new filters and the keys seen before."""

        def run(key, mine: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            digests = mine["digest"].to_numpy(object)
            old = cuckoo.CuckooFilter.from_bytes(filters["filter"].iloc[0]) if len(filters) else None
            if action == "delete":
                old.delete(digests)
                return pd.DataFrame([(key[0], old.to_bytes(), len(old), False, None, None)], columns=names)
            known = old.contains(digests) if old and action == "insert" else np.zeros(len(digests), dtype=bool)
            seen = known | mine["many"].to_numpy(bool) if action == "insert" else known
            full = False
            try:
                made = old or cuckoo.CuckooFilter(2 * SHARD_KEYS)
                made.insert(digests[~known])
            except cuckoo.Full:
                full = True
            rows = [(key[0], made.to_bytes(), len(made), full, None, None)]
            return pd.DataFrame(rows + [(key[0], None, None, None, d, k) for d, k in zip(digests[seen], known[seen])], columns=names)

        names = [f.split()[0] for f in STATE.split(", ")]
        mine = keys.withColumn("shard", _shard(self.shards))
        have = self.filters if self.filters is not None else common.empty(self.spark, "shard int, filter binary, n long")
        return common.settle(mine.groupBy("shard").cogroup(have.groupBy("shard")).applyInPandas(run, STATE), "filters")

    def _rebuilt(self, digests: DataFrame) -> DataFrame:
        """Filters of live digests (digest, shard), as large as they must be."""

        def rebuild(key, mine: pd.DataFrame) -> pd.DataFrame:
            made = cuckoo.grown(mine["digest"].to_numpy(object), max(2 * SHARD_KEYS, 2 * len(mine)))
            return pd.DataFrame([(key[0], made.to_bytes(), len(made))], columns=FILTERS)

        return common.settle(digests.groupBy("shard").applyInPandas(rebuild, "shard int, filter binary, n long"), "filters")

    def _keep(self, state: DataFrame) -> DataFrame | None:
        """Take over a pass's filters; those that overflowed are rebuilt from the log's live digests.  Returns their shards."""
        filters = state.where("filter is not null")
        full = filters.where("full").select("shard")
        self.filters = filters.where("not full").select(*FILTERS)
        if not full.limit(1).count():
            return None
        digests = self.live().select("digest").distinct().withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi")
        self.filters = self.filters.unionByName(self._rebuilt(digests))
        return full


def repeated_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """(doc_id, text_hash, drop): the numbers of the lines that documents lose, for documents that lose any."""
    new = index is None
    index = index or LineIndex(docs.sparkSession)
    refs = common.settle(references(docs), "refs")
    if new:  # in batches, so that most keys of the later ones are settled by the filters of the earlier ones
        seen = None
        for i in range(BATCHES):
            more = index.insert(refs.where(F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)) == i))
            seen = more if seen is None else seen.unionByName(more)
        seen = seen.distinct()
    else:
        seen = index.insert(refs)
    owners = common.settle(index.counts(seen).where("n_docs > 1").select("digest", "owner"), "owners")
    # Rows that repeat an id and its text have the same references.
    gone = common.lookup(refs, owners, ["digest"], ["doc_id"]).where("owner <> doc_id").dropDuplicates(["doc_id", "text_hash", "digest"])
    return gone.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("lines")).alias("drop"))  # at most a text's lines


def without_lines(text: Column, drop: Column) -> Column:
    """The text without the lines of these numbers: the other numbers, in order, each looked up in the lines once."""

    def rest(lines):
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return F.transform(F.array(F.split(text, "\n")), rest)[0]


def dedup_lines(docs: DataFrame, index: LineIndex | None = None, counts: tuple | None = ("n_lines", "n_dropped")) -> DataFrame:
    """The input rows with `text` less its repeated lines and, under the names `counts`, its lines and those dropped.

    A key held by two or more documents of the index loses its lines in every document but the one with the smallest
    doc_id.  Null and empty texts are one empty line, and null becomes empty.  Rows that repeat an id are one
    document with several texts, and rows that also repeat the text lose the same lines each; rows with a null id neither count nor lose lines.  All other columns stay, except
    those of the names `counts`, which are replaced; with counts=None no column is added or replaced but `text`.  An
    empty table gives an empty result.
    """
    common.bound_batches(docs.sparkSession)
    an_id, a_hash, drop = common.free_names(docs.columns, "_id", "_hash", "_drop")
    drops = repeated_lines(docs, index).select(F.col("doc_id").alias(an_id), F.col("text_hash").alias(a_hash), F.col("drop").alias(drop))
    taken = {"text", *(counts or ())}
    kept_columns = [c for c in docs.columns if c.lower() not in taken]
    text = common.text_or_empty()
    joined = docs.join(drops, (F.col("doc_id") == F.col(an_id)) & (F.xxhash64(text) == F.col(a_hash)), "left")
    rest = F.when(F.col(drop).isNull(), text).otherwise(without_lines(text, F.col(drop)))
    if counts is None:
        return joined.select(*[rest.alias("text") if c == "text" else F.col(c) for c in docs.columns])
    numbers = [F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1, F.coalesce(F.size(drop), F.lit(0))]
    return joined.select(*kept_columns, rest.alias("text"), *[n.cast("long").alias(name) for n, name in zip(numbers, counts)])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d
), k AS (
  SELECT doc_id, i, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), r AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (SELECT k.*, r.owner IS NOT NULL AND r.owner <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
