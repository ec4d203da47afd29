"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Every document becomes a 90-byte entry (digest, check, id); texts are read once and never shuffled.  Entries are
dealt into RUNS runs, each sorted by digest and, within equal digests, by identifier.  In each binomial round,
2**ROUND_BITS neighbouring runs are exchanged and merged into one sorted run: equal entries now lie side by side, the
first of them, which has the smallest identifier, is retained, and their sizes add up.  The sort is what decides: an
aggregation takes the first of each stretch of a sorted run, and Spark streams through it without a hash table.  Two
entries are equal only if SHA-256, byte length and an independent 64-bit hash all agree, which every round verifies, so
a digest collision can't join two texts.  The root's answer goes back down to the leaves and from them to the
documents, so no task ever holds more than 1/RUNS of one group of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm import common

#: Runs merged at a time are 2**ROUND_BITS.
ROUND_BITS = 3
ENTRY = ["digest", "n_bytes", "check"]
#: Spark then streams through sorted rows where it would fill a hash table.
SORTED = "spark.sql.execution.replaceHashWithSortAgg"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.WHITE_RUN, " ")


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select(
        "doc_id",
        F.unhex(F.sha2("_t", 256)).alias("digest"),
        F.octet_length("_t").alias("n_bytes"),
        F.xxhash64("_t").alias("check"),
    )


def merged(level: DataFrame) -> DataFrame:
    """Runs of (run, entry, keep_id, group_size) in sorted order, equal entries joined to the first of them."""
    order = ["run", *ENTRY, F.col("keep_id").asc_nulls_last()]
    runs = level.repartition("run", *ENTRY).sortWithinPartitions(*order)
    # first() depends on the order, so the optimiser keeps the sort.
    return runs.groupBy("run", *ENTRY).agg(F.first("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def tree_merge(leaves: DataFrame) -> DataFrame:
    """(run, entry, doc_id) -> one row for each text: entry, keep_id, group_size."""
    width = common.RUNS
    level = merged(leaves.select("run", *ENTRY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    while width > 1:
        width >>= ROUND_BITS
        level = merged(level.withColumn("run", F.shiftright("run", ROUND_BITS)))
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are one group of equal texts.  Rows that repeat an id count as rows of their group and
    are kept or dropped alike; a null id never wins against another id, and if all ids of a group are null then
    keep_id is null and all its rows stay.  An empty table gives an empty result; other columns are ignored.
    """
    listed = common.settle(
        entries(docs, id_col, text_col).withColumn("run", common.run_of("doc_id")), "digests"
    )
    with common.setting(docs.sparkSession, SORTED, "true"):
        roots = common.settle(tree_merge(listed), "roots")
    found = common.lookup(listed.drop("run"), roots, ENTRY, ["doc_id"])
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents
), h AS (SELECT doc_id, sha256(n) AS text_sha256 FROM t), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY 1
)
SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id = g.keep_id AS kept, h.text_sha256
FROM h JOIN g USING (text_sha256)
"""
