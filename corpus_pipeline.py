"""From raw documents to packed training sequences, in five stages.

Every stage takes all documents that the one before kept; run() writes each stage's result to the shared folder and
reads it back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import common, decontam, line_dedup, near_dup, packing, toxicity

#: Ids (8 bytes each) up to which the ids of dropped documents are broadcast; beyond, the join is shuffled.
BROADCAST_IDS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the operator's threshold; null and empty texts stay.

    Rows that repeat an id are judged each by their text; all columns stay, whatever their names.  An empty table gives
    an empty one.
    """
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(spark, model) < toxicity.PREDICT_AT)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less the lines that an earlier document holds; n_chars follows the text.  No document goes.

    Null texts become empty; rows that repeat an id are one document with several texts; rows with a null id keep their
    lines.  All columns stay, whatever their names.  An empty table gives an empty one.
    """
    found = line_dedup.dedup_lines(docs, counts=None)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of its smallest id; documents without words stand alone and stay.

    Rows are judged one by one, by id and text: of rows that repeat an id each text is judged for itself, and of rows that
    repeat both one stays.  Rows with a null id stay.  All columns stay, whatever their names.  An empty table gives an
    empty one.
    """
    found = common.settle(near_dup.near_duplicates(docs).select("doc_id", "text_hash", "kept"), "near")
    out = without(docs, found.where("not kept"))
    again = found.where("kept and doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = common.settle(again.select("doc_id", "text_hash"), "repeated")
    if not again.limit(1).count():
        return out
    an_id, a_hash = common.free_names(docs.columns, "_id", "_hash")
    keyed = out.withColumns({an_id: F.col("doc_id").cast("long"), a_hash: F.xxhash64(common.text_or_empty())})
    rows = keyed.join(again.toDF(an_id, a_hash), [an_id, a_hash], "left_semi")
    first = F.first(F.struct(*docs.columns)).alias("row")
    return without(out, again).unionByName(rows.groupBy(an_id, a_hash).agg(first).select("row.*"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows (doc_id, text_hash)."""
    an_id, a_hash = common.free_names(docs.columns, "_id", "_hash")
    gone = common.settle(gone.select(F.col("doc_id").alias(an_id), F.col("text_hash").alias(a_hash)).distinct(), "gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(an_id)) & (F.xxhash64(common.text_or_empty()) == F.col(a_hash))
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same, "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts stay.

    Rows that repeat an id are judged each by their text.  All columns stay, whatever their names.  An empty table, and
    an empty benchmark, leave all rows there are.
    """
    return without(docs, decontam.contamination(docs, common.table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, sources mixed in the proportions of what is left.

    Null texts are empty documents, of one token that ends them; null sources are a source of their own; rows that
    repeat an id are packed each.  Columns other than doc_id, text and source are left out.  An empty table gives an
    empty result.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]
#: The classifier, MinHash confirmation, tiling and tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
