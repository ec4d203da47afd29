"""Sharding by sampled splitters.

Records are range-partitioned by a key (hash of the text, part of a group), so equal texts lie side by side.  A
size-weighted sample of keys gives quantile boundaries of many small ranges; their bytes are then summed exactly and
overfull ranges are subdivided by a denser sample of their own until none is overfull.  Shards are runs of ranges;
the ranges that hold a shard's edge are cut at the exact record.  Law: `bytes`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm import common

#: Expected number of sampled keys for each range.
SAMPLES = 32
#: Ranges: at least this many for each shard, and one more for each ROWS_A_RANGE rows.
RANGES_A_SHARD, ROWS_A_RANGE = 8, 50_000
#: A range is overfull at this many times the mean load; a group of equal texts is split at this part of a shard, by
#: bytes or by rows.
OVERFULL, HOT_PART = 4.0, 0.25


def keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("group"),
    )


def places(bounds, group, sub):
    """How many of the sorted bounds (group, sub) are at or below each key."""
    groups, subs = (np.array(x, dtype=np.int64) for x in zip(*bounds)) if bounds else (np.zeros(0, dtype=np.int64),) * 2
    low, high = np.searchsorted(groups, group, "left"), np.searchsorted(groups, group, "right")
    for a, b in set(zip(*(x[low < high].tolist() for x in (low, high)))):  # keys whose group is that of some bounds
        mine = np.flatnonzero((low == a) & (high == b))
        low[mine] = a + np.searchsorted(subs[a:b], sub[mine], "right")
    return low


def _range_of(bounds: list[tuple[int, int]]):
    """Index of the range of (group, sub): bounds are the sorted lower ends of all ranges but the first."""

    @F.pandas_udf("int")
    def place(group: pd.Series, sub: pd.Series) -> pd.Series:
        return pd.Series(places(bounds, group.to_numpy(), sub.to_numpy()), dtype="int32")

    return place("group", "sub")


def splitters(rows: DataFrame, total: float, ranges: int) -> list[tuple[int, int]]:
    """Boundaries of ranges whose rows have a load of OVERFULL * total / ranges at most, unless a range is one key.

    A row's load is its part of all bytes and its part of all rows, so that a range is large in neither.

    The driver holds the samples (SAMPLES keys of 16 bytes for each range) and the boundaries only.  Overfull ranges are
    subdivided until there are none: each is cut at its last key at least, so this ends.
    """

    def drawn(of: DataFrame, total: float, want: int) -> list[tuple[int, int]]:
        share = F.col("load") / F.lit(float(total)) * want
        chance = F.pmod(F.xxhash64("doc_id", "group", F.lit(want)), F.lit(2**31)) / F.lit(float(2**31))
        got = of.where(chance < share).select("group", "sub").toArrow()
        group, sub = (got.column(x).to_numpy() for x in ("group", "sub"))
        order = np.lexsort((sub, group))
        return list(zip(group[order].tolist(), sub[order].tolist()))

    def quantiles(sample: list, n: int) -> list[tuple[int, int]]:
        return sorted({sample[i] for i in range(max(1, len(sample) // max(1, n)), len(sample), max(1, len(sample) // max(1, n)))})

    bounds = quantiles(drawn(rows, total, ranges * SAMPLES), ranges)
    while True:
        held = rows.withColumn("range", _range_of(bounds)).groupBy("range").agg(
            F.sum("load").alias("n"), F.min(F.struct("group", "sub")).alias("least"), F.max(F.struct("group", "sub")).alias("most")
        )
        over = held.where((F.col("n") > OVERFULL * total / ranges) & (F.col("least") != F.col("most"))).collect()
        if not over:
            return bounds
        size = sum(r["n"] for r in over)
        inside = rows.where(_range_of(bounds).isin(sorted(r["range"] for r in over)))
        want = max(2, round(size / total * ranges)) * 2
        lower = {r["range"]: tuple(r["least"]) for r in over}
        sample = np.array(drawn(inside, size, want * SAMPLES), dtype=np.int64).reshape(-1, 2)
        extra = {tuple(r["most"]) for r in over}
        by = places(bounds, sample[:, 0], sample[:, 1])
        for name in lower:
            keys = sorted({tuple(k) for k in sample[by == name].tolist()})
            keys = [k for k in keys if k > lower[name]]
            extra.update(keys[:: max(1, len(keys) * len(over) // want)])
        bounds = sorted({*bounds, *extra})


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard (0 to shards - 1), slot (gapless in the shard), grown_shard.

    Equal texts share a shard, unless their bytes or rows pass HOT_PART of a shard: such a group is cut by record.  Shard
    sizes differ from the mean by half of one uncut group at most.  Null text: size 1, crc32 of nothing, grouped with
    empty texts.  Rows that repeat an id, and null ids, are placed each.  An empty table gives an empty result.
    """
    rows = common.settle(keyed(docs), "keys")
    got = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    total, count = got[0] or 0, got[1]
    if not count:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    hot_over = max(total * HOT_PART / shards, 1)
    # At most 2 * shards / HOT_PART groups can be that large.
    hot = [r[0] for r in rows.groupBy("group").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("c")).where(((F.col("n") > hot_over) | (F.col("c") > count * HOT_PART / shards)) & (F.col("c") > 1)).select("group").collect()]
    sub = F.when(F.col("group").isin(hot), F.xxhash64("doc_id", F.lit(7))).otherwise(F.lit(0).cast("long")) if hot else F.lit(0).cast("long")
    rows = rows.withColumn("sub", sub).withColumn("load", F.col("size") / F.lit(float(total)) + F.lit(1.0 / count))
    ranges = shards * RANGES_A_SHARD + count // ROWS_A_RANGE
    bounds = splitters(rows, 2.0, ranges)
    ranged = common.settle(rows.withColumn("range", _range_of(bounds)), "ranges")
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("range").agg(F.sum("size")).collect())  # one row a range
    edges, low = {}, 0
    for name, n in sizes:
        inside = [k for k in range(1, shards) if low < total * k / shards <= low + n]
        if inside:
            edges[name] = (low, inside)
        low += n
    units = ranged.where(F.col("range").isin(list(edges))).groupBy("range", "group", "sub").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("range").orderBy("group", "sub")
    begun = units.select("range", "group", "sub", (F.sum("n").over(upto) - F.col("n")).alias("begin"), "n")
    cuts = []
    for name, (low, inside) in edges.items():
        for k in inside:
            want = total * k / shards - low
            near = begun.where(F.col("range") == name).select(
                F.min_by(F.struct("group", "sub", "begin"), F.abs(F.col("begin") - want)).alias("a"),
                F.max_by(F.struct("group", "sub", "n"), "begin").alias("last"),
                F.max(F.col("begin") + F.col("n")).alias("end"),
            ).first()
            key = (near["a"]["group"], near["a"]["sub"])
            if abs(near["end"] - want) < abs(near["a"]["begin"] - want):  # the next range's first key is nearer
                after = [b for b in bounds if b > (near["last"]["group"], near["last"]["sub"])]
                key = after[0] if after else (2**63 - 1, 2**63 - 1)
            cuts.append(key)
    cuts.sort()
    above = [(F.col("group") > g) | ((F.col("group") == g) & (F.col("sub") >= s)) for g, s in cuts]
    shard_of = sum((x.cast("int") for x in above), F.lit(0))
    placed = ranged.withColumn("shard", shard_of.cast("int"))
    order = ["group", "sub", F.col("doc_id").asc_nulls_first()]
    slotted = common.ranked(placed, ["shard"], F.col("range"), order, "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(common.table(spark, sf_dir, "documents"))
