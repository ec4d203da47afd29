"""Interval algebra along a wall: overlap rules, union, complement, section split, elementary sweep, runs, gaps.

Every operator works inside one wall or plan, so its window is bounded by the elements of one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.plans.bindings import bound
from quoin.registry import query

#: Fixed value: slack of the overlap rules in metres.
SLACK = 0.01


def overlaps_adjacent(rows: DataFrame, key: list[str]) -> DataFrame:
    """Intervals (s, e) that start before the end of the one just before them in the order (s, e, id)."""
    w = Window.partitionBy(*key).orderBy("s", "e", "id")
    return rows.withColumn("before", F.lag("e").over(w)).where(F.col("s") < F.col("before") - SLACK)


def overlaps_running(rows: DataFrame, key: list[str]) -> DataFrame:
    """Intervals that start before the largest end of all before them: nested ones count as well."""
    w = Window.partitionBy(*key).orderBy("s", "e", "id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.max("e").over(w)).where(F.col("s") < F.col("before") - SLACK)


def union(rows: DataFrame, key: list[str], gap: float = 0.0) -> DataFrame:
    """Merged intervals: those at most `gap` apart are one."""
    order = Window.partitionBy(*key).orderBy("s", "e", "id")
    upto = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(upto.isNull() | (F.col("s") - upto > gap), 1).otherwise(0))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(*key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))


def complement(rows: DataFrame, key: list[str], low: float, high: float) -> DataFrame:
    """What is left of [low, high] after all intervals, which are clipped to it."""
    clipped = rows.select(*key, "id", F.greatest("s", F.lit(low)).alias("s"), F.least("e", F.lit(high)).alias("e")).where("e > s")
    merged = union(clipped, key)
    w = Window.partitionBy(*key).orderBy("s")
    gaps = merged.select(*key, F.coalesce(F.lag("e").over(w), F.lit(low)).alias("s"), F.col("s").alias("e"))
    tail = merged.groupBy(*key).agg(F.max("e").alias("s")).select(*key, "s", F.lit(high).alias("e"))
    return gaps.unionByName(tail).where("e > s")


def elementary(rows: DataFrame, key: list[str]) -> DataFrame:
    """Elementary stretches between neighbouring ends, with what covers them: (s, e, n, kinds)."""
    ends = rows.select(*key, F.col("s").alias("p")).unionByName(rows.select(*key, F.col("e").alias("p"))).distinct()
    cells = ends.select(*key, F.col("p").alias("s"), F.lead("p").over(Window.partitionBy(*key).orderBy("p")).alias("e")).where("e is not null")
    same = F.lit(True)
    for k in key:
        same = same & (F.col(f"c.{k}") == F.col(f"r.{k}"))
    joined = cells.alias("c").join(rows.alias("r"), same & (F.col("r.s") <= F.col("c.s")) & (F.col("r.e") >= F.col("c.e")))
    return joined.groupBy(*[F.col(f"c.{k}").alias(k) for k in key], F.col("c.s").alias("s"), F.col("c.e").alias("e")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("r.kind").alias("kinds"), F.min("r.kind").alias("kind")
    )


KEY = ["plan", "wall_id"]


@query("opening_overlap_adjacent", (170,), """
SELECT plan, wall_id, count(*) AS overlaps FROM (SELECT *, lag(e) OVER (PARTITION BY plan, wall_id ORDER BY s, e, id) AS b FROM {openings})
WHERE s < b - 0.01 GROUP BY ALL""")
def opening_overlap_adjacent(spark, d):
    return overlaps_adjacent(bound(spark, d, "openings"), KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("overlaps"))


@query("opening_overlap_running", (170,), """
SELECT plan, wall_id, count(*) AS overlaps FROM (SELECT *, max(e) OVER (PARTITION BY plan, wall_id ORDER BY s, e, id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {openings}) WHERE s < b - 0.01 GROUP BY ALL""")
def opening_overlap_running(spark, d):
    return overlaps_running(bound(spark, d, "openings"), KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("overlaps"))


@query("interval_union", (142, 332), """
WITH m AS (SELECT *, max(e) OVER (PARTITION BY plan, wall_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {openings}),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR s - b > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY plan, wall_id ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT plan, wall_id, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY plan, wall_id, g""")
def interval_union(spark, d):
    return union(bound(spark, d, "openings"), KEY, 2.0).drop("island")


@query("walkable_wall_parts", (174,), """
WITH c AS (SELECT plan, wall_id, id, greatest(s, 5) AS s, least(e, 90) AS e FROM {openings} WHERE least(e, 90) > greatest(s, 5)),
b AS (SELECT *, coalesce(max(e) OVER (PARTITION BY plan, wall_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 5) AS b FROM c)
SELECT plan, wall_id, b AS s, s AS e FROM b WHERE s > b UNION ALL
SELECT plan, wall_id, max(e) AS s, 90e0 AS e FROM c GROUP BY ALL HAVING max(e) < 90""")
def walkable_wall_parts(spark, d):
    return complement(bound(spark, d, "openings"), KEY, 5.0, 90.0)


@query("wall_sections", (173, 315, 316), """
WITH c AS (SELECT plan, wall_id, id, greatest(s, 0) AS s, least(e, 100) AS e, CASE WHEN kind = 'O' THEN 0.9e0 ELSE 0e0 END AS sill, 2.1e0 AS head FROM {openings}),
b AS (SELECT *, coalesce(max(e) OVER (PARTITION BY plan, wall_id ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c)
SELECT plan, wall_id, b AS s, s AS e, 0e0 AS bottom, 3e0 AS top FROM b WHERE s > b
UNION ALL SELECT plan, wall_id, max(e), 100e0, 0e0, 3e0 FROM c GROUP BY ALL HAVING max(e) < 100
UNION ALL SELECT plan, wall_id, s, e, 0e0, sill FROM c WHERE e > s AND sill > 0
UNION ALL SELECT plan, wall_id, s, e, head, 3e0 FROM c WHERE e > s""")
def wall_sections(spark, d):
    """Full-height pieces between openings, pieces under sills and over heads; empty ones go."""
    o = bound(spark, d, "openings").withColumn("sill", F.when(F.col("kind") == "O", 0.9).otherwise(0.0))
    full = complement(o, KEY, 0.0, 100.0).select(*KEY, "s", "e", F.lit(0.0).alias("bottom"), F.lit(3.0).alias("top"))
    c = o.select(*KEY, F.greatest("s", F.lit(0.0)).alias("s"), F.least("e", F.lit(100.0)).alias("e"), "sill").where("e > s")
    under = c.where("sill > 0").select(*KEY, "s", "e", F.lit(0.0).alias("bottom"), F.col("sill").alias("top"))
    over = c.select(*KEY, "s", "e", F.lit(2.1).alias("bottom"), F.lit(3.0).alias("top"))
    return full.unionByName(under).unionByName(over)


@query("wall_finish_cells", (175, 186), """
WITH p AS (SELECT DISTINCT plan, wall_id, unnest([s, e]) AS p FROM {openings}),
c AS (SELECT plan, wall_id, p AS s, lead(p) OVER (PARTITION BY plan, wall_id ORDER BY p) AS e FROM p)
SELECT c.plan, c.wall_id, c.s, c.e, count(*) AS n, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) END AS preset
FROM c JOIN {openings} o ON o.plan = c.plan AND o.wall_id = c.wall_id AND o.s <= c.s AND o.e >= c.e WHERE c.e IS NOT NULL GROUP BY ALL""")
def wall_finish_cells(spark, d):
    """A stretch has a finish if exactly one distinct preset covers it; null marks a conflict to warn of."""
    return elementary(bound(spark, d, "openings"), KEY).select(*KEY, "s", "e", "n", F.when(F.col("kinds") == 1, F.col("kind")).alias("preset"))


@query("bridged_runs", (176,), """
WITH f AS (SELECT DISTINCT l_partkey AS plan, CAST((l_suppkey * 7 + l_linenumber * 13) % 200 AS INTEGER) AS i FROM lineitem),
b AS (SELECT *, lag(i) OVER (PARTITION BY plan ORDER BY i) AS p FROM f),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR i - p > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY plan ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM b)
SELECT plan, min(i) AS a, max(i) AS b, count(*) AS filled FROM g GROUP BY plan, g""")
def bridged_runs(spark, d):
    """Runs of filled cells, where holes of up to two cells are bridged."""
    cells = bound(spark, d, "lineitem").select(F.col("l_partkey").alias("plan"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13) % 200).cast("int").alias("i")).distinct()
    w = Window.partitionBy("plan").orderBy("i")
    before = F.lag("i").over(w)
    runs = cells.withColumn("new", F.when(before.isNull() | (F.col("i") - before > 3), 1).otherwise(0)).withColumn("g", F.sum("new").over(w))
    return runs.groupBy("plan", "g").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count(F.lit(1)).alias("filled")).drop("g")


@query("absent_runs", (177,), """
WITH f AS (SELECT DISTINCT l_partkey AS plan, CAST((l_suppkey * 7 + l_linenumber * 13) % 200 AS INTEGER) AS i FROM lineitem),
b AS (SELECT plan, coalesce(lag(i) OVER (PARTITION BY plan ORDER BY i), -1) + 1 AS a, i - 1 AS b FROM f UNION ALL SELECT plan, max(i) + 1, 199 FROM f GROUP BY plan)
SELECT plan, a, b, b - a + 1 AS n FROM b WHERE b - a + 1 > 2""")
def absent_runs(spark, d):
    """Holes that no bridge covers: runs of more than two empty cells of 200, at the ends too."""
    cells = bound(spark, d, "lineitem").select(F.col("l_partkey").alias("plan"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13) % 200).cast("int").alias("i")).distinct()
    before = F.coalesce(F.lag("i").over(Window.partitionBy("plan").orderBy("i")), F.lit(-1))
    holes = cells.select("plan", (before + 1).alias("a"), (F.col("i") - 1).alias("b")).unionByName(cells.groupBy("plan").agg((F.max("i") + 1).alias("a"), F.lit(199).alias("b")))
    return holes.select("plan", "a", "b", (F.col("b") - F.col("a") + 1).alias("n")).where("n > 2")


@query("collinear_gaps", (172,), None)
def collinear_gaps(spark, d):
    """Gaps between neighbouring collinear walls of a plan, grouped by the running mean of their line."""
    from quoin.operators.grouped import gaps

    return gaps(bound(spark, d, "walls"), tolerance=0.18)


@query("drop_collinear_points", (188, 338), """
WITH p AS (SELECT plan, ord, x1 AS x, round_even(y1, 0) AS y FROM {walls}),
n AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM p WINDOW w AS (PARTITION BY plan ORDER BY ord))
SELECT plan, ord, x, y FROM n WHERE ax IS NULL OR bx IS NULL OR abs((x-ax)*(by_-y) - (y-ay)*(bx-x)) > 1e-6""")
def drop_collinear_points(spark, d):
    w = Window.partitionBy("plan").orderBy("ord")
    p = bound(spark, d, "walls").select("plan", "ord", F.col("x1").alias("x"), F.rint("y1").alias("y"))
    n = p.select("*", F.lag("x").over(w).alias("ax"), F.lag("y").over(w).alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"))
    turn = F.abs((F.col("x") - F.col("ax")) * (F.col("by") - F.col("y")) - (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("x"))) > 1e-6
    return n.where(F.col("ax").isNull() | F.col("bx").isNull() | turn).select("plan", "ord", "x", "y")
