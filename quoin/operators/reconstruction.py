"""Walls reconstructed from detected segments, all as relations: along the axes, merged, drawn to their crossings, merged again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import geometry as G
from quoin.operators.components import least_labels
from quoin.plans.bindings import bound
from quoin.registry import query
from quoin.sources.folders import settle

# Least length of a wall, thickness that reaches are measured in, reach across and along a line and their least values, gap after snapping.
LEAST, THICKNESS, ACROSS, ALONG, LEAST_ACROSS, LEAST_ALONG, TOUCHING = 0.20, 0.12, 1.5, 2.5, 0.04, 0.08, 0.01


def lines(walls: DataFrame) -> DataFrame:
    """(plan, ord, level, line, s, e, thickness) of walls laid along an axis they are near.

    Every wall is level or upright by the way it runs farther; the line of a slanting one is that of its lower end.
    """
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    laid = walls.withColumn("p", G.axis_by_angle(*ends)).select("plan", "ord", "thickness", "p.*")
    laid = laid.withColumn("level", G.horizontal(*ends)).withColumn("p", G.upward(*ends)).select("plan", "ord", "thickness", "level", "p.*")
    pick = lambda a, b: F.when(F.col("level"), F.col(a)).otherwise(F.col(b))
    return laid.select("plan", "ord", "level", pick("y1", "x1").alias("line"), pick("x1", "y1").alias("s"), pick("x2", "y2").alias("e"), "thickness")


def merged(walls: DataFrame, across: float, along: float) -> DataFrame:
    """Walls of one direction whose lines lie within `across` and whose spans within `along`, and those in turn, as one.

    A merged wall lies on the mean line, from the first start to the last end, as thick as the thickest; its ord is the
    least.  Only walls in neighbouring bins of their line meet.  Walls shorter than LEAST go.
    """
    walls = settle(walls.withColumn("bin", F.floor(F.col("line") / across)), "walls")
    a = walls.alias("a")
    b = walls.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("plan", "level", "bin")]
    gap = F.greatest("a.s", "b.s") - F.least("a.e", "b.e")
    met = a.join(b, same).where((F.col("a.ord") < F.col("b.ord")) & (F.abs(F.col("a.line") - F.col("b.line")) <= across) & (gap <= along))
    labels = least_labels(met.select(F.col("a.plan").alias("plan"), F.col("a.ord").alias("a"), F.col("b.ord").alias("b")))
    marked = walls.join(labels.withColumnRenamed("id", "ord"), ["plan", "ord"], "left").withColumn("label", F.coalesce("label", "ord"))
    one = marked.groupBy("plan", F.col("label").alias("ord"), "level").agg(F.avg("line").alias("line"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("thickness").alias("thickness"))
    return one.where(F.col("e") - F.col("s") >= LEAST)


def to_crossings(walls: DataFrame, reach: float) -> DataFrame:
    """Ends moved onto the nearest perpendicular wall's line within reach, all decided by the walls as given.

    A wall counts if it comes within reach of this one's line; of two equally near lines the lower one is taken.
    """
    ends = walls.select("plan", "ord", "level", "line", F.explode(F.array(F.struct(F.lit("s").alias("end"), F.col("s").alias("at")), F.struct(F.lit("e").alias("end"), F.col("e").alias("at")))).alias("p")).select("*", "p.*").alias("a")
    b = walls.alias("b")
    away = F.abs(F.col("b.line") - F.col("a.at"))
    met = ends.join(b, (F.col("a.plan") == F.col("b.plan")) & (F.col("a.level") != F.col("b.level"))).where((away <= reach) & F.col("a.line").between(F.col("b.s") - reach, F.col("b.e") + reach))
    best = met.groupBy("a.plan", "a.ord", "a.end").agg(F.min(F.struct(away.alias("away"), F.col("b.line").alias("line"))).alias("m"))
    moved = best.groupBy("plan", "ord").agg(*[F.max(F.when(F.col("end") == k, F.col("m.line"))).alias(f"to_{k}") for k in "se"])
    out = walls.join(moved, ["plan", "ord"], "left")
    return out.select("plan", "ord", "level", "line", F.coalesce("to_s", "s").alias("s"), F.coalesce("to_e", "e").alias("e"), "thickness")


def reconstruct(walls: DataFrame, thickness: float = THICKNESS) -> DataFrame:
    """(plan, level, line, s, e, thickness) of the walls that detected segments (plan, ord, x1, y1, x2, y2, thickness) stand for."""
    across, along = max(thickness * ACROSS, LEAST_ACROSS), max(thickness * ALONG, LEAST_ALONG)
    once = settle(merged(lines(walls), across, along), "merged")
    return merged(to_crossings(once, along), across, TOUCHING).drop("ord")


_MERGE = """
q{k} AS (SELECT a.plan, a.ord AS a, b.ord AS b FROM {w} a JOIN {w} b ON a.plan = b.plan AND a.level = b.level AND a.ord <> b.ord AND abs(a.line - b.line) <= 0.18e0 AND greatest(a.s, b.s) - least(a.e, b.e) <= {gap}),
c{k} AS (SELECT plan, ord, ord AS root FROM {w} UNION SELECT q.plan, q.b, c.root FROM c{k} c JOIN q{k} q ON q.plan = c.plan AND q.a = c.ord),
l{k} AS (SELECT plan, ord, min(root) AS label FROM c{k} GROUP BY plan, ord),
m{k} AS (SELECT w.plan, label AS ord, level, avg(line) AS line, min(s) AS s, max(e) AS e, max(thickness) AS thickness FROM {w} w JOIN l{k} l ON l.plan = w.plan AND l.ord = w.ord GROUP BY w.plan, label, level HAVING max(e) - min(s) >= 0.2e0)"""


@query("reconstructed_walls", (142, 145, 146), f"""WITH RECURSIVE t AS (SELECT *, degrees(atan2(abs(y2-y1), abs(x2-x1))) AS turn FROM {{walls}}),
x AS (SELECT plan, ord, thickness, CASE WHEN turn >= 83 THEN (x1+x2)/2 ELSE x1 END AS x1, CASE WHEN turn <= 7 THEN (y1+y2)/2 ELSE y1 END AS y1, CASE WHEN turn >= 83 THEN (x1+x2)/2 ELSE x2 END AS x2, CASE WHEN turn <= 7 THEN (y1+y2)/2 ELSE y2 END AS y2 FROM t),
w AS (SELECT plan, ord, thickness, abs(x2-x1) >= abs(y2-y1) AS level, CASE WHEN abs(x2-x1) >= abs(y2-y1) THEN CASE WHEN x1 > x2 THEN y2 ELSE y1 END ELSE CASE WHEN y1 > y2 THEN x2 ELSE x1 END END AS line,
 CASE WHEN abs(x2-x1) >= abs(y2-y1) THEN least(x1, x2) ELSE least(y1, y2) END AS s, CASE WHEN abs(x2-x1) >= abs(y2-y1) THEN greatest(x1, x2) ELSE greatest(y1, y2) END AS e FROM x),
{_MERGE.format(k=1, w="w", gap="0.3e0").strip()},
n AS (SELECT a.plan, a.ord, a.level, a.line, a.thickness, coalesce((SELECT b.line FROM m1 b WHERE b.plan = a.plan AND b.level <> a.level AND abs(b.line-a.s) <= 0.3e0 AND a.line BETWEEN b.s - 0.3e0 AND b.e + 0.3e0 ORDER BY abs(b.line-a.s), b.line LIMIT 1), a.s) AS s,
 coalesce((SELECT b.line FROM m1 b WHERE b.plan = a.plan AND b.level <> a.level AND abs(b.line-a.e) <= 0.3e0 AND a.line BETWEEN b.s - 0.3e0 AND b.e + 0.3e0 ORDER BY abs(b.line-a.e), b.line LIMIT 1), a.e) AS e FROM m1 a),
{_MERGE.format(k=2, w="n", gap="0.01e0").strip()}
SELECT plan, row_number() OVER (PARTITION BY plan ORDER BY round(CASE WHEN level THEN line ELSE s END, 4), round(CASE WHEN level THEN s ELSE line END, 4), round(CASE WHEN level THEN line ELSE e END, 4), round(CASE WHEN level THEN e ELSE line END, 4), ord) - 1 AS place, level, round(line, 6) + 0.0 AS line, round(s, 6) + 0.0 AS s, round(e, 6) + 0.0 AS e, thickness FROM m2""")
def reconstructed_walls(spark, d):
    """Each plan's walls, reconstructed, in reading order."""
    across, along = max(THICKNESS * ACROSS, LEAST_ACROSS), max(THICKNESS * ALONG, LEAST_ALONG)
    once = settle(merged(lines(bound(spark, d, "walls")), across, along), "merged")
    out = merged(to_crossings(once, along), across, TOUCHING)
    level, line, s, e = (F.col(c) for c in ("level", "line", "s", "e"))
    start, end = (F.when(level, line).otherwise(s), F.when(level, s).otherwise(line)), (F.when(level, line).otherwise(e), F.when(level, e).otherwise(line))
    order = [F.round(c, 4) for c in (*start, *end)]
    place = F.row_number().over(Window.partitionBy("plan").orderBy(*order, "ord")) - 1
    return out.select("plan", place.cast("long").alias("place"), "level", *[(F.round(c, 6) + 0.0).alias(c) for c in ("line", "s", "e")], "thickness")
