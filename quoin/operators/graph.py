"""The wall graph and what is built on it: junctions, corner gaps, merged walls, outer walls, constraints, leaves, stairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import geometry as G
from quoin.functions.text import let
from quoin.operators.furnishing import box_gap
from quoin.plans.bindings import bound
from quoin.registry import query

ENDS = ("x1", "y1", "x2", "y2")
# Tolerances and limits in metres, and assumed sizes of the fall-back constraints.
SNAP, GAP_LEAST, GAP_MOST = 0.20, 0.45, 1.2
DOOR_WIDTH, CHAIN, SPAN_LEAST, SPAN_MOST = 0.85, 1.22, 0.025, 0.16
LONG_SIDE, INNER, OUTER = 12.0, 0.115, 0.23
LEAF_LEAST, LEAF_MARGIN, LEAF_SHORTEST = 0.18, 0.04, 0.14
STEP_RISE = 0.16


def level() -> Column:
    """Whether a wall runs along x rather than along y."""
    return F.abs(F.col("x2") - F.col("x1")) >= F.abs(F.col("y2") - F.col("y1"))


def wall_ends(walls: DataFrame) -> DataFrame:
    """plan, ord, level, k (0 for the start, 1 for the end), x, y."""
    ends = F.array(F.struct(F.lit(0).alias("k"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.lit(1).alias("k"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    return walls.select("plan", "ord", level().alias("level"), F.inline(ends))


def beside(points: DataFrame, walls: DataFrame, within: float | None = None) -> DataFrame:
    """Each point with every other wall of its plan: target, target_level, px, py (nearest place on its line), dist.

    within: only walls whose box comes that near, in both directions, which spares most pairs the distance.
    """
    t = walls.select("plan", F.col("ord").alias("target"), level().alias("target_level"), *ENDS)
    ends = [F.col(c) for c in ENDS]
    at = G.at_offset(G.offset(F.col("x"), F.col("y"), *ends), *ends)
    joined = points.join(t, "plan").where("ord <> target")
    if within is not None:
        joined = joined.where(F.col("x").between(F.least("x1", "x2") - within, F.greatest("x1", "x2") + within) & F.col("y").between(F.least("y1", "y2") - within, F.greatest("y1", "y2") + within))
        # Behind a generator: a later filter on the distance would move the whole expression into the join.
        near = let(at, lambda at: F.struct(at["x"].alias("px"), at["y"].alias("py"), G.distance(F.col("x"), F.col("y"), at["x"], at["y"]).alias("dist")))
        return joined.select(*points.columns, "target", "target_level", F.inline(F.array(near)))
    joined = joined.withColumn("at", at)
    return joined.select(*points.columns, "target", "target_level", F.col("at.x").alias("px"), F.col("at.y").alias("py"), G.distance(F.col("x"), F.col("y"), F.col("at.x"), F.col("at.y")).alias("dist"))


_BESIDE = """
WITH g AS (SELECT *, abs(x2-x1) >= abs(y2-y1) AS level, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM {%s}),
e AS (SELECT plan, ord, level, 0 AS k, x1 AS x, y1 AS y FROM g UNION ALL SELECT plan, ord, level, 1, x2, y2 FROM g),
b AS (SELECT e.*, g.ord AS target, g.level AS target_level, x1, y1, x2, y2, CASE WHEN len <= 1e-6 THEN 0 ELSE least(greatest(((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/len, 0), len)/len END AS t FROM e JOIN g ON g.plan = e.plan AND g.ord <> e.ord),
p AS (SELECT *, x1+t*(x2-x1) AS px, y1+t*(y2-y1) AS py FROM b), q AS (SELECT *, sqrt((px-x)*(px-x)+(py-y)*(py-y)) AS dist FROM p)
"""


@query("corner_gaps", (133,), _BESIDE % "axis_walls" + """,
a AS (SELECT *, min(dist) OVER (PARTITION BY plan, ord, k) AS nearest FROM q WHERE level <> target_level AND abs(CASE WHEN level THEN py - y ELSE px - x END) <= 1e-6),
c AS (SELECT * FROM a WHERE nearest >= 0.45 AND dist BETWEEN 0.45 AND 1.2 QUALIFY row_number() OVER (PARTITION BY plan, ord, k ORDER BY round(dist, 9), target) = 1),
r AS (SELECT plan, ord, target, level, k, dist, round(x, 6) AS ax, round(y, 6) AS ay, round(px, 6) AS bx, round(py, 6) AS by_ FROM c),
s AS (SELECT *, CASE WHEN ax < bx OR (ax = bx AND ay <= by_) THEN [ax, ay, bx, by_] ELSE [bx, by_, ax, ay] END AS key FROM r)
SELECT plan, ord AS a, target AS b, round(dist, 6) AS gap FROM s QUALIFY row_number() OVER (PARTITION BY plan, key ORDER BY level DESC, ord, k) = 1""")
def corner_gaps(spark, d):
    """Missing legs of L and T junctions: from a wall's end, along its line, to a perpendicular wall a door's width away.

    An end that already meets a perpendicular wall has none; a leg found from both sides is one, the first.
    """
    w = bound(spark, d, "axis_walls")
    error = F.abs(F.when(F.col("level"), F.col("py") - F.col("y")).otherwise(F.col("px") - F.col("x")))
    on_line = beside(wall_ends(w), w).where((F.col("level") != F.col("target_level")) & (error <= 1e-6))
    near = F.when(F.col("dist").between(GAP_LEAST, GAP_MOST), F.struct(F.round("dist", 9).alias("d"), "target", "px", "py", "dist"))
    best = on_line.groupBy("plan", "ord", "level", "k", "x", "y").agg(F.min("dist").alias("nearest"), F.min(near).alias("b")).where((F.col("nearest") >= GAP_LEAST) & F.col("b").isNotNull())
    ends = [F.array(F.round(a, 6), F.round(b, 6)) for a, b in (("x", "y"), ("b.px", "b.py"))]
    keyed = best.select("plan", F.least(*[F.struct(e[0].alias("x"), e[1].alias("y")) for e in ends]).alias("low"), F.greatest(*[F.struct(e[0].alias("x"), e[1].alias("y")) for e in ends]).alias("high"),
                        F.struct((~F.col("level")).alias("l"), "ord", "k", F.col("b.target").alias("target"), F.col("b.dist").alias("dist")).alias("row"))
    return keyed.groupBy("plan", "low", "high").agg(F.min("row").alias("r")).select("plan", F.col("r.ord").alias("a"), F.col("r.target").alias("b"), F.round("r.dist", 6).alias("gap"))


@query("endpoint_snap", (134,), _BESIDE % "walls" + """,
n AS (SELECT * FROM q WHERE dist <= 0.2 QUALIFY row_number() OVER (PARTITION BY plan, ord, k ORDER BY dist, target) = 1), m AS (SELECT * FROM n WHERE dist > 1e-9)
SELECT g.plan, g.ord, round(coalesce(a.px, g.x1), 5) + 0.0 AS x1, round(coalesce(a.py, g.y1), 5) + 0.0 AS y1, round(coalesce(b.px, g.x2), 5) + 0.0 AS x2, round(coalesce(b.py, g.y2), 5) + 0.0 AS y2
FROM g LEFT JOIN m a ON a.plan = g.plan AND a.ord = g.ord AND a.k = 0 LEFT JOIN m b ON b.plan = g.plan AND b.ord = g.ord AND b.k = 1 WHERE g.len > 0""")
def endpoint_snap(spark, d):
    """Both ends of every wall move to the nearest other centre line within SNAP; all distances use the walls as given."""
    w = bound(spark, d, "walls")
    near = beside(wall_ends(w), w, SNAP + 1e-6).where(F.col("dist") <= SNAP)
    best = near.groupBy("plan", "ord", "k").agg(F.min(F.struct("dist", "target", "px", "py")).alias("b")).where("b.dist > 1e-9")
    moved = best.groupBy("plan", "ord").agg(*[F.max(F.when(F.col("k") == k, F.col(f"b.p{c}"))).alias(f"n{c}{k + 1}") for k in (0, 1) for c in "xy"])
    joined = w.where(G.distance(*[F.col(c) for c in ENDS]) > 0).join(moved, ["plan", "ord"], "left")
    return joined.select("plan", "ord", *[(F.round(F.coalesce(f"n{c}", c), 5) + 0.0).alias(c) for c in ENDS])


@query("merge_pairs", (328,), """
WITH w AS (SELECT *, abs(x2-x1) >= abs(y2-y1) AS level FROM {walls})
SELECT a.plan, a.ord AS a, b.ord AS b, CASE WHEN a.level THEN least(a.x1, a.x2, b.x1, b.x2) ELSE (a.x1+a.x2+b.x1+b.x2)/4 END AS x1, CASE WHEN a.level THEN (a.y1+a.y2+b.y1+b.y2)/4 ELSE least(a.y1, a.y2, b.y1, b.y2) END AS y1,
 CASE WHEN a.level THEN greatest(a.x1, a.x2, b.x1, b.x2) ELSE (a.x1+a.x2+b.x1+b.x2)/4 END AS x2, CASE WHEN a.level THEN (a.y1+a.y2+b.y1+b.y2)/4 ELSE greatest(a.y1, a.y2, b.y1, b.y2) END AS y2,
 greatest(a.thickness, b.thickness) AS thickness, a.external OR b.external AS external, (a.confidence + b.confidence)/2 AS confidence
FROM w a JOIN w b ON b.plan = a.plan AND b.ord = a.ord + 1 AND b.level = a.level""")
def merge_pairs(spark, d):
    """A wall and the next of its direction as one: mean line of the four ends, joint span, the thicker, outer if one is."""
    w = bound(spark, d, "walls").withColumn("level", level())
    pair = merged_pair(w.withColumnRenamed("ord", "a"), w.withColumn("a", F.col("ord") - 1).withColumnRenamed("ord", "b"), ["plan", "a", "level"])
    return pair.select("plan", "a", "b", *ENDS, "thickness", "external", "confidence")


def merged_pair(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """first JOIN second, with the ends, thickness, external and confidence of the merged wall."""
    values = [*ENDS, "thickness", "external", "confidence"]
    j = first.join(second.withColumnsRenamed({c: f"o_{c}" for c in values}), on)
    xs, ys = ([F.col(p + c) for p in ("", "o_") for c in (f"{v}1", f"{v}2")] for v in "xy")
    mean = lambda v: sum(v[1:], v[0]) / 4
    flat = F.col("level")
    out = {
        "x1": F.when(flat, F.least(*xs)).otherwise(mean(xs)), "x2": F.when(flat, F.greatest(*xs)).otherwise(mean(xs)),
        "y1": F.when(flat, mean(ys)).otherwise(F.least(*ys)), "y2": F.when(flat, mean(ys)).otherwise(F.greatest(*ys)),
        "thickness": F.greatest("thickness", "o_thickness"), "external": F.col("external") | F.col("o_external"), "confidence": (F.col("confidence") + F.col("o_confidence")) / 2,
    }
    return j.withColumns(out)


@query("extend_walls", (329,), """
WITH g AS (SELECT plan, ord, x1, y1, x2, y2, lead(x1) OVER w AS gx, lead(y1) OVER w AS gy, abs(x2-x1) >= abs(y2-y1) AS level FROM {walls} WINDOW w AS (PARTITION BY plan ORDER BY ord))
SELECT plan, ord, CASE WHEN level THEN least(x1, x2, gx) ELSE (x1+x2+x2+gx)/4 END AS x1, CASE WHEN level THEN (y1+y2+y2+gy)/4 ELSE least(y1, y2, gy) END AS y1,
 CASE WHEN level THEN greatest(x1, x2, gx) ELSE (x1+x2+x2+gx)/4 END AS x2, CASE WHEN level THEN (y1+y2+y2+gy)/4 ELSE greatest(y1, y2, gy) END AS y2 FROM g WHERE gx IS NOT NULL""")
def extend_walls(spark, d):
    """A wall drawn out over the gap from its end to the next wall's start: joint span, mean line."""
    after = Window.partitionBy("plan").orderBy("ord")
    g = bound(spark, d, "walls").select("plan", "ord", *ENDS, F.lead("x1").over(after).alias("gx"), F.lead("y1").over(after).alias("gy"), level().alias("level")).where("gx is not null")
    span = lambda v, f: f(f"{v}1", f"{v}2", f"g{v}")
    mean = lambda v: (F.col(f"{v}1") + F.col(f"{v}2") + F.col(f"{v}2") + F.col(f"g{v}")) / 4
    x = [F.when(F.col("level"), span("x", f)).otherwise(mean("x")) for f in (F.least, F.greatest)]
    y = [F.when(F.col("level"), mean("y")).otherwise(span("y", f)) for f in (F.least, F.greatest)]
    return g.select("plan", "ord", x[0].alias("x1"), y[0].alias("y1"), x[1].alias("x2"), y[1].alias("y2"))


@query("external_walls", (148,), """
WITH c AS (SELECT plan, ord, (x1+x2)/2 AS cx, (y1+y2)/2 AS cy FROM {walls}), m AS (SELECT *, min(cx) OVER p AS ax, max(cx) OVER p AS bx, min(cy) OVER p AS ay, max(cy) OVER p AS by_ FROM c WINDOW p AS (PARTITION BY plan))
SELECT plan, ord, abs(cx-ax) <= 0.35 OR abs(cx-bx) <= 0.35 OR abs(cy-ay) <= 0.35 OR abs(cy-by_) <= 0.35 AS external FROM m""")
def external_walls(spark, d):
    """Walls whose middle lies within 3.5 % of the image's longer side (10 m here) of the outermost middles."""
    plan = Window.partitionBy("plan")
    c = bound(spark, d, "walls").select("plan", "ord", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    near = [F.abs(F.col(v) - f(v).over(plan)) <= 0.35 for v in ("cx", "cy") for f in (F.min, F.max)]
    return c.select("plan", "ord", (near[0] | near[1] | near[2] | near[3]).alias("external"))


@query("built_constraints", (139, 140, 141, 195), """
WITH s AS (SELECT plan, greatest(max(greatest(x1, x2)) - min(least(x1, x2)), max(greatest(y1, y2)) - min(least(y1, y2)))*16 AS span FROM {walls} GROUP BY plan)
SELECT plan, 'room_dimension' AS tier, row_number() OVER (PARTITION BY plan ORDER BY ord) - 1 AS k, (x1-x0)*16 AS m0, (y1-y0)*16 AS m1, x1-x0 + 0.25 AS e0, y1-y0 AS e1, 1.0e0 AS weight FROM {rooms} WHERE ord % 3 <> 0
UNION ALL SELECT plan, 'plan_extent', 0, span, span, 12, 12, 0.15e0 FROM s WHERE span > 0
UNION ALL SELECT plan, 'wall_thickness', row_number() OVER (PARTITION BY plan ORDER BY ord) - 1, thickness*16, thickness*16, CASE WHEN external THEN 0.23e0 ELSE 0.115e0 END, CASE WHEN external THEN 0.23e0 ELSE 0.115e0 END, CASE WHEN external THEN 0.25e0 ELSE 0.18e0 END FROM {walls}""")
def built_constraints(spark, d):
    """Scale constraints made of a plan's elements: labelled rooms, the plan's extent, the thickness of its walls.

    Pixels are sixteenths of a metre.  A room has a labelled size unless its place is a multiple of three (that rule of the
    binding stands for OCR); extent and thickness are assumed sizes with small weights.
    """
    tier = lambda rows, name, m, e, weight, k: rows.select("plan", F.lit(name).alias("tier"), k.cast("long").alias("k"), m[0].alias("m0"), m[1].alias("m1"), e[0].cast("double").alias("e0"), e[1].cast("double").alias("e1"), weight.cast("double").alias("weight"))
    place = F.row_number().over(Window.partitionBy("plan").orderBy("ord")) - 1
    rooms, walls = bound(spark, d, "rooms").where("ord % 3 <> 0"), bound(spark, d, "walls")
    side = [F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")]
    by_room = tier(rooms, "room_dimension", [s * 16 for s in side], [side[0] + 0.25, side[1]], F.lit(1.0), place)
    span = [F.max(F.greatest(f"{v}1", f"{v}2")) - F.min(F.least(f"{v}1", f"{v}2")) for v in "xy"]
    extent = walls.groupBy("plan").agg((F.greatest(*span) * 16).alias("span")).where("span > 0")
    by_extent = tier(extent, "plan_extent", [F.col("span")] * 2, [F.lit(LONG_SIDE)] * 2, F.lit(0.15), F.lit(0))
    nominal = F.when(F.col("external"), OUTER).otherwise(INNER)
    by_wall = tier(walls, "wall_thickness", [F.col("thickness") * 16] * 2, [nominal] * 2, F.when(F.col("external"), 0.25).otherwise(0.18), place)
    return by_room.unionByName(by_extent).unionByName(by_wall)


@query("door_gap_constraints", (138,), """
WITH s AS (SELECT plan, greatest(max(greatest(x1, x2)) - min(least(x1, x2)), max(greatest(y1, y2)) - min(least(y1, y2)), 1.0/16)*16 AS span FROM {walls} GROUP BY plan),
g AS (SELECT o.plan, o.ord, (o.e - o.s)/8 AS gap FROM {openings} o JOIN s ON s.plan = o.plan WHERE (o.e - o.s)/8 BETWEEN s.span*0.025 AND s.span*0.16),
n AS (SELECT *, lag(gap) OVER (PARTITION BY plan ORDER BY gap, ord) AS before FROM g),
c AS (SELECT *, sum(CASE WHEN before IS NULL OR gap > before*1.22 THEN 1 ELSE 0 END) OVER (PARTITION BY plan ORDER BY gap, ord ROWS UNBOUNDED PRECEDING) AS c FROM n),
m AS (SELECT plan, c, count(*) AS n, list(gap ORDER BY gap, ord)[count(*)//2 + 1] AS mid FROM c GROUP BY plan, c HAVING count(*) >= 2),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY plan ORDER BY n DESC, mid) = 1)
SELECT c.plan, c.ord, c.gap AS measured, 0.85e0 AS expected FROM c JOIN b ON b.plan = c.plan AND b.c = c.c WHERE c.gap > 2""")
def door_gap_constraints(spark, d):
    """Of gaps of 2.5 to 16 % of a plan's span the largest chain in which each is at most CHAIN times the last.

    Two gaps at least; of equally long chains the one with the smaller middle.  Each of its gaps over two pixels is taken
    for a door of DOOR_WIDTH.
    """
    span = [F.max(F.greatest(f"{v}1", f"{v}2")) - F.min(F.least(f"{v}1", f"{v}2")) for v in "xy"]
    spans = bound(spark, d, "walls").groupBy("plan").agg((F.greatest(*span, F.lit(1 / 16)) * 16).alias("span"))
    gap = (F.col("e") - F.col("s")) / 8
    g = bound(spark, d, "openings").join(spans, "plan").select("plan", "ord", "span", gap.alias("gap")).where(F.col("gap").between(F.col("span") * SPAN_LEAST, F.col("span") * SPAN_MOST))
    by_gap = Window.partitionBy("plan").orderBy("gap", "ord")
    before = F.lag("gap").over(by_gap)
    c = g.withColumn("new", F.when(before.isNull() | (F.col("gap") > before * CHAIN), 1).otherwise(0)).withColumn("c", F.sum("new").over(by_gap))
    n = F.count(F.lit(1))
    chains = c.groupBy("plan", "c").agg(n.alias("n"), F.array_sort(F.collect_list(F.struct("gap", "ord"))).alias("all")).where("n >= 2")
    mid = F.element_at("all", (F.floor(F.col("n") / 2) + 1).cast("int"))["gap"]
    best = chains.groupBy("plan").agg(F.min(F.struct((-F.col("n")).alias("n"), mid.alias("mid"), "c")).alias("b")).select("plan", "b.c")
    return c.join(best, ["plan", "c"]).where("gap > 2").select("plan", "ord", F.col("gap").alias("measured"), F.lit(DOOR_WIDTH).alias("expected"))


@query("door_leaf_obstacles", (239,), """
WITH j AS (SELECT o.plan, o.ord, greatest(0, o.s/16) AS s, least(len, o.e/16) AS e, x1, y1, (x2-x1)/len AS ux, (y2-y1)/len AS uy, o.ord % 2 = 0 AS at_start, CASE WHEN o.ord % 3 = 0 THEN -1.0 ELSE 1.0 END AS swing
 FROM {openings} o JOIN (SELECT *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM {walls}) w ON w.plan = o.plan AND w.id = o.wall_id WHERE o.kind = 'O' AND len > 1e-6),
k AS (SELECT *, e - s AS width, CASE WHEN at_start THEN s ELSE e END AS hinge, CASE WHEN at_start THEN 1.0 ELSE -1.0 END AS way FROM j WHERE e - s >= 0.18)
SELECT plan, ord, round(x1 + ux*hinge - way*swing*uy*way*width/2, 5) + 0.0 AS cx, round(y1 + uy*hinge + way*swing*ux*way*width/2, 5) + 0.0 AS cy, round(greatest(0.14, width - 0.04), 5) AS length FROM k""")
def door_leaf_obstacles(spark, d):
    """Leaves of doors that stand open at a right angle: middle and length; hinge and swing from the door's place in its list.

    The opening is clipped to its wall; doors without a wall, on a wall without length or under LEAF_LEAST wide have none.
    """
    w = bound(spark, d, "walls").select("plan", F.col("id").alias("wall_id"), *ENDS, G.distance(*[F.col(c) for c in ENDS]).alias("len")).where("len > 1e-6")
    j = bound(spark, d, "openings").where("kind = 'O'").join(w, ["plan", "wall_id"])
    s, e = F.greatest(F.lit(0.0), F.col("s") / 16), F.least("len", F.col("e") / 16)
    j = j.select("plan", "ord", "x1", "y1", s.alias("s"), e.alias("e"), ((F.col("x2") - F.col("x1")) / F.col("len")).alias("ux"), ((F.col("y2") - F.col("y1")) / F.col("len")).alias("uy"))
    width, at_start = F.col("e") - F.col("s"), F.col("ord") % 2 == 0
    way, swing = F.when(at_start, 1.0).otherwise(-1.0), F.when(F.col("ord") % 3 == 0, -1.0).otherwise(1.0)
    hinge = F.when(at_start, F.col("s")).otherwise(F.col("e"))
    # The leaf's direction is the wall's, turned by way * swing * 90 degrees; its middle lies way * width / 2 along it.
    cx = F.col("x1") + F.col("ux") * hinge - way * swing * F.col("uy") * way * width / 2
    cy = F.col("y1") + F.col("uy") * hinge + way * swing * F.col("ux") * way * width / 2
    out = j.where(width >= LEAF_LEAST)
    return out.select("plan", "ord", (F.round(cx, 5) + 0.0).alias("cx"), (F.round(cy, 5) + 0.0).alias("cy"), F.round(F.greatest(F.lit(LEAF_SHORTEST), width - LEAF_MARGIN), 5).alias("length"))


@query("stair_parts", (250,), """
WITH r AS (SELECT plan, ord, x1-x0 AS w, y1-y0 AS d, ord % 2 = 1 AS dogleg, 3 + ord % 5 AS steps FROM {rooms}),
t AS (SELECT *, CASE WHEN dogleg THEN least(w/2, d/3) ELSE 0 END AS landing, 0.16*steps*CASE WHEN dogleg THEN 2 ELSE 1 END AS total FROM r), i AS (SELECT t.*, i, (d - landing)/steps AS tread FROM t, range(0, 8) x(i) WHERE i < steps)
SELECT plan, ord, 'step' AS part, i, CASE WHEN dogleg THEN -w/4 ELSE 0 END AS x, round(-d/2 + tread*(i + 0.5), 6) + 0.0 AS y, CASE WHEN dogleg THEN w/2 ELSE w END AS width, round(tread, 6) AS depth, round(0.16*(i + 1), 6) AS height FROM i
UNION ALL SELECT plan, ord, 'back', i, w/4, round(d/2 - landing - tread*(i + 0.5), 6) + 0.0, w/2, round(tread, 6), round(total/2 + 0.16*(i + 1), 6) FROM i WHERE dogleg
UNION ALL SELECT plan, ord, 'landing', 0, 0, round(d/2 - landing/2, 6), w, round(landing, 6), round(total/2, 6) FROM t WHERE dogleg""")
def stair_parts(spark, d):
    """Boxes of straight and two-flight stairs in their footprint: steps up, a landing at its end, steps back.

    A step rises STEP_RISE; the landing is as deep as half the width or a third of the depth, the smaller.
    """
    w, depth, dogleg = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("ord") % 2 == 1
    r = bound(spark, d, "rooms").select("plan", "ord", w.alias("w"), depth.alias("d"), dogleg.alias("dogleg"), (3 + F.col("ord") % 5).alias("steps"))
    w, depth, dogleg, i = F.col("w"), F.col("d"), F.col("dogleg"), F.col("i")
    t = r.withColumn("landing", F.when(dogleg, F.least(w / 2, depth / 3)).otherwise(0.0)).withColumn("half", STEP_RISE * F.col("steps"))
    steps = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps") - 1))).withColumn("tread", (depth - F.col("landing")) / F.col("steps"))
    cols = lambda rows, part, n, x, y, width, deep, height: rows.select("plan", "ord", F.lit(part).alias("part"), n.cast("int").alias("i"), x.alias("x"), (F.round(y, 6) + 0.0).alias("y"), width.alias("width"), F.round(deep, 6).alias("depth"), F.round(height, 6).alias("height"))
    rise, tread = STEP_RISE * (i + 1), F.col("tread")
    up = cols(steps, "step", i, F.when(dogleg, -w / 4).otherwise(0.0), -depth / 2 + tread * (i + 0.5), F.when(dogleg, w / 2).otherwise(w), tread, rise)
    back = cols(steps.where(dogleg), "back", i, w / 4, depth / 2 - F.col("landing") - tread * (i + 0.5), w / 2, tread, F.col("half") + rise)
    flat = cols(t.where(dogleg), "landing", F.lit(0), F.lit(0.0), depth / 2 - F.col("landing") / 2, w, F.col("landing"), F.col("half"))
    return up.unionByName(back).unionByName(flat)


@query("opening_faults", (171,), """
WITH o AS (SELECT o.*, w.len, 1.0 + ord % 4 * 0.5 AS top, max(o.e) OVER (PARTITION BY o.plan, o.wall_id ORDER BY o.s, o.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
 FROM {openings} o JOIN (SELECT plan AS p, id, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))*16 AS len FROM {walls}) w ON w.p = o.plan AND w.id = o.wall_id)
SELECT plan, wall_id, ord, s < 0 OR e > len AS outside, top > 2.4 AS too_high, coalesce(s < before, false) AS overlaps FROM o WHERE s < 0 OR e > len OR top > 2.4 OR s < before""")
def opening_faults(spark, d):
    """Openings outside their wall, above its top, or over any opening before them on it: what a builder refuses."""
    w = bound(spark, d, "walls").select("plan", F.col("id").alias("wall_id"), (G.distance(*[F.col(c) for c in ENDS]) * 16).alias("len"))
    before = F.max("e").over(Window.partitionBy("plan", "wall_id").orderBy("s", "ord").rowsBetween(Window.unboundedPreceding, -1))
    o = bound(spark, d, "openings").join(w, ["plan", "wall_id"]).withColumn("before", before)
    o = o.select("plan", "wall_id", "ord", ((F.col("s") < 0) | (F.col("e") > F.col("len"))).alias("outside"), (1 + F.col("ord") % 4 * 0.5 > 2.4).alias("too_high"), F.coalesce(F.col("s") < F.col("before"), F.lit(False)).alias("overlaps"))
    return o.where("outside or too_high or overlaps")


@query("clear_rooms", (123,), """
WITH w AS (SELECT *, abs(x2-x1) AS dx, abs(y2-y1) AS dy FROM {axis_walls}), v AS (SELECT plan, (x1+x2)/2 AS c, least(y1,y2) AS a, greatest(y1,y2) AS b, thickness FROM w WHERE dx < 2.5*dy AND dy >= 2.5*dx),
h AS (SELECT plan, (y1+y2)/2 AS c, least(x1,x2) AS a, greatest(x1,x2) AS b, thickness FROM w WHERE dx >= 2.5*dy), l AS (SELECT plan, ord, x, y FROM {labels_px}),
p AS (SELECT l.plan, l.ord, max(CASE WHEN c < x THEN struct_pack(c := c, t := thickness) END) AS lo, min(CASE WHEN c > x THEN struct_pack(c := c, t := thickness) END) AS hi FROM l JOIN v ON v.plan = l.plan AND v.a <= y + 0.5 AND v.b >= y - 0.5 GROUP BY ALL),
q AS (SELECT l.plan, l.ord, max(CASE WHEN c < y THEN struct_pack(c := c, t := thickness) END) AS lo, min(CASE WHEN c > y THEN struct_pack(c := c, t := thickness) END) AS hi FROM l JOIN h ON h.plan = l.plan AND h.a <= x + 0.5 AND h.b >= x - 0.5 GROUP BY ALL),
s AS (SELECT plan, ord, p.hi.c - p.lo.c - (p.hi.t + p.lo.t)/2 AS width, q.hi.c - q.lo.c - (q.hi.t + q.lo.t)/2 AS depth FROM p JOIN q USING (plan, ord) WHERE p.lo IS NOT NULL AND p.hi IS NOT NULL AND q.lo IS NOT NULL AND q.hi IS NOT NULL)
SELECT plan, ord, width, depth FROM s WHERE width > 0.25 AND depth > 0.25""")
def clear_rooms(spark, d):
    """Clear width and depth about a label between its four nearest walls, less half of each wall's thickness.

    A wall counts as level or upright if it runs 2.5 times as far that way; its span must reach the label's box (.5 m
    about it).  Labels without all four walls, or with hardly any room between them, give nothing.
    """
    w = bound(spark, d, "axis_walls")
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))

    def bounds(rows, v, o):
        walls = rows.select("plan", ((F.col(f"{v}1") + F.col(f"{v}2")) / 2).alias("c"), F.least(f"{o}1", f"{o}2").alias("a"), F.greatest(f"{o}1", f"{o}2").alias("b"), F.col("thickness").alias("t"))
        label = bound(spark, d, "labels_px").select("plan", "ord", F.col(v).alias("at"), F.col(o).alias("across"))
        j = label.join(walls, "plan").where((F.col("a") <= F.col("across") + 0.5) & (F.col("b") >= F.col("across") - 0.5))
        edge = F.struct("c", "t")
        out = j.groupBy("plan", "ord").agg(F.max(F.when(F.col("c") < F.col("at"), edge)).alias("lo"), F.min(F.when(F.col("c") > F.col("at"), edge)).alias("hi")).where("lo is not null and hi is not null")
        return out.select("plan", "ord", (F.col("hi.c") - F.col("lo.c") - (F.col("hi.t") + F.col("lo.t")) / 2).alias("width" if v == "x" else "depth"))

    both = bounds(w.where((dx < 2.5 * dy) & (dy >= 2.5 * dx)), "x", "y").join(bounds(w.where(dx >= 2.5 * dy), "y", "x"), ["plan", "ord"])
    return both.where("width > 0.25 and depth > 0.25")


@query("footprint_clearance", (64,), """
WITH j AS (SELECT l.plan, l.ord, f.ord AS item, f.w/2 AS hx, f.d/2 AS hy, cos(radians(-f.rot)) AS c, sin(radians(-f.rot)) AS s, l.x - f.x AS px, l.y - f.y AS py, -f.x AS qx, -f.y AS qy FROM {labels_px} l JOIN {furniture} f ON f.plan = l.plan),
k AS (SELECT plan, ord, item, hx, hy, px*c - py*s AS ax, px*s + py*c AS ay, qx*c - qy*s AS bx, qx*s + qy*c AS by_ FROM j),
t AS (SELECT *, CASE WHEN bx = ax THEN CASE WHEN abs(ax) > hx THEN 2 ELSE 0 END ELSE least((-hx-ax)/(bx-ax), (hx-ax)/(bx-ax)) END AS x0, CASE WHEN bx = ax THEN 1 ELSE greatest((-hx-ax)/(bx-ax), (hx-ax)/(bx-ax)) END AS x1,
 CASE WHEN by_ = ay THEN CASE WHEN abs(ay) > hy THEN 2 ELSE 0 END ELSE least((-hy-ay)/(by_-ay), (hy-ay)/(by_-ay)) END AS y0, CASE WHEN by_ = ay THEN 1 ELSE greatest((-hy-ay)/(by_-ay), (hy-ay)/(by_-ay)) END AS y1, (bx-ax)*(bx-ax) + (by_-ay)*(by_-ay) AS l2 FROM k),
u AS (SELECT t.*, sx*hx AS cx, sy*hy AS cy FROM t, (VALUES (-1), (1)) a(sx), (VALUES (-1), (1)) b(sy)),
v AS (SELECT *, CASE WHEN l2 <= 1e-12 THEN 0 ELSE least(greatest(((cx-ax)*(bx-ax) + (cy-ay)*(by_-ay))/l2, 0), 1) END AS f FROM u),
d AS (SELECT plan, ord, item, bool_and(greatest(x0, y0, 0) <= least(x1, y1, 1)) AS hit, min(sqrt((ax + f*(bx-ax) - cx)*(ax + f*(bx-ax) - cx) + (ay + f*(by_-ay) - cy)*(ay + f*(by_-ay) - cy))) AS corner,
 min(sqrt(greatest(abs(ax)-hx, 0)*greatest(abs(ax)-hx, 0) + greatest(abs(ay)-hy, 0)*greatest(abs(ay)-hy, 0))) AS pa, min(sqrt(greatest(abs(bx)-hx, 0)*greatest(abs(bx)-hx, 0) + greatest(abs(by_)-hy, 0)*greatest(abs(by_)-hy, 0))) AS pb FROM v GROUP BY ALL)
SELECT plan, ord, item, round(CASE WHEN hit THEN 0 ELSE least(corner, pa, pb) END, 5) + 0.0 AS clearance FROM d""")
def footprint_clearance(spark, d):
    """Distance from the way between each label and the origin to each turned footprint of its plan; 0 if it meets it.

    In the footprint's own frame: the segment clipped to two slabs, else the least distance of a corner to the segment or
    of one of its ends to the rectangle.
    """
    f = bound(spark, d, "furniture").select("plan", F.col("ord").alias("item"), F.col("x").alias("fx"), F.col("y").alias("fy"), (F.col("w") / 2).alias("hx"), (F.col("d") / 2).alias("hy"), F.radians(-F.col("rot")).alias("turn"))
    j = bound(spark, d, "labels_px").select("plan", "ord", "x", "y").join(f, "plan")
    c, s = F.cos("turn"), F.sin("turn")
    local = lambda x, y: ((x - F.col("fx")) * c - (y - F.col("fy")) * s, (x - F.col("fx")) * s + (y - F.col("fy")) * c)
    (ax, ay), (bx, by) = local(F.col("x"), F.col("y")), local(F.lit(0.0), F.lit(0.0))
    # Behind a generator, so that the ends' places are not copied into every step below.
    k = j.select("plan", "ord", "item", "hx", "hy", F.inline(F.array(F.struct(ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")))))
    return k.select("plan", "ord", "item", (F.round(box_gap(), 5) + 0.0).alias("clearance"))
