"""Queries over the scalar geometry functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import geometry as G
from quoin.plans.bindings import bound
from quoin.registry import query

ENDS = ("x1", "y1", "x2", "y2")


def ends():
    return [F.col(c) for c in ENDS]


def r(column, name, places: int = 6):
    """Rounded, and without a negative zero."""
    return (F.round(column, places) + 0.0).alias(name)


@query("segment_length", (34, 44, 45, 331), """
SELECT plan, ord, round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), 6) + 0.0 AS length, abs(x2-x1) >= abs(y2-y1) AS horizontal,
  CASE WHEN abs(x2-x1) >= 2.5*abs(y2-y1) THEN 'h' WHEN abs(y2-y1) >= 2.5*abs(x2-x1) THEN 'v' END AS axis FROM {walls}""")
def segment_length(spark, d):
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    return bound(spark, d, "walls").select("plan", "ord", r(G.distance(*ends()), "length"), G.horizontal(*ends()).alias("horizontal"), F.when(dx >= 2.5 * dy, "h").when(dy >= 2.5 * dx, "v").alias("axis"))


@query("axis_snap", (42, 43, 46, 322), """
WITH w AS (SELECT *, degrees(atan2(y2-y1, x2-x1)) AS raw FROM {walls}), a AS (SELECT *, raw - 180*floor(raw/180) AS ang FROM w)
SELECT plan, ord,
 round(CASE WHEN abs(x2-x1) < abs(y2-y1)*7.0/45 THEN (x1+x2)/2 ELSE x1 END, 6) + 0.0 AS ratio_x1,
 round(CASE WHEN abs(x2-x1) < abs(y2-y1)*7.0/45 THEN y1 WHEN abs(y2-y1) < abs(x2-x1)*7.0/45 THEN (y1+y2)/2 ELSE y1 END, 6) + 0.0 AS ratio_y1,
 round(CASE WHEN ang <= 7 OR ang >= 173 THEN x1 WHEN abs(ang-90) <= 7 THEN (x1+x2)/2 ELSE x1 END, 6) + 0.0 AS angle_x1,
 round(CASE WHEN ang <= 7 OR ang >= 173 THEN (y1+y2)/2 ELSE y1 END, 6) + 0.0 AS angle_y1,
 CASE WHEN (CASE WHEN abs(x2-x1) >= abs(y2-y1) THEN x1 > x2 ELSE y1 > y2 END) THEN x2 ELSE x1 END AS up_x1 FROM a""")
def axis_snap(spark, d):
    w = bound(spark, d, "walls").select("plan", "ord", G.axis_by_ratio(*ends()).alias("a"), G.axis_by_angle(*ends()).alias("b"), G.upward(*ends()).alias("c"))
    return w.select("plan", "ord", r(F.col("a.x1"), "ratio_x1"), r(F.col("a.y1"), "ratio_y1"), r(F.col("b.x1"), "angle_x1"), r(F.col("b.y1"), "angle_y1"), F.col("c.x1").alias("up_x1"))


@query("grid_snap", (40, 41, 84, 85), """
SELECT plan, ord, CAST(round_even(x1/0.25, 0) AS BIGINT) AS gx, CAST(round_even(y1/0.25, 0) AS BIGINT) AS gy,
  round_even(x1/0.25, 0)*0.25 AS sx, round_even(y1/0.25, 0)*0.25 AS sy FROM {walls}""")
def grid_snap(spark, d):
    x, y = F.col("x1"), F.col("y1")
    return bound(spark, d, "walls").select("plan", "ord", F.rint(x / 0.25).cast("long").alias("gx"), F.rint(y / 0.25).cast("long").alias("gy"), G.snap(x, 0.25).alias("sx"), G.snap(y, 0.25).alias("sy"))


@query("project_on_segment", (47, 48, 49, 50, 51, 52, 53), """
WITH p AS (SELECT *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len, 5.0 AS px, thickness*16 AS py FROM {walls}),
q AS (SELECT *, CASE WHEN len <= 1e-6 THEN 0 ELSE ((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/len END AS fo FROM p),
o AS (SELECT *, least(greatest(fo, 0), len) AS o FROM q), t AS (SELECT *, CASE WHEN len <= 1e-6 THEN 0 ELSE o/len END AS t FROM o)
SELECT plan, ord, round(fo, 5) + 0.0 AS free, round(o, 5) + 0.0 AS clamped, round(x1+t*(x2-x1), 5) + 0.0 AS x, round(y1+t*(y2-y1), 5) + 0.0 AS y,
 round(sqrt((px-x1-t*(x2-x1))*(px-x1-t*(x2-x1))+(py-y1-t*(y2-y1))*(py-y1-t*(y2-y1))), 5) + 0.0 AS dist FROM t""")
def project_on_segment(spark, d):
    p = (F.lit(5.0), F.col("thickness") * 16)
    o = G.offset(*p, *ends())
    at = G.at_offset(o, *ends())
    return bound(spark, d, "walls").select("plan", "ord", r(G.free_offset(*p, *ends()), "free", 5), r(o, "clamped", 5), r(at["x"], "x", 5), r(at["y"], "y", 5), r(G.segment_distance(*p, *ends()), "dist", 5))


@query("px_to_metres", (37, 38, 39, 72), """
SELECT plan, ord, round(m0/50, 6) + 0.0 AS x_m, round((20000 - m1)/50, 6) + 0.0 AS y_m, CASE WHEN e1 > 0 THEN round(1/e1, 6) END AS ppm,
 CASE WHEN abs(m1-m0) >= 1 AND e0 > 0 THEN round(abs(m1-m0)/e0 + 1e-7, 5) END AS reference_ppm FROM {constraints}""")
def px_to_metres(spark, d):
    m0, m1, e0, e1 = (F.col(c) for c in ("m0", "m1", "e0", "e1"))
    return bound(spark, d, "constraints").select(
        "plan", "ord", r(m0 / 50, "x_m"), r((20000 - m1) / 50, "y_m"), F.when(e1 > 0, F.round(F.try_divide(F.lit(1.0), e1), 6)).alias("ppm"),
        F.when((F.abs(m1 - m0) >= 1) & (e0 > 0), F.round(F.try_divide(F.abs(m1 - m0), e0) + 1e-7, 5)).alias("reference_ppm"),
    )


@query("opening_interval", (5, 35, 36, 313, 314), """
WITH o AS (SELECT plan, ord, CASE WHEN ord % 3 = 0 THEN s END AS s, CASE WHEN ord % 2 = 0 THEN e END AS e,
  CASE WHEN ord % 5 <> 4 THEN s + 4 END AS o, CASE WHEN kind = 'O' THEN 0.0 ELSE e - s END AS w, kind FROM {openings}),
w AS (SELECT *, CASE WHEN coalesce(w, 0) = 0 THEN CASE WHEN kind = 'O' THEN 0.9 ELSE 1.2 END ELSE w END AS ww FROM o)
SELECT plan, ord, round(CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN s ELSE o - ww/2 END, 6) AS a,
 round(CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN e ELSE o + ww/2 END, 6) AS b,
 CASE WHEN s IS NULL AND e IS NULL THEN true ELSE coalesce(e > s, false) END AS sound FROM w""")
def opening_interval(spark, d):
    o, k = F.col("ord"), F.col("kind")
    rows = bound(spark, d, "openings").select("plan", "ord", F.when(o % 3 == 0, F.col("s")).alias("s"), F.when(o % 2 == 0, F.col("e")).alias("e"), F.when(o % 5 != 4, F.col("s") + 4).alias("o"), F.when(k == "O", 0.0).otherwise(F.col("e") - F.col("s")).alias("w"), "kind")
    # A width of nothing takes the default: doors .90 m, windows 1.20 m.
    width = F.coalesce(F.nullif("w", F.lit(0.0)), F.when(k == "O", 0.9).otherwise(1.2))
    got = rows.withColumn("i", G.interval(F.col("s"), F.col("e"), F.col("o"), width))
    return got.select("plan", "ord", F.round("i.s", 6).alias("a"), F.round("i.e", 6).alias("b"), G.sound_interval(F.col("s"), F.col("e")).alias("sound"))


def l_ring():
    """An L-shaped ring from a part's size and key."""
    s, k = F.col("p_size").cast("double"), (F.col("p_partkey") % 7 + 1).cast("double")
    pts = [(0, 0), (s + k, 0), (s + k, k), (k, k), (k, s + k), (0, s + k)]
    lit = lambda v: v if not isinstance(v, int) else F.lit(float(v))
    return F.array(*[F.struct(lit(x).alias("x"), lit(y).alias("y")) for x, y in pts])


@query("ring_area", (54, 55), """
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 7 + 1 AS DOUBLE) AS k FROM part)
SELECT p_partkey, (s+k)*k + k*s AS area, round(((s+k)*k + k*s)/((s+k)*(s+k)), 6) AS fill, s + k AS side FROM p""")
def ring_area(spark, d):
    p = bound(spark, d, "part").select("p_partkey", l_ring().alias("ring"))
    side = F.aggregate("ring", F.lit(0.0), lambda m, x: F.greatest(m, x["x"]))
    return p.select("p_partkey", G.area(F.col("ring")).alias("area"), F.round(G.area(F.col("ring")) / (side * side), 6).alias("fill"), side.alias("side"))


@query("point_in_ring", (56, 57, 58), """
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 7 + 1 AS DOUBLE) AS k,
  CAST((p_partkey * 3) % 20 AS DOUBLE) / 2 AS x, CAST((p_partkey * 7) % 24 AS DOUBLE) / 2 AS y FROM part)
SELECT p_partkey, (x >= 0 AND x < s+k AND y >= 0 AND y < k) OR (x >= 0 AND x < k AND y >= k AND y < s+k) AS ray,
 (x >= 0 AND x <= s+k AND y >= 0 AND y <= k) OR (x >= 0 AND x <= k AND y >= 0 AND y <= s+k) AS closed FROM p""")
def point_in_ring(spark, d):
    x, y = ((F.col("p_partkey") * 3) % 20).cast("double") / 2, ((F.col("p_partkey") * 7) % 24).cast("double") / 2
    p = bound(spark, d, "part").select("p_partkey", l_ring().alias("ring"), x.alias("x"), y.alias("y"))
    return p.select("p_partkey", G.inside(F.col("x"), F.col("y"), F.col("ring")).alias("ray"), G.covers(F.col("x"), F.col("y"), F.col("ring")).alias("closed"))


@query("footprint_contains", (59, 60, 61, 62, 63, 333), """
WITH f AS (SELECT *, radians(rot) AS a, 3.0 - x AS dx, 2.0 - y AS dy FROM {furniture}),
l AS (SELECT *, dx*cos(a) + dy*sin(a) AS lx, dy*cos(a) - dx*sin(a) AS ly FROM f)
SELECT plan, ord, round(abs(lx), 5) <= round(w/2 + 0.3, 5) AND round(abs(ly), 5) <= round(d/2 + 0.3, 5) AS hit,
 round(x - w/2*cos(a) + d/2*sin(a), 5) + 0.0 AS cx, round(y - w/2*sin(a) - d/2*cos(a), 5) + 0.0 AS cy FROM l""")
def footprint_contains(spark, d):
    f = [F.col(c) for c in ("x", "y", "w", "d", "rot")]
    p = G.local(F.lit(3.0), F.lit(2.0), f[0], f[1], f[4])
    hit = (F.round(F.abs(p["x"]), 5) <= F.round(f[2] / 2 + 0.3, 5)) & (F.round(F.abs(p["y"]), 5) <= F.round(f[3] / 2 + 0.3, 5))
    corner = G.footprint(*f)[0]
    return bound(spark, d, "furniture").select("plan", "ord", hit.alias("hit"), r(corner["x"], "cx", 5), r(corner["y"], "cy", 5))


@query("lighting", (76, 77), """
WITH k AS (SELECT p_partkey, 1000 + (p_partkey * 37) % 11000 AS t, CAST(p_size AS DOUBLE)/25 AS br, p_retailprice/4 AS inten FROM part),
c AS (SELECT *, t/100.0 AS h FROM k),
g AS (SELECT *, CASE WHEN h <= 66 THEN 255 ELSE 329.698727446*pow(greatest(h-60,1), -0.1332047592) END AS rr,
 CASE WHEN h <= 66 THEN 99.4708025861*ln(h) - 161.1195681661 ELSE 288.1221695283*pow(greatest(h-60,1), -0.0755148492) END AS gg,
 CASE WHEN h > 66 THEN 255 WHEN h <= 19 THEN 0 ELSE 138.5177312231*ln(greatest(h-10,1)) - 305.0447927307 END AS bb FROM c)
SELECT p_partkey, round(greatest(0, least(255, rr))/255, 6) AS r, round(greatest(0, least(255, gg))/255, 6) AS g,
 round(greatest(0, least(255, bb))/255, 6) AS b, round(least(greatest(br, 0.25), 2)*least(inten, 4500)/450, 6) AS power FROM g""")
def lighting(spark, d):
    t = (1000 + (F.col("p_partkey") * 37) % 11000).cast("double")
    p = bound(spark, d, "part").withColumn("c", G.kelvin_rgb(t))
    power = F.least(F.greatest(F.col("p_size") / 25.0, F.lit(0.25)), F.lit(2.0)) * F.least(F.col("p_retailprice") / 4, F.lit(4500.0)) / 450
    return p.select("p_partkey", *[F.round(f"c.{x}", 6).alias(x) for x in "rgb"], F.round(power, 6).alias("power"))


@query("plan_bounds", (82, 83, 296), """
SELECT plan, min(least(x1,x2)) - 1 AS x0, min(least(y1,y2)) - 1 AS y0, max(greatest(x1,x2)) + 1 AS x9, max(greatest(y1,y2)) + 1 AS y9,
 count(*) AS walls FROM {walls} GROUP BY plan""")
def plan_bounds(spark, d):
    x1, y1, x2, y2 = ends()
    return bound(spark, d, "walls").groupBy("plan").agg((F.min(F.least(x1, x2)) - 1).alias("x0"), (F.min(F.least(y1, y2)) - 1).alias("y0"), (F.max(F.greatest(x1, x2)) + 1).alias("x9"), (F.max(F.greatest(y1, y2)) + 1).alias("y9"), F.count(F.lit(1)).alias("walls"))


@query("drop_short_duplicate_walls", (86, 147), """
WITH w AS (SELECT *, least(x1*10000+y1, x2*10000+y2) AS k1, greatest(x1*10000+y1, x2*10000+y2) AS k2 FROM {walls}
  WHERE (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) >= 0.25),
f AS (SELECT plan, k1, k2, min(ord) AS ord FROM w GROUP BY ALL)
SELECT plan, ord, CAST(row_number() OVER (PARTITION BY plan ORDER BY k1, k2) - 1 AS INTEGER) AS number FROM f""")
def drop_short_duplicate_walls(spark, d):
    from pyspark.sql import Window

    x1, y1, x2, y2 = ends()
    a, b = F.struct(x1.alias("x"), y1.alias("y")), F.struct(x2.alias("x"), y2.alias("y"))
    w = bound(spark, d, "walls").where((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) >= 0.25)
    first = w.groupBy("plan", F.least(a, b).alias("k1"), F.greatest(a, b).alias("k2")).agg(F.min("ord").alias("ord"))
    return first.select("plan", "ord", (F.row_number().over(Window.partitionBy("plan").orderBy("k1", "k2")) - 1).alias("number"))
