"""Floors as triangles, and floors with voids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions import triangles as T
from quoin.operators import overlay, sweeps
from quoin.plans.bindings import bound
from quoin.registry import query


def _point(x, y):
    return F.struct(x.alias("x"), y.alias("y"))


@query("floor_triangles", (249,), """
SELECT l_orderkey AS plan, 2*count(*) + 2 AS corners, sum(l_quantity % 8 + 1 + (ord % 3)*0.125e0) AS area, false AS thin FROM {lines} GROUP BY l_orderkey""")
def floor_triangles(spark, d):
    """Each plan's skyline, a ring with slanting steps, cut into triangles: their areas add up to the ring's."""
    step = F.struct("ord", (F.col("l_quantity") % 8 + 1).cast("double").alias("h"), (F.col("ord") % 3 / 4).cast("double").alias("rise"))
    plans = bound(spark, d, "lines").groupBy(F.col("l_orderkey").alias("plan")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    n, zero = F.size("steps").cast("double"), F.lit(0.0)
    tops = F.flatten(F.transform(F.reverse("steps"), lambda s: F.array(_point(s["ord"] + 1.0, s["h"]), _point(s["ord"] + 0.0, s["h"] + s["rise"]))))
    ring = F.concat(F.array(_point(zero, zero), _point(n, zero)), tops)
    cut = plans.select("plan", (F.size("steps") * 2 + 2).cast("long").alias("corners"), T.ears(ring).alias("t"))

    def half(t):
        a, b, c = t[0], t[1], t[2]
        return ((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])) / 2

    sized = cut.select("plan", "corners", F.transform("t", half).alias("areas"))
    return sized.select("plan", "corners", F.aggregate("areas", F.lit(0.0), lambda a, b: a + b).alias("area"), (F.array_min("areas") <= 0).alias("thin"))


def contacts(rings: DataFrame) -> DataFrame:
    """(plan, layer, poly) of polygons of which two rings touch or cross: no floor can be built on a pinched edge."""
    e = overlay.edges(rings).withColumn("bin", F.explode(overlay.bins(F.col("x1"), F.col("x2"), overlay.BIN)))
    a, b = e.alias("a"), e.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("plan", "layer", "poly", "bin")]

    def side(p, q, x, y):
        return (F.col(f"{p}.x2") - F.col(f"{p}.x1")) * (F.col(f"{q}.{y}") - F.col(f"{p}.y1")) - (F.col(f"{p}.y2") - F.col(f"{p}.y1")) * (F.col(f"{q}.{x}") - F.col(f"{p}.x1"))

    apart = lambda p, q: side(p, q, "x1", "y1") * side(p, q, "x2", "y2") <= 0
    boxes = (F.greatest("a.x1", "b.x1") <= F.least("a.x2", "b.x2")) & (F.least("a.y1", "a.y2") <= F.greatest("b.y1", "b.y2")) & (F.least("b.y1", "b.y2") <= F.greatest("a.y1", "a.y2"))
    met = a.join(b, same).where((F.col("a.edge.part") < F.col("b.edge.part")) & boxes & apart("a", "b") & apart("b", "a"))
    return met.select("a.plan", "a.layer", "a.poly").distinct()


@query("floors_with_voids", (249,), """
WITH v AS (SELECT r.plan, r.ord, l.ord AS k, l.x, l.y, l.x - 0.25 <= r.x0 OR l.x + 0.25 >= r.x1 OR l.y - 0.25 <= r.y0 OR l.y + 0.25 >= r.y1 AS touches FROM {rooms} r JOIN {labels_px} l ON l.plan = r.plan AND l.x > r.x0 AND l.x < r.x1 AND l.y > r.y0 AND l.y < r.y1),
t AS (SELECT a.plan, a.ord FROM v a JOIN v b ON a.plan = b.plan AND a.ord = b.ord AND a.k < b.k AND abs(a.x-b.x) <= 0.5 AND abs(a.y-b.y) <= 0.5 UNION SELECT plan, ord FROM v WHERE touches),
n AS (SELECT plan, ord, count(*) AS n FROM v GROUP BY ALL)
SELECT r.plan, r.ord, coalesce(n.n, 0) AS voids, CASE WHEN t.plan IS NULL THEN (x1-x0)*(y1-y0) - coalesce(n.n, 0)*0.25e0 END AS area FROM {rooms} r LEFT JOIN n ON n.plan = r.plan AND n.ord = r.ord LEFT JOIN t ON t.plan = r.plan AND t.ord = r.ord""")
def floors_with_voids(spark, d):
    """Area of each room's floor around the voids in it, half a metre square; null for floors whose rings touch, which are refused."""
    rooms = bound(spark, d, "rooms").select(F.struct("plan", "ord").alias("plan"), "x0", "y0", "x1", "y1", F.col("plan").alias("p"))
    labels = bound(spark, d, "labels_px").select(F.col("plan").alias("p"), F.col("ord").alias("k"), "x", "y")
    inside = (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1"))
    voids = rooms.join(labels, "p").where(inside)

    def ring(rows, part, x0, y0, x1, y1):
        corners = F.array(_point(x0, y0), _point(x1, y0), _point(x1, y1), _point(x0, y1))
        return rows.select("plan", F.lit(0).alias("layer"), F.lit(0).alias("poly"), part.alias("part"), corners.alias("ring"))

    x, y = F.col("x"), F.col("y")
    rings = ring(rooms, F.lit(0), *[F.col(c) for c in ("x0", "y0", "x1", "y1")]).unionByName(ring(voids, F.col("k") + 1, x - 0.25, y - 0.25, x + 0.25, y + 0.25))
    sound = rings.join(contacts(rings).select("plan"), "plan", "left_anti")
    area = sweeps.areas(sweeps.gathered(sound)).select("plan", F.round("first", 6).alias("area"))
    n = voids.groupBy("plan").agg(F.count(F.lit(1)).alias("voids"))
    out = rooms.select("plan").join(n, "plan", "left").join(area, "plan", "left")
    return out.select("plan.plan", "plan.ord", F.coalesce("voids", F.lit(0)).cast("long").alias("voids"), "area")
