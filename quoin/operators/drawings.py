"""Drawings: annotation files, ink as runs of pixels, wall bands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quoin.functions.geometry import distance
from quoin.functions.hulls import least_box
from quoin.operators.furnishing import first_kept
from quoin.plans.bindings import bound
from quoin.registry import query
from quoin.sources.annotations import annotations, clipped
from quoin.sources.folders import settle, shared_folder

#: Pixels of an image's side.
IMAGE = 800


@query("annotation_scan", (8,), """
WITH b AS (SELECT plan, ord, CASE ord % 3 WHEN 0 THEN 'walls' WHEN 1 THEN 'rooms' ELSE 'outdoor_rooms' END AS category, CASE WHEN ord % 2 = 0 THEN 2 ELSE 1 END AS k, CASE WHEN ord % 3 = 1 THEN 5 ELSE 0 END AS t, place, s, e, thickness FROM {bands}),
x AS (SELECT plan, ord, category, greatest(0, least(800, 10 + k*(s + t))) AS x0, greatest(0, least(800, 10 + k*(e + t))) AS x1, greatest(0, least(800, 20 + k*place)) AS y0, greatest(0, least(800, 20 + k*(place + thickness))) AS y1 FROM b),
a AS (SELECT *, (x1-x0)*(y1-y0) AS area FROM x)
SELECT plan, category, count(*) AS polygons, count(*) FILTER (area <= 0) AS errors, sum(area) AS area FROM a GROUP BY ALL
UNION ALL SELECT DISTINCT plan, 'walls and rooms', 1, 1, 0 FROM a WHERE plan % 10 = 0""")
def annotation_scan(spark, d):
    """Polygons, errors and area inside the image of each drawing and category, from SVG files with nested transforms.

    The files are written first, one a drawing; every tenth has a group with two polygons, which is an error.
    """
    b = bound(spark, d, "bands")
    number = lambda c: c.cast("string")
    x0, x1, y0, y1 = F.col("s"), F.col("e"), F.col("place"), F.col("place") + F.col("thickness")
    corner = F.concat_ws(" ", *[F.concat(number(x), F.lit(","), number(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    kind = F.element_at(F.array(*map(F.lit, ("Wall", "Space Bedroom", "Space Outdoor"))), F.col("ord") % 3 + 1)
    group = F.concat(
        F.lit('<g class="'), kind, F.lit('"'), F.when(F.col("ord") % 2 == 0, ' transform="scale(2)"').otherwise(""), F.lit("><title>x</title><polygon"),
        F.when(F.col("ord") % 3 == 1, ' transform="translate(5,0)"').otherwise(""), F.lit(' points="'), corner, F.lit('"/></g>'),
    )
    broken = F.when(F.col("plan") % 10 == 0, '<g class="Wall Space"><polygon points="0,0 1,0 1,1"/><polygon points="0,0 1,0 1,1"/></g>').otherwise("")
    groups = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", group.alias("g")))), lambda x: x["g"]), "")
    files = b.groupBy("plan").agg(groups.alias("g")).select("plan", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"><g transform="translate(10 20)">'), "g", F.lit("</g>"), broken, F.lit("</svg>")).alias("value"))
    folder = shared_folder(spark, "drawings")
    files.write.partitionBy("plan").text(folder)
    found = clipped(annotations(spark, f"{folder}/*/*.txt"), IMAGE, IMAGE)
    plan = F.regexp_extract("path", r"/plan=(\d+)/", 1).cast("long")
    name = F.when(F.col("error") == "expected one direct polygon", "walls and rooms").otherwise(F.col("category"))
    out = found.groupBy(plan.alias("plan"), name.alias("category")).agg(F.count(F.lit(1)).alias("polygons"), F.count("error").alias("errors"), F.sum(F.coalesce("area", F.lit(0.0))).alias("area"))
    return out.withColumn("area", F.round("area", 6))


# Pixels a metre, least area and side of an object, least distance of two and its share of the smallest side, most objects.
PPM, LEAST_AREA, LEAST_PIXELS, APART, APART_PART, OBJECTS = 30.0, 90.0, 3.0, 8.0, 0.5, 80


def footprints(objects):
    """Objects (plan, ord, points) as turned boxes: plan, ord, x, y, width, depth, rotation.

    Too small ones go, and so do those whose middle lies near that of a kept larger one; at most OBJECTS of a drawing stay.
    """
    # Behind a generator, as a filter on the boxes would otherwise have them found twice.
    boxes = objects.select("plan", "ord", F.inline(F.array(least_box(F.col("points")))))
    # Sizes are rounded before they decide, so that equal boxes tie.
    boxes = boxes.withColumns({c: F.round(c, 6) + 0.0 for c in ("area", "x", "y", "width", "depth")})
    large = boxes.where((F.col("area") >= LEAST_AREA) & (F.col("depth") > LEAST_PIXELS))
    ranked = settle(large.withColumn("nth", F.row_number().over(Window.partitionBy("plan").orderBy(F.desc("area"), "ord"))), "boxes")
    a, b = ranked.alias("a"), ranked.alias("b")
    limit = F.greatest(F.lit(APART), F.least("a.depth", "b.depth") * APART_PART)
    met = a.join(b, (F.col("a.plan") == F.col("b.plan")) & (F.col("a.nth") < F.col("b.nth")) & (distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) < limit))
    stays = ranked.join(first_kept(ranked, met.select(F.col("a.plan").alias("plan"), F.col("a.ord").alias("early"), F.col("b.ord").alias("late"))), ["plan", "ord"])
    nth = F.row_number().over(Window.partitionBy("plan").orderBy("nth"))
    return stays.withColumn("nth", nth).where(F.col("nth") <= OBJECTS).drop("nth", "area")


@query("object_footprints", (162, 272), """
WITH RECURSIVE f AS (SELECT plan, ord, round(x*30, 6) AS x, round(y*30, 6) AS y, round(greatest(w, d)*30, 6) AS width, round(least(w, d)*30, 6) AS depth, CASE WHEN w = d THEN (rot + 720) % 90 WHEN w > d THEN (rot + 720) % 180 ELSE (rot + 810) % 180 END AS rotation FROM {furniture}),
i AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY width*depth DESC, ord) AS nth FROM f WHERE width*depth >= 90 AND depth > 3),
g AS (SELECT DISTINCT plan, CAST(0 AS BIGINT) AS nth, CAST([] AS STRUCT(x DOUBLE, y DOUBLE, s DOUBLE)[]) AS kept, CAST(NULL AS INTEGER) AS taken FROM i UNION ALL
 SELECT plan, nth, CASE WHEN near THEN kept ELSE list_append(kept, struct_pack(x := x, y := y, s := depth)) END, CASE WHEN near THEN NULL ELSE ord END
 FROM (SELECT i.*, kept, len(list_filter(kept, lambda h: sqrt((h.x-i.x)*(h.x-i.x) + (h.y-i.y)*(h.y-i.y)) < greatest(8, least(h.s, i.depth)*0.5))) > 0 AS near FROM g JOIN i ON i.plan = g.plan AND i.nth = g.nth + 1))
SELECT i.plan, i.ord, x + 0.0 AS x, y + 0.0 AS y, width, depth, rotation + 0.0 AS rotation FROM g JOIN i ON i.plan = g.plan AND i.ord = g.taken""")
def object_footprints(spark, d):
    """The turned boxes of drawn objects, found again from points all over them."""
    f = {c: F.col(c) for c in ("x", "y", "w", "d", "rot")}
    turned = bound(spark, d, "furniture").withColumns({"c": F.cos(F.radians(f["rot"])), "s": F.sin(F.radians(f["rot"]))})
    # Five steps along each side: their parts of x and y are columns, so that a point is only their sum.
    steps = {f"{side}{i}{t}": (i / 4 - 0.5) * f[side] * PPM * F.col(t) for side in "wd" for i in range(5) for t in "cs"}
    stepped = turned.select("plan", "ord", (f["x"] * PPM).alias("x"), (f["y"] * PPM).alias("y"), *[e.alias(n) for n, e in steps.items()])
    points = [F.struct((F.col("x") + F.col(f"w{i}c") - F.col(f"d{j}s")).alias("x"), (F.col("y") + F.col(f"w{i}s") + F.col(f"d{j}c")).alias("y")) for i in range(5) for j in range(5)]
    return footprints(stepped.select("plan", "ord", F.array(*points).alias("points")))
