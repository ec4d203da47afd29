"""Balconies named by labels that lie on striped regions of a drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.operators.swings import dealt_in_order
from quoin.plans.bindings import bound
from quoin.registry import query

# Lines, shape and pitch of stairs; least side in metres; confidence of a striped region and of each of its first lines.
STAIR_LINES, STAIR_SHAPE, STAIR_PITCH = (4, 30), (0.35, 2.8), (0.045, 0.35)
LEAST_SIDE, STRIPED, PER_LINE, COUNTED_LINES = 0.3, 0.78, 0.015, 12


def on_stripes(regions: DataFrame, labels: DataFrame, ppm: float, image_height: float) -> DataFrame:
    """plan, id, region, label, name, x0, y0, x1, y1 (metres, y up), confidence.

    regions: plan, region, x, y, w, h (pixels), lines, spacing, level (whether its lines are); labels: plan, label, x, y
    (the middle, in pixels), name, confidence.  Regions that could be stairs name no balcony.  The others, in order, each
    take the first label on them, sides included, that no earlier one took.  A region that is too small in metres keeps
    its label from the others and becomes nothing.  Nulls in sizes or places lie nowhere; empty tables give no rows.
    """
    run = F.when(F.col("level"), F.col("w")).otherwise(F.col("h"))
    onward = F.when(F.col("level"), F.col("h")).otherwise(F.col("w"))
    stairs = F.col("lines").between(*STAIR_LINES) & (onward / run).between(*STAIR_SHAPE) & (F.col("spacing") / run).between(*STAIR_PITCH)
    striped = regions.where((F.col("w") > 1) & (F.col("h") > 1)).where(~stairs)
    r, p = striped.alias("r"), labels.alias("p")
    inside = F.col("p.x").between(F.col("r.x"), F.col("r.x") + F.col("w")) & F.col("p.y").between(F.col("r.y"), F.col("r.y") + F.col("h"))
    met = r.join(p, (F.col("r.plan") == F.col("p.plan")) & inside)
    taken = dealt_in_order(met.select("r.plan", F.col("region").alias("taker"), F.col("label").alias("given"), F.lit(0).alias("value")))
    named = taken.select("plan", F.col("taker").alias("region"), F.col("given").alias("label")).join(striped, ["plan", "region"]).join(labels.select("plan", "label", "name", F.col("confidence").alias("read")), ["plan", "label"])
    metres = lambda c: F.greatest(F.lit(0.0), c) / ppm
    placed = named.withColumns({
        "x0": metres(F.col("x")), "x1": metres(F.col("x") + F.col("w")),
        "y0": metres(image_height - (F.col("y") + F.col("h"))), "y1": metres(image_height - F.col("y")),
        "confidence": F.least("read", STRIPED + F.least("lines", F.lit(COUNTED_LINES)) * PER_LINE),
    })
    large = placed.where((F.col("x1") - F.col("x0") >= LEAST_SIDE) & (F.col("y1") - F.col("y0") >= LEAST_SIDE))
    nth = F.row_number().over(Window.partitionBy("plan").orderBy("region")) - 1
    return large.select("plan", F.concat(F.lit("balcony_"), F.lpad(nth.cast("string"), 3, "0")).alias("id"), "region", "label", "name", "x0", "y0", "x1", "y1", "confidence")


@query("balconies_on_stripes", (122,), """
WITH RECURSIVE r AS (SELECT plan, ord, x0*64 - 64 AS x, y0*64 - 64 AS y, (x1-x0)*64 AS w, (y1-y0)*64 AS h, 2 + ord*3 % 31 AS lines, ord % 2 = 0 AS level FROM {rooms}),
s AS (SELECT *, CASE WHEN level THEN w ELSE h END AS run, CASE WHEN level THEN h ELSE w END AS onward FROM r),
k AS (SELECT * FROM s WHERE NOT (lines BETWEEN 4 AND 30 AND onward/run BETWEEN 0.35 AND 2.8 AND onward/lines/run BETWEEN 0.045 AND 0.35)),
o AS (SELECT k.plan, k.ord, list(l.ord ORDER BY l.ord) AS likes, row_number() OVER (PARTITION BY k.plan ORDER BY k.ord) AS n FROM k JOIN {labels_px} l ON l.plan = k.plan AND l.x*64 BETWEEN k.x AND k.x + w AND l.y*64 BETWEEN k.y AND k.y + h GROUP BY k.plan, k.ord),
d AS (SELECT DISTINCT plan, CAST(0 AS BIGINT) AS n, CAST(NULL AS INTEGER) AS region, CAST([] AS INTEGER[]) AS used, CAST(NULL AS INTEGER) AS got FROM o UNION ALL
 SELECT plan, n, ord, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, best FROM (SELECT o.plan, o.n, o.ord, used, list_filter(likes, lambda l: NOT list_contains(used, l))[1] AS best FROM d JOIN o ON o.plan = d.plan AND o.n = d.n + 1)),
m AS (SELECT d.plan, d.region, d.got AS label, l.name, greatest(0, k.x)/64 AS x0, greatest(0, 800 - k.y - h)/64 AS y0, greatest(0, k.x + w)/64 AS x1, greatest(0, 800 - k.y)/64 AS y1, round(least(l.confidence, 0.78e0 + least(lines, 12)*0.015e0), 6) AS confidence
 FROM d JOIN k ON k.plan = d.plan AND k.ord = d.region JOIN {labels_px} l ON l.plan = d.plan AND l.ord = d.got)
SELECT plan, concat('balcony_', lpad(CAST(row_number() OVER (PARTITION BY plan ORDER BY region) - 1 AS VARCHAR), 3, '0')) AS id, region, label, name, x0, y0, x1, y1, confidence FROM m WHERE x1 - x0 >= 0.3 AND y1 - y0 >= 0.3""")
def balconies_on_stripes(spark, d):
    """Rooms as striped regions of a drawing of 64 pixels a metre, and the labels that make balconies of them."""
    w, h, lines, level = (F.col("x1") - F.col("x0")) * 64, (F.col("y1") - F.col("y0")) * 64, 2 + F.col("ord") * 3 % 31, F.col("ord") % 2 == 0
    regions = bound(spark, d, "rooms").select("plan", F.col("ord").alias("region"), (F.col("x0") * 64 - 64).alias("x"), (F.col("y0") * 64 - 64).alias("y"), w.alias("w"), h.alias("h"), lines.alias("lines"), (F.when(level, h).otherwise(w) / lines).alias("spacing"), level.alias("level"))
    labels = bound(spark, d, "labels_px").select("plan", F.col("ord").alias("label"), (F.col("x") * 64).alias("x"), (F.col("y") * 64).alias("y"), "name", "confidence")
    return on_stripes(regions, labels, 64.0, 800.0).withColumn("confidence", F.round("confidence", 6))
