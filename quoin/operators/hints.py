"""Detector rows to plan rows: hints, stairs, regions, opening decisions, resolved furniture, reports and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import geometry as G
from quoin.functions import text as T
from quoin.plans.bindings import bound
from quoin.registry import query


@query("hint_geometry", (78, 92, 302, 303, 317), """
SELECT plan, ord, x1/10*12.5 AS x, (1 - y1/10)*8 AS y, thickness*16 AS size, confidence FROM {walls} WHERE confidence >= 0.35 AND thickness*16 BETWEEN 0.2 AND 5""")
def hint_geometry(spark, d):
    """Normalised hints to metres with the y axis turned up; unsure ones and those outside .2 to 5 m go."""
    size = F.col("thickness") * 16
    w = bound(spark, d, "walls").where((F.col("confidence") >= 0.35) & size.between(0.2, 5))
    return w.select("plan", "ord", (F.col("x1") / 10 * 12.5).alias("x"), ((1 - F.col("y1") / 10) * 8).alias("y"), size.alias("size"), "confidence")


@query("stair_like", (81, 96, 234), """
WITH r AS (SELECT plan, ord, x0, y0, x1-x0 AS w, y1-y0 AS h, 2 + ord*3 % 31 AS lines FROM {rooms})
SELECT plan, ord, x0 + w/2 AS cx, y0 + h/2 AS cy, w, h, least(1, 0.72e0 + 0.02e0*lines) AS confidence FROM r
WHERE lines BETWEEN 4 AND 30 AND w/h BETWEEN 0.35 AND 2.8 AND greatest(w, h)/lines BETWEEN 0.045 AND 0.35""")
def stair_like(spark, d):
    """Striped regions with the lines, shape and pitch of stairs, as staircase rows."""
    w, h, n = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), (2 + F.col("ord") * 3 % 31)
    r = bound(spark, d, "rooms").where(n.between(4, 30) & (w / h).between(0.35, 2.8) & (F.greatest(w, h) / n).between(0.045, 0.35))
    return r.select("plan", "ord", (F.col("x0") + w / 2).alias("cx"), (F.col("y0") + h / 2).alias("cy"), w.alias("w"), h.alias("h"), F.least(F.lit(1.0), F.lit(0.72) + F.lit(0.02) * n).alias("confidence"))


@query("opening_decision", (266, 330), """
WITH c AS (SELECT plan, ord, CAST((ord*7 + plan) % 20 AS DOUBLE)/20 AS arc, CAST((ord*3 + plan) % 10 AS DOUBLE)/10 AS leaf, confidence AS t1, 1 - confidence AS t2, thickness*4 AS t3, external FROM {walls}),
b AS (SELECT *, greatest(t1, t2, t3) AS best, CAST(t1 >= 0.45 AS INTEGER) + CAST(t2 >= 0.45 AS INTEGER) + CAST(t3 >= 0.45 AS INTEGER) AS n FROM c)
SELECT plan, ord, CASE WHEN arc >= 0.30 AND (arc >= 0.42 OR leaf >= 0.50) THEN 'door' WHEN n >= 2 THEN 'window' WHEN external AND best >= 0.80 THEN 'window' ELSE 'ambiguous' END AS kind,
 round(CASE WHEN arc >= 0.30 AND (arc >= 0.42 OR leaf >= 0.50) THEN least(0.95, 0.5 + 0.4*arc + CASE WHEN leaf >= 0.5 THEN 0.1*leaf ELSE 0 END)
 WHEN n >= 2 THEN least(0.9, 0.45 + 0.4*(t1+t2+t3-least(t1,t2,t3))/2) WHEN external AND best >= 0.80 THEN least(0.82, 0.48 + 0.28*best) ELSE 0.35 END, 6) AS confidence FROM b""")
def opening_decision(spark, d):
    """Door, window or ambiguous from the share of a swing arc, of its leaf, and of three parallel tracks."""
    w = bound(spark, d, "walls")
    arc = ((F.col("ord") * 7 + F.col("plan")) % 20).cast("double") / 20
    leaf = ((F.col("ord") * 3 + F.col("plan")) % 10).cast("double") / 10
    c = w.select("plan", "ord", "external", arc.alias("arc"), leaf.alias("leaf"), F.col("confidence").alias("t1"), (1 - F.col("confidence")).alias("t2"), (F.col("thickness") * 4).alias("t3"))
    arc, leaf, tracks = F.col("arc"), F.col("leaf"), [F.col(t) for t in ("t1", "t2", "t3")]
    best, n = F.greatest(*tracks), sum(((t >= 0.45).cast("int") for t in tracks), F.lit(0))
    door = (arc >= 0.30) & ((arc >= 0.42) | (leaf >= 0.50))
    two = (sum(tracks, F.lit(0.0)) - F.least(*tracks)) / 2
    lone = F.col("external") & (best >= 0.80)
    sure = (
        F.when(door, F.least(F.lit(0.95), 0.5 + 0.4 * arc + F.when(leaf >= 0.5, 0.1 * leaf).otherwise(0.0)))
        .when(n >= 2, F.least(F.lit(0.9), 0.45 + 0.4 * two))
        .when(lone, F.least(F.lit(0.82), 0.48 + 0.28 * best))
        .otherwise(0.35)
    )
    return c.select("plan", "ord", F.when(door, "door").when((n >= 2) | lone, "window").otherwise("ambiguous").alias("kind"), F.round(sure, 6).alias("confidence"))


@query("furniture_resolved", (125, 297), """
WITH k AS (SELECT plan, ord, CASE category WHEN 'Double Bed' THEN 'bed' WHEN 'couch' THEN 'sofa' WHEN 'bedside-table' THEN 'table' WHEN 'Carpet' THEN 'rug' WHEN 'arm chair' THEN 'chair' ELSE category END AS family, x, y FROM {furniture}),
b AS (SELECT * FROM k WHERE ord % 2 = 0), a AS (SELECT * FROM k WHERE ord % 2 = 1)
SELECT plan, ord, 'base' AS origin FROM b UNION ALL SELECT plan, ord, 'asset' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.plan = a.plan AND b.family = a.family AND b.x = a.x AND b.y = a.y)""")
def furniture_resolved(spark, d):
    """The arrangement (even places) and the assets (odd places) that it doesn't hold yet, by footprint key."""
    key = ["plan", "family", "x", "y"]
    k = bound(spark, d, "furniture").select("plan", "ord", T.furniture_alias(F.col("category")).alias("family"), "x", "y")
    base, assets = k.where("ord % 2 = 0"), k.where("ord % 2 = 1")
    more = assets.join(base.select(*key).distinct(), key, "left_anti")
    return base.select("plan", "ord", F.lit("base").alias("origin")).unionByName(more.select("plan", "ord", F.lit("asset").alias("origin")))


@query("leg_collision", (242, 236, 334), """
WITH l AS (SELECT plan, ord, x AS px, y AS py FROM {labels_px}),
j AS (SELECT l.plan, l.ord, (0 - l.px)*(w.y1 - l.py) - (0 - l.py)*(w.x1 - l.px) AS a, (0 - l.px)*(w.y2 - l.py) - (0 - l.py)*(w.x2 - l.px) AS b,
 (w.x2-w.x1)*(l.py-w.y1) - (w.y2-w.y1)*(l.px-w.x1) AS c, (w.x2-w.x1)*(0-w.y1) - (w.y2-w.y1)*(0-w.x1) AS e FROM l JOIN {walls} w ON w.plan = l.plan)
SELECT plan, ord, bool_or(a*b < 0 AND c*e < 0) AS hit FROM j GROUP BY ALL""")
def leg_collision(spark, d):
    """Whether the way from each point to the origin crosses any wall of its plan."""
    l = bound(spark, d, "labels_px").select("plan", "ord", F.col("x").alias("px"), F.col("y").alias("py"))
    w = bound(spark, d, "walls").drop("ord")
    z = F.lit(0.0)
    hit = G.crosses(F.col("px"), F.col("py"), z, z, *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return l.join(w, "plan").groupBy("plan", "ord").agg(F.bool_or(hit).alias("hit"))


@query("void_ids", (202, 167), """
WITH v AS (SELECT l_orderkey AS plan, concat('r', CAST(l_partkey % 4 AS VARCHAR)) AS id, ord + CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1000 END AS k FROM {lines}),
f AS (SELECT plan, id, min(k) AS k FROM v GROUP BY ALL)
SELECT plan, string_agg(id, ',' ORDER BY k) AS ids, sha256(string_agg(id, ',' ORDER BY id)) AS signature FROM f GROUP BY plan""")
def void_ids(spark, d):
    """Distinct ids, given ones before inferred ones, each at its first place; and a signature that order doesn't change."""
    v = bound(spark, d, "lines").select(F.col("l_orderkey").alias("plan"), F.concat(F.lit("r"), (F.col("l_partkey") % 4).cast("string")).alias("id"), (F.col("ord") + F.when(F.col("l_linestatus") == "O", 0).otherwise(1000)).alias("k"))
    f = v.groupBy("plan", "id").agg(F.min("k").alias("k"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"])
    return f.groupBy("plan").agg(F.array_join(ids, ",").alias("ids"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ","), 256).alias("signature"))


@query("error_messages", (103, 225, 227), """
WITH e AS (SELECT event_id, event_type, event_id % 7 AS k FROM events)
SELECT event_id, k IN (1, 2, 4) AS transient, CASE WHEN k = 3 THEN 'bad plan' ELSE concat('worker exited with ', CAST(k AS VARCHAR)) END AS message, k <> 5 AS id_ok FROM e""")
def error_messages(spark, d):
    """Whether an error may pass by itself (status or marker), a worker's message or its exit code, and sound job ids."""
    k = F.col("event_id") % 7
    status = F.when(k == 1, 429).when(k == 2, 503).when(k == 3, 400).otherwise(0)
    text = F.when(k == 4, "Deadline exceeded: TIMEOUT").when(k == 3, '{"error": "bad plan"}').otherwise("")
    # Statuses and markers of errors that may pass.
    passing = status.isin(408, 429, 500, 502, 503, 504) | F.lower(text).rlike("timeout|timed out|unavailable|connection reset")
    message = F.coalesce(F.get_json_object(F.when(text.startswith("{"), text), "$.error"), F.concat(F.lit("worker exited with "), k.cast("string")))
    job = F.when(k == 5, "../etc").otherwise(F.sha2(F.col("event_type"), 256))
    return bound(spark, d, "events").select("event_id", passing.alias("transient"), message.alias("message"), job.rlike("^[0-9a-f]{64}$").alias("id_ok"))


@query("validation_report", (23, 309), """
SELECT plan, count(*) AS openings, count(DISTINCT wall_id) AS walls, CASE WHEN count(*) > 4 THEN 'blocked' WHEN count(DISTINCT wall_id) < 2 THEN 'review' ELSE 'ready' END AS gate FROM {openings} GROUP BY plan""")
def validation_report(spark, d):
    """A plan's counts and the first of its gates that holds it back."""
    o = bound(spark, d, "openings").groupBy("plan").agg(F.count(F.lit(1)).alias("openings"), F.count_distinct("wall_id").alias("walls"))
    return o.withColumn("gate", F.when(F.col("openings") > 4, "blocked").when(F.col("walls") < 2, "review").otherwise("ready"))


@query("sides_to_rectangle", (), """
WITH f AS (SELECT w.plan, w.ord, x1 - 5 AS ax, y1 - 5 AS ay, x2 - 5 AS bx, y2 - 5 AS by_ FROM {walls} w),
p AS (SELECT *, CASE WHEN bx = ax THEN CASE WHEN abs(ax) <= 1 THEN 0 ELSE 2 END ELSE least((-1-ax)/(bx-ax), (1-ax)/(bx-ax)) END AS tx0, CASE WHEN bx = ax THEN CASE WHEN abs(ax) <= 1 THEN 1 ELSE -1 END ELSE greatest((-1-ax)/(bx-ax), (1-ax)/(bx-ax)) END AS tx1,
 CASE WHEN by_ = ay THEN CASE WHEN abs(ay) <= 2 THEN 0 ELSE 2 END ELSE least((-2-ay)/(by_-ay), (2-ay)/(by_-ay)) END AS ty0, CASE WHEN by_ = ay THEN CASE WHEN abs(ay) <= 2 THEN 1 ELSE -1 END ELSE greatest((-2-ay)/(by_-ay), (2-ay)/(by_-ay)) END AS ty1 FROM f)
SELECT plan, ord, greatest(tx0, ty0, 0) <= least(tx1, ty1, 1) AS meets FROM p""")
def sides_to_rectangle(spark, d):
    """Whether each wall meets the footprint of 2 x 4 m about (5, 5): its segment clipped to two slabs."""
    ax, ay, bx, by = F.col("x1") - 5, F.col("y1") - 5, F.col("x2") - 5, F.col("y2") - 5

    def slab(a, b, half):
        low, high = F.try_divide(-half - a, b - a), F.try_divide(half - a, b - a)
        level, inside = b == a, F.abs(a) <= half
        return F.when(level, F.when(inside, 0.0).otherwise(2.0)).otherwise(F.least(low, high)), F.when(level, F.when(inside, 1.0).otherwise(-1.0)).otherwise(F.greatest(low, high))

    (x0, x1), (y0, y1) = slab(ax, bx, F.lit(1.0)), slab(ay, by, F.lit(2.0))
    return bound(spark, d, "walls").select("plan", "ord", (F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0))).alias("meets"))
