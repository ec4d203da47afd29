"""Joins of plan elements: by id, nearest, point in polygon, as-of in four directions, unique links.

Every join has the plan in its key, so both sides are dealt by plan and a task holds whole plans only; a distance or
containment test is the residual condition of that equi-join, not a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import geometry as G
from quoin.plans.bindings import bound
from quoin.registry import query

ENDS = ("x1", "y1", "x2", "y2")
#: Reach of an opening and of a piece of furniture, in metres.
REACH = 0.35


def nearest_wall(points: DataFrame, walls: DataFrame, reach: float | None = REACH) -> DataFrame:
    """plan, ord, wall, dist, at: the nearest wall in reach; of equals the first in list order.

    The distance is px - x1 - t * (x2 - x1) in this order: adding up the foot of the perpendicular first would round
    otherwise, and tell walls apart that are equally near.
    """
    w = walls.select("plan", F.col("ord").alias("wall"), *ENDS)
    joined = points.join(w, "plan")
    px, py, x1, y1, x2, y2 = (F.col(c) for c in ("px", "py", *ENDS))
    at, length = G.offset(px, py, x1, y1, x2, y2), G.distance(x1, y1, x2, y2)
    t = F.when(length <= G.POINT_M, 0.0).otherwise(at / length)
    dx, dy = px - x1 - t * (x2 - x1), py - y1 - t * (y2 - y1)
    dist = F.sqrt(dx * dx + dy * dy)
    best = joined.groupBy("plan", "ord").agg(F.min(F.struct(dist.alias("dist"), F.col("wall"), at.alias("at"))).alias("b"))
    out = best.select("plan", "ord", "b.wall", "b.dist", "b.at")
    return out if reach is None else out.where(F.col("dist") <= reach)


@query("opening_wall_lookup", (105, 108, 110), """
SELECT o.plan, o.ord, o.wall_id, w.ord AS wall, w.ord IS NULL AS issue FROM {openings} o LEFT JOIN {walls} w ON w.plan = o.plan AND w.id = o.wall_id""")
def opening_wall_lookup(spark, d):
    o = bound(spark, d, "openings").select("plan", "ord", "wall_id")
    w = bound(spark, d, "walls").select("plan", F.col("id").alias("wall_id"), F.col("ord").alias("wall"))
    return o.join(w, ["plan", "wall_id"], "left").select("plan", "ord", "wall_id", "wall", F.col("wall").isNull().alias("issue"))


@query("nearest_wall", (106, 107, 109, 313), """
WITH p AS (SELECT plan, ord, x AS px, y AS py FROM {labels_px}),
j AS (SELECT p.plan, p.ord, w.ord AS wall, px, py, x1, y1, x2, y2, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM p JOIN {walls} w ON w.plan = p.plan),
f AS (SELECT *, CASE WHEN len <= 1e-6 THEN 0 ELSE least(greatest(((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/len, 0), len) END AS place FROM j),
t AS (SELECT *, CASE WHEN len <= 1e-6 THEN 0 ELSE place/len END AS t FROM f),
q AS (SELECT *, sqrt((px-x1-t*(x2-x1))*(px-x1-t*(x2-x1))+(py-y1-t*(y2-y1))*(py-y1-t*(y2-y1))) AS dist FROM t)
SELECT plan, ord, wall, round(dist, 5) + 0.0 AS dist, round(place, 5) + 0.0 AS place FROM q QUALIFY row_number() OVER (PARTITION BY plan, ord ORDER BY dist, wall) = 1""")
def nearest(spark, d):
    p = bound(spark, d, "labels_px").select("plan", "ord", F.col("x").alias("px"), F.col("y").alias("py"))
    got = nearest_wall(p, bound(spark, d, "walls"), None)
    return got.select("plan", "ord", "wall", (F.round("dist", 5) + 0.0).alias("dist"), (F.round("at", 5) + 0.0).alias("place"))


def _in_room():
    return F.col("x").between(F.col("x0"), F.col("x9")) & F.col("y").between(F.col("y0"), F.col("y9"))


def _rooms(spark, d):
    return bound(spark, d, "rooms").select("plan", F.col("ord").alias("room"), "x0", "y0", F.col("x1").alias("x9"), F.col("y1").alias("y9"))


@query("label_room", (111, 113), """
SELECT r.plan, r.ord AS room, l.name FROM {rooms} r JOIN {labels_px} l ON l.plan = r.plan AND l.x BETWEEN r.x0 AND r.x1 AND l.y BETWEEN r.y0 AND r.y1
QUALIFY row_number() OVER (PARTITION BY r.plan, r.ord ORDER BY (l.x-(r.x0+r.x1)/2)*(l.x-(r.x0+r.x1)/2)+(l.y-(r.y0+r.y1)/2)*(l.y-(r.y0+r.y1)/2), -l.confidence, l.ord) = 1""")
def label_room(spark, d):
    """Each room's name: of the labels on it (boundary counts) the nearest to its middle, then the surest, then the first."""
    mx, my = (F.col("x0") + F.col("x9")) / 2, (F.col("y0") + F.col("y9")) / 2
    near = (F.col("x") - mx) * (F.col("x") - mx) + (F.col("y") - my) * (F.col("y") - my)
    joined = _rooms(spark, d).join(bound(spark, d, "labels_px"), "plan").where(_in_room())
    key = F.struct(near.alias("a"), (-F.col("confidence")).alias("b"), F.col("ord").alias("c"))
    return joined.groupBy("plan", "room").agg(F.min_by("name", key).alias("name"))


@query("missing_label", (112,), """
WITH l AS (SELECT * FROM {labels_px} l WHERE confidence >= 0.6 AND NOT EXISTS (SELECT 1 FROM {rooms} r WHERE r.plan = l.plan AND l.x BETWEEN r.x0 AND r.x1 AND l.y BETWEEN r.y0 AND r.y1))
SELECT plan, lower(name) AS label, CAST(round_even(x*10, 0) AS BIGINT) AS cx, CAST(round_even(y*10, 0) AS BIGINT) AS cy, min(ord) AS ord FROM l GROUP BY ALL""")
def missing_label(spark, d):
    """Sure room labels that no room covers; one for each text and 10 cm cell."""
    l = bound(spark, d, "labels_px").where("confidence >= 0.6").alias("l")
    r = _rooms(spark, d).alias("r")
    left = l.join(r, (F.col("l.plan") == F.col("r.plan")) & _in_room(), "left_anti")
    return left.groupBy("plan", F.lower("name").alias("label"), F.rint(F.col("x") * 10).cast("long").alias("cx"), F.rint(F.col("y") * 10).cast("long").alias("cy")).agg(F.min("ord").alias("ord"))


@query("furniture_room", (114,), """
WITH j AS (SELECT f.plan, f.ord, r.ord AS room, (r.x1-r.x0)*(r.y1-r.y0) AS area,
  greatest(r.x0-f.x, 0, f.x-r.x1) AS dx, greatest(r.y0-f.y, 0, f.y-r.y1) AS dy FROM {furniture} f JOIN {rooms} r ON r.plan = f.plan),
k AS (SELECT *, dx*dx+dy*dy AS d2 FROM j WHERE dx*dx+dy*dy <= 0.1225)
SELECT plan, ord, room FROM k QUALIFY row_number() OVER (PARTITION BY plan, ord ORDER BY d2 > 0, CASE WHEN d2 > 0 THEN d2 ELSE area END, room) = 1""")
def furniture_room(spark, d):
    """The smallest room that contains the piece, else the nearest within reach; pieces without one don't appear."""
    j = bound(spark, d, "furniture").join(_rooms(spark, d), "plan")
    dx = F.greatest(F.col("x0") - F.col("x"), F.lit(0.0), F.col("x") - F.col("x9"))
    dy = F.greatest(F.col("y0") - F.col("y"), F.lit(0.0), F.col("y") - F.col("y9"))
    d2, area = dx * dx + dy * dy, (F.col("x9") - F.col("x0")) * (F.col("y9") - F.col("y0"))
    key = F.struct((d2 > 0).alias("out"), F.when(d2 > 0, d2).otherwise(area).alias("size"), F.col("room").alias("c"))
    return j.where(d2 <= REACH * REACH).groupBy("plan", "ord").agg(F.min_by("room", key).alias("room"))


@query("stair_room_unique", (116,), """
WITH j AS (SELECT f.plan, f.ord, r.ord AS room FROM {furniture} f JOIN {rooms} r ON r.plan = f.plan
  AND f.x - f.w/2 >= r.x0 AND f.x + f.w/2 <= r.x1 AND f.y - f.d/2 >= r.y0 AND f.y + f.d/2 <= r.y1)
SELECT plan, min(room) AS room, ord FROM j GROUP BY plan, ord HAVING count(*) = 1""")
def stair_room_unique(spark, d):
    """The room of a footprint that exactly one room contains; claims of two rooms give none."""
    j = bound(spark, d, "furniture").join(_rooms(spark, d), "plan")
    inside = (F.col("x") - F.col("w") / 2 >= F.col("x0")) & (F.col("x") + F.col("w") / 2 <= F.col("x9")) & (F.col("y") - F.col("d") / 2 >= F.col("y0")) & (F.col("y") + F.col("d") / 2 <= F.col("y9"))
    return j.where(inside).groupBy("plan", "ord").agg(F.count(F.lit(1)).alias("n"), F.min("room").alias("room")).where("n = 1").drop("n")


@query("four_boundaries", (325,), """
WITH h AS (SELECT * FROM {walls} WHERE abs(x2-x1) >= abs(y2-y1)), v AS (SELECT * FROM {walls} WHERE abs(x2-x1) < abs(y2-y1)),
a AS (SELECT l.plan, l.ord, max(CASE WHEN (x1+x2)/2 < x THEN (x1+x2)/2 END) AS lft, min(CASE WHEN (x1+x2)/2 > x THEN (x1+x2)/2 END) AS rgt
 FROM {labels_px} l JOIN v ON v.plan = l.plan AND l.y BETWEEN least(y1,y2) AND greatest(y1,y2) GROUP BY ALL),
b AS (SELECT l.plan, l.ord, max(CASE WHEN (y1+y2)/2 < y THEN (y1+y2)/2 END) AS lo, min(CASE WHEN (y1+y2)/2 > y THEN (y1+y2)/2 END) AS hi
 FROM {labels_px} l JOIN h ON h.plan = l.plan AND l.x BETWEEN least(x1,x2) AND greatest(x1,x2) GROUP BY ALL)
SELECT l.plan, l.ord, lft, rgt, lo, hi, rgt - lft AS width, hi - lo AS depth FROM {labels_px} l LEFT JOIN a USING (plan, ord) LEFT JOIN b USING (plan, ord)""")
def four_boundaries(spark, d):
    """The nearest walls left, right, below and above of a label: one conditional aggregate instead of four as-of joins."""
    l = bound(spark, d, "labels_px").select("plan", "ord", "x", "y")
    w = bound(spark, d, "walls").select("plan", *ENDS)
    x1, y1, x2, y2, x, y = (F.col(c) for c in (*ENDS, "x", "y"))
    flat = F.abs(x2 - x1) >= F.abs(y2 - y1)
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    up = ~flat & y.between(F.least(y1, y2), F.greatest(y1, y2))
    across = flat & x.between(F.least(x1, x2), F.greatest(x1, x2))
    got = l.join(w, "plan").groupBy("plan", "ord").agg(
        F.max(F.when(up & (mx < x), mx)).alias("lft"), F.min(F.when(up & (mx > x), mx)).alias("rgt"),
        F.max(F.when(across & (my < y), my)).alias("lo"), F.min(F.when(across & (my > y), my)).alias("hi"),
    )
    return l.join(got, ["plan", "ord"], "left").select("plan", "ord", "lft", "rgt", "lo", "hi", (F.col("rgt") - F.col("lft")).alias("width"), (F.col("hi") - F.col("lo")).alias("depth"))


@query("unique_footprint_link", (124, 126), """
WITH k AS (SELECT plan, ord, CASE category WHEN 'Double Bed' THEN 'bed' WHEN 'couch' THEN 'sofa' WHEN 'bedside-table' THEN 'table' WHEN 'Carpet' THEN 'rug'
  WHEN 'arm chair' THEN 'chair' ELSE category END AS family, x, y, w, d, rot - 360*floor(rot/360) AS rot, ord % 2 AS side FROM {furniture}),
f AS (SELECT plan, family, x, y, w, d, rot, min(ord) AS item FROM k WHERE side = 0 GROUP BY ALL HAVING count(*) = 1)
SELECT k.plan, k.ord, f.item FROM k LEFT JOIN f USING (plan, family, x, y, w, d, rot) WHERE side = 1""")
def unique_footprint_link(spark, d):
    """Assets (odd places) linked to the one piece of furniture (even places) with the same footprint key."""
    from quoin.functions.text import furniture_alias

    key = ["plan", "family", "x", "y", "w", "d", "rot"]
    k = bound(spark, d, "furniture").select("plan", "ord", furniture_alias(F.col("category")).alias("family"), *[(F.rint(F.col(c) * 100000) / 100000).alias(c) for c in "xywd"], F.pmod("rot", F.lit(360.0)).alias("rot"))
    items = k.where("ord % 2 = 0").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("item")).where("n = 1").drop("n")
    return k.where("ord % 2 = 1").join(items, key, "left").select("plan", "ord", "item")


@query("room_material", (127, 128, 213), """
WITH a AS (SELECT l_orderkey AS plan, ord, concat('r', CAST(l_partkey % 4 AS VARCHAR)) AS target, concat('preset', CAST(l_suppkey % 5 AS VARCHAR)) AS preset FROM {lines}),
l AS (SELECT plan, target, arg_max(preset, ord) AS preset FROM a GROUP BY ALL)
SELECT r.plan, r.ord, coalesce(l.preset, m.preset, 'fallback') AS preset FROM {rooms} r LEFT JOIN l ON l.plan = r.plan AND l.target = r.id
LEFT JOIN l m ON m.plan = r.plan AND m.target = concat('r', CAST((r.ord + 1) % 4 AS VARCHAR))""")
def room_material(spark, d):
    """By id, then by a second name, then the safe preset; the last assignment to a target wins."""
    a = bound(spark, d, "lines").select(F.col("l_orderkey").alias("plan"), "ord", F.concat(F.lit("r"), (F.col("l_partkey") % 4).cast("string")).alias("target"), F.concat(F.lit("preset"), (F.col("l_suppkey") % 5).cast("string")).alias("preset"))
    last = a.groupBy("plan", "target").agg(F.max_by("preset", "ord").alias("preset"))
    r = bound(spark, d, "rooms").select("plan", "ord", F.col("id").alias("target"), F.concat(F.lit("r"), ((F.col("ord") + 1) % 4).cast("string")).alias("other"))
    second = last.select("plan", F.col("target").alias("other"), F.col("preset").alias("preset2"))
    return r.join(last, ["plan", "target"], "left").join(second, ["plan", "other"], "left").select("plan", "ord", F.coalesce("preset", "preset2", F.lit("fallback")).alias("preset"))


@query("gap_covered", (121,), """
WITH g AS (SELECT plan, ord, id, s, e, lead(s) OVER (PARTITION BY plan, wall_id ORDER BY s, e, id) AS nxt, wall_id FROM {openings})
SELECT g.plan, g.ord, g.e AS gap_start, g.nxt AS gap_end, EXISTS (SELECT 1 FROM {openings} o WHERE o.plan = g.plan AND o.wall_id <> g.wall_id
 AND o.s <= g.e + 0.1 AND o.e >= g.nxt - 0.1) AS covered FROM g WHERE g.nxt - g.e > 1e-6""")
def gap_covered(spark, d):
    """Gaps between neighbours on a wall, and whether an opening of another wall spans them."""
    o = bound(spark, d, "openings")
    g = o.select("plan", "ord", "wall_id", F.col("e").alias("gap_start"), F.lead("s").over(Window.partitionBy("plan", "wall_id").orderBy("s", "e", "id")).alias("gap_end")).where(F.col("gap_end") - F.col("gap_start") > 1e-6)
    spans = o.select("plan", F.col("wall_id").alias("other"), "s", "e")
    hit = g.join(spans, "plan").where((F.col("other") != F.col("wall_id")) & (F.col("s") <= F.col("gap_start") + 0.1) & (F.col("e") >= F.col("gap_end") - 0.1))
    hit = hit.select("plan", "ord").distinct().withColumn("covered", F.lit(True))
    return g.join(hit, ["plan", "ord"], "left").select("plan", "ord", "gap_start", "gap_end", F.coalesce("covered", F.lit(False)).alias("covered"))


_RUN = """
WITH m AS (SELECT doc_id, source AS split, sha256(text) AS sha FROM documents),
r AS (SELECT l.doc_id, CASE WHEN l.quality = 0 THEN 'other' ELSE m.sha END AS sha, CASE WHEN l.toxic = 1 THEN 'failed' ELSE 'finished' END AS outcome FROM (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l LEFT JOIN m USING (doc_id))
"""


def _manifest(spark, d):
    return bound(spark, d, "documents").select("doc_id", F.col("source").alias("split"), F.sha2("text", 256).alias("sha"))


def _results(spark, d):
    """A run's results: the labelled samples, some with the checksum of another file, some failed."""
    r = bound(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).join(_manifest(spark, d).drop("split"), "doc_id", "left")
    return r.select("doc_id", F.when(F.col("quality") == 0, "other").otherwise(F.col("sha")).alias("found"), F.when(F.col("toxic") == 1, "failed").otherwise("finished").alias("outcome"))


@query("baseline_manifest", (131,), _RUN + """
SELECT doc_id, split, CASE WHEN r.sha IS NULL AND outcome IS NULL THEN 'missing' WHEN m.sha IS NULL THEN 'unexpected' WHEN r.sha <> m.sha THEN 'hash_mismatch' ELSE outcome END AS status FROM m FULL JOIN r USING (doc_id)""")
def baseline_manifest(spark, d):
    """Results against a manifest by id: either side may lack an id, and other hashes become rows, not errors."""
    j = _manifest(spark, d).join(_results(spark, d), "doc_id", "full")
    status = F.when(F.col("outcome").isNull(), "missing").when(F.col("sha").isNull(), "unexpected").when(F.col("found") != F.col("sha"), "hash_mismatch").otherwise(F.col("outcome"))
    return j.select("doc_id", "split", status.alias("status"))


@query("manifest_checks", (7,), """
SELECT split, count(*) AS n, count(*) = count(DISTINCT doc_id) AS unique_ids, count(*) FILTER (doc_id IS NULL) = 0 AS named, split IN ('src0', 'src1', 'src2') AS allowed
FROM (SELECT doc_id, source AS split FROM documents) GROUP BY split""")
def manifest_checks(spark, d):
    """Of each split of a manifest: samples, whether all have ids and no two the same, and whether the split may be run."""
    m = bound(spark, d, "documents").groupBy(F.col("source").alias("split"))
    n = F.count(F.lit(1))
    return m.agg(n.alias("n"), (n == F.count_distinct("doc_id")).alias("unique_ids"), (F.count_if(F.col("doc_id").isNull()) == 0).alias("named")).withColumn("allowed", F.col("split").isin("src0", "src1", "src2"))


@query("resumed_run", (287,), _RUN + """
SELECT doc_id, split FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = m.doc_id) AND (SELECT count(*) FROM r LEFT JOIN m k USING (doc_id) WHERE k.doc_id IS NULL) = 0""")
def resumed_run(spark, d):
    """What a resumed run still has to do: the samples without a result, finished or failed, in the same experiment.

    Results of samples that the manifest lacks belong to another experiment: then nothing is resumed.
    """
    m, r = _manifest(spark, d), _results(spark, d).select("doc_id")
    strange = r.join(m, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("strange"))  # one row
    return m.join(r, "doc_id", "left_anti").join(F.broadcast(strange)).where("strange = 0").select("doc_id", "split")


@query("wall_crossings", (231,), """
WITH p AS (SELECT a.plan, a.ord AS a, b.ord AS b, a.x1 ax, a.y1 ay, a.x2 bx, a.y2 by_, b.x1 cx, b.y1 cy, b.x2 dx, b.y2 dy FROM {walls} a JOIN {walls} b ON a.plan = b.plan AND a.ord < b.ord)
SELECT plan, a, b FROM p WHERE ((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax))*((bx-ax)*(dy-ay)-(by_-ay)*(dx-ax)) < 0
 AND ((dx-cx)*(ay-cy)-(dy-cy)*(ax-cx))*((dx-cx)*(by_-cy)-(dy-cy)*(bx-cx)) < 0""")
def wall_crossings(spark, d):
    a = bound(spark, d, "walls").select("plan", F.col("ord").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ENDS])
    b = bound(spark, d, "walls").select("plan", F.col("ord").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ENDS])
    ends = [F.col(f"a_{c}") for c in ENDS] + [F.col(f"b_{c}") for c in ENDS]
    return a.join(b, "plan").where((F.col("a") < F.col("b")) & G.crosses(*ends)).select("plan", "a", "b")
