"""Queries over frames, budgets, samples along walls and lights in rooms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import frames as R
from quoin.plans.bindings import bound
from quoin.registry import query


@query("crop_and_pad", (104, 260), """
WITH c AS (SELECT plan, ord, CAST(floor(x0*20 - 3) AS INTEGER) AS x, CAST(floor(y0*20 - 3) AS INTEGER) AS y, CAST(floor((x1-x0)*20) AS INTEGER) AS w, CAST(floor((y1-y0)*20) AS INTEGER) AS h FROM {rooms})
SELECT plan, ord, x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x+w <= 200 AND y+h <= 200 AS ok, greatest(x-8, 0) AS px, greatest(y-8, 0) AS py,
 least(x+w+8, 200) - greatest(x-8, 0) AS pw, least(y+h+8, 200) - greatest(y-8, 0) AS ph FROM c""")
def crop_and_pad(spark, d):
    i = lambda c: F.floor(c).cast("int")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    r = bound(spark, d, "rooms").select("plan", "ord", i(x0 * 20 - 3).alias("x"), i(y0 * 20 - 3).alias("y"), i((x1 - x0) * 20).alias("w"), i((y1 - y0) * 20).alias("h"))
    a = [F.col(c) for c in "xywh"]
    p = R.padded(*a, F.lit(8), F.lit(200), F.lit(200))
    return r.select("plan", "ord", R.crop_ok(*a, F.lit(200), F.lit(200)).alias("ok"), p["x"].alias("px"), p["y"].alias("py"), p["w"].alias("pw"), p["h"].alias("ph"))


@query("turned_canvas", (65, 66, 67), """
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 300 ELSE 400 END AS w, CASE WHEN p_partkey % 2 = 1 THEN 400 ELSE 300 END AS h, radians(p_size - 25) AS a FROM part)
SELECT p_partkey, CAST(ceil(w*abs(cos(a)) + h*abs(sin(a)) - 1e-9) AS BIGINT) AS width, CAST(ceil(w*abs(sin(a)) + h*abs(cos(a)) - 1e-9) AS BIGINT) AS height FROM t""")
def turned_canvas(spark, d):
    s = R.turned_size(F.lit(400), F.lit(300), F.col("p_partkey"), F.col("p_size") - 25)
    return bound(spark, d, "part").select("p_partkey", s["width"].alias("width"), s["height"].alias("height"))


MATRIX = [[1.0, 0.25, 3.0], [-0.5, 2.0, 1.0], [0.0625, -0.125, 1.0]]


@query("projective_points", (73, 74, 75, 346), """
WITH p AS (SELECT *, 0.0625*x1 - 0.125*y1 + 1 AS d, 0.0625*x2 - 0.125*y2 + 1 AS d2 FROM {walls})
SELECT plan, ord, CASE WHEN d <> 0 THEN round((x1 + 0.25*y1 + 3)/d, 6) + 0.0 END AS x, CASE WHEN d <> 0 THEN round((-0.5*x1 + 2*y1 + 1)/d, 6) + 0.0 END AS y,
 (d > 0 AND d2 > 0) OR (d < 0 AND d2 < 0) AS one_sign FROM p""")
def projective_points(spark, d):
    p = R.projected(F.col("x1"), F.col("y1"), MATRIX)
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    return bound(spark, d, "walls").select("plan", "ord", (F.round(p["x"], 6) + 0.0).alias("x"), (F.round(p["y"], 6) + 0.0).alias("y"), R.one_sign(ends, MATRIX).alias("one_sign"))


@query("corner_guard", (70, 345), """
WITH q AS (SELECT plan, ord, x1/10 + 9 AS x, 8 + y1/10 AS y FROM {walls})
SELECT plan, ord, 10*y > 0 AND (x - 10)*(8 - y) - y*(0 - x) > 0 AND 8*x > 0 AND 80 > 0 AS convex FROM q""")
def corner_guard(spark, d):
    """Whether the quadrilateral (0, 0), (10, 0), (9 + x/10, 8 + y/10), (0, 8) turns one way at each corner."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    z, ten, eight = F.lit(0.0), F.lit(10.0), F.lit(8.0)
    ring = F.array(point(z, z), point(ten, z), point(F.col("x1") / 10 + 9, 8 + F.col("y1") / 10), point(z, eight))
    return bound(spark, d, "walls").select("plan", "ord", R.convex(ring).alias("convex"))


@query("analysis_budget", (80,), """
SELECT p_partkey, CASE WHEN floor((CAST(p_size AS DOUBLE)*3 - 15 - 3)/3) < 5 THEN NULL ELSE CAST(floor((CAST(p_size AS DOUBLE)*3 - 15 - 3)/3) AS BIGINT) END AS seconds FROM part""")
def analysis_budget(spark, d):
    """Seconds for each of three attempts with pauses of 1 and 2 s, of a limit less 15 s; under 5 s the call is skipped."""
    each = F.floor((F.col("p_size").cast("double") * 3 - 15 - 3) / 3)
    return bound(spark, d, "part").select("p_partkey", F.when(each >= 5, each).alias("seconds"))


@query("layout_summary", (79,), """
SELECT plan, ord, round_even((x0+x1)/2/16*1000, 0)/1000 AS cx, round_even((1 - (y0+y1)/2/16)*1000, 0)/1000 AS cy FROM {rooms}""")
def layout_summary(spark, d):
    """Normalised centres with the y axis turned down, to three places, ties to even."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return bound(spark, d, "rooms").select("plan", "ord", (F.rint(cx / 16 * 1000) / 1000).alias("cx"), (F.rint((1 - cy / 16) * 1000) / 1000).alias("cy"))


@query("walls_in_text", (89, 91, 93, 326, 327), """
WITH s AS (SELECT w.plan, w.ord, i, x1 + (x2-x1)*i/30 AS x, y1 + (y2-y1)*i/30 AS y FROM {walls} w, range(0, 31) t(i) WHERE NOT external),
h AS (SELECT DISTINCT s.plan, s.ord, s.i FROM s JOIN {rooms} r ON r.plan = s.plan AND s.x BETWEEN r.x0 AND r.x1 AND s.y BETWEEN r.y0 AND r.y1)
SELECT plan, ord, count(*) AS inside FROM h GROUP BY ALL HAVING count(*) >= 18""")
def walls_in_text(spark, d):
    """Inner walls of which 55 % of 31 sample points lie in any of the plan's boxes."""
    w = bound(spark, d, "walls").where("not external").select("plan", "ord", "x1", "y1", "x2", "y2", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("i"))
    s = w.select("plan", "ord", "i", (F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("i") / 30).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("i") / 30).alias("y"))
    r = bound(spark, d, "rooms").select("plan", "x0", "y0", F.col("x1").alias("x9"), F.col("y1").alias("y9"))
    hit = s.join(r, "plan").where(F.col("x").between(F.col("x0"), F.col("x9")) & F.col("y").between(F.col("y0"), F.col("y9"))).select("plan", "ord", "i").distinct()
    return hit.groupBy("plan", "ord").agg(F.count(F.lit(1)).alias("inside")).where("inside >= 18")


@query("walls_on_detail", (90, 184), """
SELECT w.plan, w.ord FROM {walls} w JOIN {rooms} r ON r.plan = w.plan WHERE abs(w.x2-w.x1) >= abs(w.y2-w.y1) AND (w.y1+w.y2)/2 > r.y0 + 0.1 AND (w.y1+w.y2)/2 < r.y1 - 0.1
 AND least(greatest(w.x1,w.x2), r.x1) - greatest(least(w.x1,w.x2), r.x0) >= 0.68*abs(w.x2-w.x1) AND w.x1 <> w.x2 GROUP BY ALL""")
def walls_on_detail(spark, d):
    """Level walls that run inside a region for 68 % of their length."""
    w = bound(spark, d, "walls").withColumn("my", (F.col("y1") + F.col("y2")) / 2).where("abs(x2-x1) >= abs(y2-y1) and x1 <> x2")
    w = w.select("plan", "ord", "my", F.least("x1", "x2").alias("a"), F.greatest("x1", "x2").alias("b"))
    r = bound(spark, d, "rooms")
    run = F.least("b", "x1") - F.greatest("a", "x0")
    hit = w.join(r.drop("ord"), "plan").where((F.col("my") > F.col("y0") + 0.1) & (F.col("my") < F.col("y1") - 0.1) & (run >= 0.68 * (F.col("b") - F.col("a"))))
    return hit.select("plan", "ord").distinct()


@query("aligned_extension", (185, 325), """
SELECT a.plan, a.ord, b.ord AS other FROM {walls} a JOIN {walls} b ON a.plan = b.plan AND a.ord <> b.ord AND abs((a.y1+a.y2)/2 - (b.y1+b.y2)/2) <= 1
QUALIFY row_number() OVER (PARTITION BY a.plan, a.ord ORDER BY abs((a.y1+a.y2)/2 - (b.y1+b.y2)/2), abs(a.x1 - b.x1), b.ord) = 1""")
def aligned_extension(spark, d):
    """The wall whose line is nearest to each wall's, within a metre; then the nearest start, then list order."""
    w = bound(spark, d, "walls").select("plan", "ord", "x1", ((F.col("y1") + F.col("y2")) / 2).alias("line"))
    o = w.select("plan", F.col("ord").alias("other"), F.col("x1").alias("ox"), F.col("line").alias("ol"))
    delta = F.abs(F.col("line") - F.col("ol"))
    j = w.join(o, "plan").where((F.col("ord") != F.col("other")) & (delta <= 1))
    return j.groupBy("plan", "ord").agg(F.min(F.struct(delta.alias("a"), F.abs(F.col("x1") - F.col("ox")).alias("b"), "other")).alias("m")).select("plan", "ord", "m.other")


@query("face_ids", (210,), """
WITH c AS (SELECT plan, ord, round_even((x0+x1)/2*100, 0) AS cx, round_even((y0+y1)/2*100, 0) AS cy, round_even((x1-x0)*(y1-y0)*100, 0) AS a FROM {rooms})
SELECT plan, ord, concat('face_', substr(sha1(concat(CAST(CAST(cx AS BIGINT) AS VARCHAR), '|', CAST(CAST(cy AS BIGINT) AS VARCHAR), '|', CAST(CAST(a AS BIGINT) AS VARCHAR))), 1, 10)) AS face_id FROM c""")
def face_ids(spark, d):
    """Stable ids from centre and area in hundredths, ties to even; texts of binary doubles are avoided."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    whole = lambda v: F.rint(v * 100).cast("long").cast("string")
    text = F.concat_ws("|", whole((x0 + x1) / 2), whole((y0 + y1) / 2), whole((x1 - x0) * (y1 - y0)))
    return bound(spark, d, "rooms").select("plan", "ord", F.concat(F.lit("face_"), F.substring(F.sha1(text), 1, 10)).alias("face_id"))


@query("room_lights", (247,), """
WITH n AS (SELECT *, greatest(1, least(8, CAST(ceil((x1-x0)/3) AS INTEGER))) AS nx, greatest(1, least(8, CAST(ceil((y1-y0)/3) AS INTEGER))) AS ny FROM {rooms})
SELECT plan, ord, round(x0 + (x1-x0)*(i+0.5)/nx, 6) AS x, round(y0 + (y1-y0)*(j+0.5)/ny, 6) AS y FROM n, range(0, 8) a(i), range(0, 8) b(j) WHERE i < nx AND j < ny""")
def room_lights(spark, d):
    """Middles of cells of about 3 m, eight a side at most."""
    n = lambda a, b: F.greatest(F.lit(1), F.least(F.lit(8), F.ceil((F.col(b) - F.col(a)) / 3).cast("int")))
    r = bound(spark, d, "rooms").withColumn("nx", n("x0", "x1")).withColumn("ny", n("y0", "y1"))
    r = r.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    at = lambda a, b, i, k: F.round(F.col(a) + (F.col(b) - F.col(a)) * (F.col(i) + 0.5) / F.col(k), 6)
    return r.select("plan", "ord", at("x0", "x1", "i", "nx").alias("x"), at("y0", "y1", "j", "ny").alias("y"))


@query("safe_point", (243, 244, 245), """
WITH g AS (SELECT r.plan, r.ord, i*16 + j AS k, x0 + (x1-x0)*(i+0.5)/16 AS x, y0 + (y1-y0)*(j+0.5)/16 AS y, least((x1-x0)*(i+0.5)/16, (x1-x0)*(15.5-i)/16, (y1-y0)*(j+0.5)/16, (y1-y0)*(15.5-j)/16) AS c
 FROM {rooms} r, range(0, 16) a(i), range(0, 16) b(j))
SELECT plan, ord, round(x, 6) AS x, round(y, 6) AS y, round(c, 6) AS clearance FROM g WHERE c >= 0.38 QUALIFY row_number() OVER (PARTITION BY plan, ord ORDER BY round(c, 9) DESC, k) = 1""")
def safe_point(spark, d):
    """Of a 16 x 16 grid in a room the first point with the largest clearance, .38 m at least.

    A point's clearance is the lesser of those of its column and its row, which grow towards the middle: the middle point
    has the largest, and the first column and the first row that reach it (to 9 decimals) meet in the first point.
    """
    n, half = 16, 7
    x0, y0, width, height = F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    away = lambda side, i: side * (i + 0.5) / n
    r = bound(spark, d, "rooms").withColumn("most", F.least(away(width, half), away(height, half))).where("most >= 0.38")

    def first(side):
        def reaches(i):
            a = away(side, i)
            # Rounding is dear and only decides between neighbours.
            same = F.when(a >= F.col("most"), True).when(a < F.col("most") - 2e-9, False).otherwise(F.round(a, 9) >= F.round("most", 9))
            return (a >= 0.38) & same

        return F.coalesce(*[F.when(reaches(i), i) for i in range(half + 1)])

    r = r.withColumns({"i": first(width), "j": first(height)})
    clear = F.least(away(width, F.col("i")), away(height, F.col("j")))
    at = lambda low, side, i: F.round(low + side * (F.col(i) + 0.5) / n, 6)
    return r.select("plan", "ord", at(x0, width, "i").alias("x"), at(y0, height, "j").alias("y"), F.round(clear, 6).alias("clearance"))


@query("ceiling_without_voids", (251,), """
WITH v AS (SELECT plan, ord FROM {furniture} WHERE category = 'bookshelf' GROUP BY ALL)
SELECT r.plan, r.ord, (r.x1-r.x0)*(r.y1-r.y0) AS area FROM {rooms} r WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.plan = r.plan AND v.ord = r.ord + 1)""")
def ceiling_without_voids(spark, d):
    v = bound(spark, d, "furniture").where("category = 'bookshelf'").select("plan", (F.col("ord") - 1).alias("ord")).distinct()
    return bound(spark, d, "rooms").join(v, ["plan", "ord"], "left_anti").select("plan", "ord", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


@query("stage_timing", (312, 343), """
SELECT user_id, event_type, count(*) AS runs, round(sum(value), 6) AS total, round(max(value), 6) AS slowest, median(value) AS mid FROM events GROUP BY ALL""")
def stage_timing(spark, d):
    e = bound(spark, d, "events")
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("value"), 6).alias("total"), F.round(F.max("value"), 6).alias("slowest"), F.median("value").alias("mid"))


@query("longest_regular_run", (179,), None)
def longest_regular_run(spark, d):
    """The longest run of nearly equal steps among a plan's level walls: first line, step, length."""
    from quoin.operators.grouped import per_plan

    def run(part):
        lines = sorted(set(((part["y1"] + part["y2"]) / 2).tolist()))
        best = (0, 0.0, 0.0)
        for i in range(len(lines)):
            for j in range(i + 1, len(lines)):
                step, last, n = lines[j] - lines[i], lines[j], 2
                for v in lines[j + 1 :]:
                    if abs(v - last - step) <= max(0.05, 0.22 * step):
                        last, n = v, n + 1
                if n > best[0]:
                    best = (n, lines[i], step)
        return [best] if best[0] >= 3 else []

    return per_plan(bound(spark, d, "walls"), run, "plan long, n int, first double, step double")
