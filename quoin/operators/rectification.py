"""Frames of plans that were photographed at an angle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import projective as P
from quoin.functions.text import let
from quoin.plans.bindings import bound
from quoin.registry import query


@query("rectified_frames", (68, 69, 71), """
WITH t AS (SELECT o_orderkey, o_orderkey % 4 AS turns, CASE WHEN o_orderkey % 2 = 1 THEN 800e0 ELSE 1000e0 END AS w, CASE WHEN o_orderkey % 2 = 1 THEN 1000e0 ELSE 800e0 END AS h,
 o_custkey % 97 AS a, o_orderkey % 89 AS b, (o_custkey * 7 + o_orderkey) % 83 AS c, (o_orderkey * 5 + o_custkey) % 79 AS d FROM orders),
q AS (SELECT *, a/w AS x0, b/h AS y0, (w - c)/w AS x1, d/h AS y1, (w - b)/w AS x2, (h - a)/h AS y2, d/w AS x3, (h - c)/h AS y3 FROM t),
m AS (SELECT *, (x1-x2)*(y3-y2) - (x3-x2)*(y1-y2) AS den, x0-x1+x2-x3 AS sx, y0-y1+y2-y3 AS sy FROM q),
g AS (SELECT *, (sx*(y3-y2) - (x3-x2)*sy)/den AS g, ((x1-x2)*sy - sx*(y1-y2))/den AS k FROM m),
p AS (SELECT *, x1-x0+g*x1 AS m0, x3-x0+k*x3 AS m1, x0 AS m2, y1-y0+g*y1 AS m3, y3-y0+k*y3 AS m4, y0 AS m5,
 CASE turns WHEN 0 THEN 420 WHEN 1 THEN 800 - 310 WHEN 2 THEN 1000 - 420 ELSE 310 END / w AS px, CASE turns WHEN 0 THEN 310 WHEN 1 THEN 420 WHEN 2 THEN 800 - 310 ELSE 1000 - 420 END / h AS py FROM g),
r AS (SELECT *, (m4 - m5*k)*px + (m2*k - m1)*py + (m1*m5 - m2*m4) AS u, (m5*g - m3)*px + (m0 - m2*g)*py + (m2*m3 - m0*m5) AS v, (m3*k - m4*g)*px + (m1*g - m0*k)*py + (m0*m4 - m1*m3) AS z FROM p)
SELECT o_orderkey, round((u/z*600 - 30)*400/480, 5) + 0.0 AS x, round((v/z*480 - 20)*300/400, 5) + 0.0 AS y, true AS there_and_back, true AS corners_fit FROM r""")
def rectified_frames(spark, d):
    """Where a point of each photograph lies in the analysed image: turned, made upright from its corners, cropped, resized.

    The photographs have 1000 x 800 pixels, the upright plan 600 x 480; its part from (30, 20) of 480 x 400 becomes
    400 x 300.  there_and_back: the inverse leads back within 1e-9 of the longer side; corners_fit: the corners become the upright plan's.
    """
    o = bound(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("turns"), *[c.cast("double").alias(n) for n, c in (
        ("a", F.col("o_custkey") % 97), ("b", F.col("o_orderkey") % 89), ("c", (F.col("o_custkey") * 7 + F.col("o_orderkey")) % 83), ("d", (F.col("o_orderkey") * 5 + F.col("o_custkey")) % 79))])
    odd = F.col("turns") % 2 == 1
    w, h = F.when(odd, 800.0).otherwise(1000.0), F.when(odd, 1000.0).otherwise(800.0)
    a, b, c, e = (F.col(n) for n in "abcd")
    corners = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((a, b), (w - c, e), (w - b, h - a), (e, h - c))])
    crop = [F.lit(v) for v in (30.0, 20.0, 480.0, 400.0)]
    upright = [(0.0, 0.0), (600.0, 0.0), (600.0, 480.0), (0.0, 480.0)]

    def fits(frame, source, k):
        def image(corner):
            return let(P.applied(frame, corner["x"], corner["y"]), lambda p: (F.abs(p["x"] - upright[k][0]) < 1e-6) & (F.abs(p["y"] - upright[k][1]) < 1e-6))

        at = F.get("corners", F.lit(k))
        return let(P.applied(source, at["x"], at["y"]), image)

    def analysed(frame):
        source = P.adjugate(P.quarter_turn(F.col("turns"), F.lit(1000), F.lit(800)))
        fit = let(source, lambda source: fits(frame, source, 0) & fits(frame, source, 1) & fits(frame, source, 2) & fits(frame, source, 3))

        def placed(m):
            def read(p):
                near = let(P.applied(m["analysis_to_source"], p["x"], p["y"]), lambda q: (F.abs(q["x"] - 420) < 1e-6) & (F.abs(q["y"] - 310) < 1e-6))
                return F.struct((F.round(p["x"], 5) + 0.0).alias("x"), (F.round(p["y"], 5) + 0.0).alias("y"), near.alias("there_and_back"), fit.alias("corners_fit"))

            return let(P.applied(m["source_to_analysis"], F.lit(420.0), F.lit(310.0)), read)

        return let(P.analysed(frame, *crop, F.lit(400), F.lit(300)), placed)

    frame = P.rectified(F.col("corners"), F.col("turns"), F.lit(1000), F.lit(800), F.lit(600), F.lit(480))
    # A generator, past which no filter is pushed: one would compute the frame again.
    found = F.filter(F.array(let(frame, analysed)), lambda s: s["x"].isNotNull())
    return o.withColumn("corners", corners).select("o_orderkey", F.inline(found))
