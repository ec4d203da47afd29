"""Scale of a plan from constraints in tiers: the best tier with accepted rows decides, by a robust weighted mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.plans.bindings import bound
from quoin.registry import query

# Tiers by rank, with the confidence of one row and of two or more.
TIERS = [("manual", 1.0, 1.0), ("dimension_annotation", 0.65, 0.90), ("room_dimension", 0.60, 0.85), ("plan_extent", 0.18, 0.25), ("door_width", 0.30, 0.45), ("wall_thickness", 0.15, 0.20)]
# Range of pixels a metre, largest residual of a pair, and the outlier factor.
LOW, HIGH, RESIDUAL, MAD = 10.0, 1000.0, 0.35, 2.8


def constraint_ppm(c: DataFrame) -> DataFrame:
    """ppm, residual and weight of each constraint: longer side on longer, shorter on shorter."""
    m0, m1, e0, e1 = (F.abs(F.col(x)) for x in ("m0", "m1", "e0", "e1"))
    a = F.try_divide(F.greatest(m0, m1), F.greatest(e0, e1))
    b = F.try_divide(F.least(m0, m1), F.least(e0, e1))
    mean = (a + b) / 2
    rank = F.lit(2)
    for i, (name, _, _) in enumerate(TIERS):
        rank = F.when(F.col("tier") == name, i).otherwise(rank)
    return c.withColumns({"ppm": mean, "residual": F.abs(a - b) / F.greatest(mean, F.lit(1e-6)), "weight": F.greatest(F.col("weight"), F.lit(0.05)), "rank": rank})


def audit(c: DataFrame) -> DataFrame:
    """Every constraint with `reason` (null if its tier accepts it) and the tier that decides the plan."""
    rows = constraint_ppm(c)
    early = F.when(~F.coalesce(F.col("ppm").between(LOW, HIGH), F.lit(False)), "pixels_per_metre_out_of_range").when(F.col("residual") > RESIDUAL, "aspect_residual_too_large")
    rows = rows.withColumn("early", early).withColumn("x", F.when(F.col("early").isNull(), F.col("ppm")))
    tier = Window.partitionBy("plan", "rank")
    rows = rows.withColumn("med", F.median("x").over(tier)).withColumn("dev", F.abs(F.col("x") - F.col("med")))
    mad = F.median("dev").over(tier)
    rows = rows.withColumn("mad", F.when(mad == 0, F.greatest(F.col("med") * 0.03, F.lit(1.0))).otherwise(mad))
    rows = rows.withColumn("late", F.when(F.col("dev") > F.col("mad") * MAD, "median_absolute_deviation_outlier"))
    ok = F.col("early").isNull() & F.col("late").isNull()
    rows = rows.withColumn("best", F.min(F.when(ok, F.col("rank"))).over(Window.partitionBy("plan")))
    named = F.lit(None).cast("string")
    for i, (name, _, _) in enumerate(TIERS):
        named = F.when(F.col("best") == i, F.lit(name)).otherwise(named)
    above = F.when(F.col("rank") > F.col("best"), F.concat(F.lit("superseded_by_"), named, F.lit("_tier")))
    return rows.withColumn("reason", F.coalesce(above, "early", "late")).withColumn("source", named)


def solve(c: DataFrame) -> DataFrame:
    """plan, ppm, confidence, source, used: one row for each plan that any tier can scale."""
    rows = audit(c).where(F.col("reason").isNull())
    final = F.sum(F.col("ppm") * F.col("weight")).over(Window.partitionBy("plan")) / F.sum("weight").over(Window.partitionBy("plan"))
    rows = rows.withColumn("final", final).withColumn("r", F.abs(F.col("ppm") - F.col("final")) / F.greatest("final", F.lit(1e-6)) + F.col("residual"))
    got = rows.groupBy("plan").agg(F.first("final").alias("ppm"), F.avg("r").alias("spread"), F.count(F.lit(1)).alias("used"), F.first("source").alias("source"))
    base = F.lit(0.3)
    for name, one, more in TIERS:
        base = F.when(F.col("source") == name, F.when(F.col("used") >= 2, more).otherwise(one)).otherwise(base)
    confidence = F.greatest(F.lit(0.05), base * F.greatest(F.lit(0.4), 1 - F.least(F.lit(0.6), F.col("spread"))))
    return got.select("plan", "ppm", confidence.alias("confidence"), "source", "used")


_CTE = """
WITH a AS (SELECT plan, ord, CASE tier WHEN 'room_dimension' THEN 2 WHEN 'door_width' THEN 4 ELSE 5 END AS rank, greatest(weight, 0.05) AS weight,
 greatest(m0,m1)/greatest(e0,e1) AS pa, least(m0,m1)/least(e0,e1) AS pb FROM {constraints}),
b AS (SELECT *, (pa+pb)/2 AS ppm, abs(pa-pb)/greatest((pa+pb)/2, 1e-6) AS residual FROM a),
c AS (SELECT *, CASE WHEN NOT ppm BETWEEN 10 AND 1000 THEN 'pixels_per_metre_out_of_range' WHEN residual > 0.35 THEN 'aspect_residual_too_large' END AS early FROM b),
d AS (SELECT *, median(CASE WHEN early IS NULL THEN ppm END) OVER (PARTITION BY plan, rank) AS med FROM c),
e AS (SELECT *, CASE WHEN early IS NULL THEN abs(ppm-med) END AS dev FROM d), f AS (SELECT *, median(dev) OVER (PARTITION BY plan, rank) AS m FROM e),
g AS (SELECT *, CASE WHEN dev > 2.8*(CASE WHEN m = 0 THEN greatest(med*0.03, 1) ELSE m END) THEN 'median_absolute_deviation_outlier' END AS late FROM f),
h AS (SELECT *, min(CASE WHEN early IS NULL AND late IS NULL THEN rank END) OVER (PARTITION BY plan) AS best FROM g),
i AS (SELECT *, CASE best WHEN 2 THEN 'room_dimension' WHEN 4 THEN 'door_width' WHEN 5 THEN 'wall_thickness' END AS source FROM h),
j AS (SELECT *, coalesce(CASE WHEN rank > best THEN concat('superseded_by_', source, '_tier') END, early, late) AS reason FROM i)
"""


@query("constraint_audit", (137, 299), _CTE + "SELECT plan, ord, round(ppm + 1e-6, 3) AS ppm, round(residual, 6) AS residual, reason IS NULL AS accepted, reason FROM j")
def constraint_audit(spark, d):
    a = audit(bound(spark, d, "constraints"))
    return a.select("plan", "ord", F.round(F.col("ppm") + 1e-6, 3).alias("ppm"), F.round("residual", 6).alias("residual"), F.col("reason").isNull().alias("accepted"), "reason")


SOLVED = _CTE + """, k AS (SELECT *, sum(ppm*weight) OVER (PARTITION BY plan) / sum(weight) OVER (PARTITION BY plan) AS final FROM j WHERE reason IS NULL),
l AS (SELECT plan, any_value(final) AS ppm, avg(abs(ppm-final)/greatest(final, 1e-6) + residual) AS spread, count(*) AS used, any_value(source) AS source FROM k GROUP BY plan)
SELECT plan, round(ppm, 3) AS ppm, source, used, round(greatest(0.05, (CASE source WHEN 'room_dimension' THEN CASE WHEN used >= 2 THEN 0.85 ELSE 0.6 END
 WHEN 'door_width' THEN CASE WHEN used >= 2 THEN 0.45 ELSE 0.3 END ELSE CASE WHEN used >= 2 THEN 0.2 ELSE 0.15 END END) * greatest(0.4, 1 - least(0.6, spread))), 5) AS confidence FROM l"""


@query("scale_tier_solve", (135, 136), SOLVED)
def scale_tier_solve(spark, d):
    s = solve(bound(spark, d, "constraints"))
    return s.select("plan", F.round("ppm", 3).alias("ppm"), "source", "used", F.round("confidence", 5).alias("confidence"))
