"""Readings from pixels and annotation files: profiles along walls, saturated pixels, plaques, transforms, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.functions import transforms
from quoin.operators.texts import LABEL
from quoin.plans.bindings import bound
from quoin.registry import query

# Kinds of text that are labels.
LABEL_KINDS = ("room_label", "dimension", "balcony_label", "lift_label", "stair_label")

_TRANSFORM = """CASE p_partkey % 6 WHEN 0 THEN concat('translate(', CAST(p_size AS VARCHAR(9)), ', 3) scale(2)') WHEN 1 THEN concat('scale(2, 4),translate(', CAST(p_size AS VARCHAR(9)), ')')
 WHEN 2 THEN concat('matrix(1 2 3 4 5 ', CAST(p_size AS VARCHAR(9)), ')') WHEN 3 THEN concat('rotate(90 ', CAST(p_size AS VARCHAR(9)), ' 1)') WHEN 4 THEN 'skewX(3)' ELSE 'translate(1, 2) and more' END"""


@query("affine_texts", (9,), """
WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, CAST(p_size AS DOUBLE) AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS a, CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 1 END AS b, CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN -1 END AS c,
 CASE k WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 0 END AS d, CASE k WHEN 0 THEN n WHEN 1 THEN 2*n WHEN 2 THEN 5 WHEN 3 THEN n + 1 END AS e, CASE k WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN n WHEN 3 THEN 1 - n END AS f FROM p""")
def affine_texts(spark, d):
    """Six numbers of each transform text; null where the text is not one."""
    read = F.pandas_udf(transforms.affines, "a double, b double, c double, d double, e double, f double")
    p = bound(spark, d, "part").select("p_partkey", read(F.expr(_TRANSFORM)).alias("m"))
    return p.select("p_partkey", *[(F.round(f"m.{c}", 9) + 0.0).alias(c) for c in "abcdef"])


@query("label_filter", (87,), "SELECT p_partkey, CASE WHEN p_partkey % 10 < 5 THEN 'dimension' WHEN p_partkey % 10 = 7 THEN 'stair_label' ELSE 'room_label' END AS kind FROM part WHERE p_partkey % 10 IN (0, 1, 2, 3, 4, 7, 8)")
def label_filter(spark, d):
    """The texts that are labels."""
    return bound(spark, d, "part").select("p_partkey", T.classify(F.expr(LABEL)).alias("kind")).where(F.col("kind").isin(*LABEL_KINDS))


@query("geometry_fingerprint", (168,), """
WITH w AS (SELECT plan, 0 AS side, ord, concat(id, ' ', CAST(CAST(x1*16 AS BIGINT) AS VARCHAR), ' ', CAST(CAST(y1*16 AS BIGINT) AS VARCHAR), ' ', CAST(CAST(x2*16 AS BIGINT) AS VARCHAR), ' ', CAST(CAST(y2*16 AS BIGINT) AS VARCHAR)) AS t FROM {walls}
UNION ALL SELECT plan, 1, ord, concat(id, ' on ', wall_id, ' ', CAST(CAST(s AS BIGINT) AS VARCHAR), ' ', CAST(CAST(e AS BIGINT) AS VARCHAR)) FROM {openings})
SELECT plan, sha256(string_agg(t, chr(10) ORDER BY side, ord)) AS fingerprint FROM w GROUP BY plan""")
def geometry_fingerprint(spark, d):
    """A plan's digest over its walls and the openings on them, in list order: it changes as any of them is moved."""
    whole = lambda *c: [F.expr(x).cast("long").cast("string") for x in c]
    walls = bound(spark, d, "walls").select("plan", F.lit(0).alias("side"), "ord", F.concat_ws(" ", "id", *whole("x1*16", "y1*16", "x2*16", "y2*16")).alias("t"))
    openings = bound(spark, d, "openings").select("plan", F.lit(1).alias("side"), "ord", F.concat_ws(" ", "id", F.lit("on"), "wall_id", *whole("s", "e")).alias("t"))
    parts = F.array_sort(F.collect_list(F.struct("side", "ord", "t")))
    return walls.unionByName(openings).groupBy("plan").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["t"]), "\n"), 256).alias("fingerprint"))


@query("presence_profile", (178,), """
WITH m AS (SELECT DISTINCT l_orderkey AS plan, CAST((l_partkey*7 + l_linenumber*13) % 25 AS INTEGER)//4 AS gx, CAST((l_suppkey*11) % 25 AS INTEGER)//4 AS gy FROM {lines}),
s AS (SELECT plan, ord, i, CASE WHEN ord % 2 = 0 THEN x1 + (x2-x1)*i/8 ELSE x1 + o*thickness/2 END AS x, CASE WHEN ord % 2 = 0 THEN y1 + o*thickness/2 ELSE y1 + (y2-y1)*i/8 END AS y FROM {axis_walls}, range(0, 9) a(i), range(-2, 3) b(o)),
h AS (SELECT DISTINCT s.plan, s.ord, s.i FROM s JOIN m ON m.plan = s.plan AND m.gx = floor(s.x) AND m.gy = floor(s.y))
SELECT w.plan, w.ord, count(h.i) AS present, coalesce(string_agg(CAST(h.i AS VARCHAR), ',' ORDER BY h.i), '') AS steps FROM {axis_walls} w LEFT JOIN h USING (plan, ord) GROUP BY ALL""")
def presence_profile(spark, d):
    """At which of nine steps along a wall any of five lines beside each other meets a filled cell of the mask.

    A plan's cells come to each of its walls as one array, so that no point of a wall is a row.
    """
    cell = lambda c: F.floor(c % 25 / 4)
    number = lambda gx, gy: gx * (1 << 31) + gy
    lines = bound(spark, d, "lines").select(F.col("l_orderkey").alias("plan"), number(cell(F.col("l_partkey") * 7 + F.col("l_linenumber") * 13), cell(F.col("l_suppkey") * 11)).alias("cell"))
    mask = lines.groupBy("plan").agg(F.collect_set("cell").alias("cells"))
    w = bound(spark, d, "axis_walls").select("plan", "ord", "x1", "y1", "x2", "y2", "thickness").join(mask, "plan", "left")
    along = lambda v, i: F.col(f"{v}1") + (F.col(f"{v}2") - F.col(f"{v}1")) * i / 8
    across = lambda v, o: F.col(f"{v}1") + o * F.col("thickness") / 2

    def met(i):
        flat = F.exists(F.sequence(F.lit(-2), F.lit(2)), lambda o: F.array_contains("cells", number(F.floor(along("x", i)), F.floor(across("y", o)))))
        upright = F.exists(F.sequence(F.lit(-2), F.lit(2)), lambda o: F.array_contains("cells", number(F.floor(across("x", o)), F.floor(along("y", i)))))
        return F.coalesce(F.when(F.col("ord") % 2 == 0, flat).otherwise(upright), F.lit(False))

    out = w.select("plan", "ord", F.filter(F.sequence(F.lit(0), F.lit(8)), met).alias("s"))
    return out.select("plan", "ord", F.size("s").cast("long").alias("present"), F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("steps"))


@query("saturated_pixels", (321,), """
WITH p AS (SELECT l_orderkey AS region, l_quantity AS s, l_linenumber*30 AS v, l_quantity >= 28 AND l_linenumber*30 >= 60 AS good FROM lineitem), n AS (SELECT *, bool_or(good) OVER (PARTITION BY region) AS any_ FROM p)
SELECT region, count(*) AS n, round(avg(s), 6) AS s, round(avg(v), 6) AS v FROM n WHERE good OR NOT any_ GROUP BY region""")
def saturated_pixels(spark, d):
    """The saturated and bright pixels of each region, or all of them where it has none, in one pass without a join."""
    p = bound(spark, d, "lineitem").select(F.col("l_orderkey").alias("region"), F.col("l_quantity").alias("s"), (F.col("l_linenumber") * 30).alias("v"))
    good = (F.col("s") >= 28) & (F.col("v") >= 60)
    both = [F.count_if(good), F.count(F.lit(1))]
    mean = lambda c: F.coalesce(F.avg(F.when(good, F.col(c))), F.avg(c))
    out = p.groupBy("region").agg(F.when(both[0] > 0, both[0]).otherwise(both[1]).alias("n"), F.round(mean("s"), 6).alias("s"), F.round(mean("v"), 6).alias("v"))
    return out


@query("label_plaques", (319,), """
WITH t AS (SELECT plan, ord, x, y, x - 0.5 AS x0, y - 0.25 AS y0, x + 0.5 AS x1, y + 0.25 AS y1 FROM {labels_px}), f AS (SELECT plan, ord, x, y, x + w AS x9, y + d AS y9, w*d AS area FROM {furniture})
SELECT f.plan, f.ord, coalesce(bool_or((t.x BETWEEN f.x AND f.x9 AND t.y BETWEEN f.y AND f.y9) OR (greatest(least(t.x1, f.x9) - greatest(t.x0, f.x), 0)*greatest(least(t.y1, f.y9) - greatest(t.y0, f.y), 0) >= 0.8*0.5 AND f.area <= 4*0.5)), false) AS plaque
FROM f LEFT JOIN t ON t.plan = f.plan GROUP BY ALL""")
def label_plaques(spark, d):
    """Whether a footprint is only a label's plaque: it holds a text's middle, or 80 % of its box and is no larger than four."""
    t = bound(spark, d, "labels_px").select("plan", F.col("x").alias("tx"), F.col("y").alias("ty"))
    f = bound(spark, d, "furniture").select("plan", "ord", "x", "y", (F.col("x") + F.col("w")).alias("x9"), (F.col("y") + F.col("d")).alias("y9"), (F.col("w") * F.col("d")).alias("area"))
    side = lambda v, half: F.greatest(F.least(F.col(f"t{v}") + half, F.col(f"{v}9")) - F.greatest(F.col(f"t{v}") - half, F.col(v)), F.lit(0.0))
    middle = F.col("tx").between(F.col("x"), F.col("x9")) & F.col("ty").between(F.col("y"), F.col("y9"))
    covers = (side("x", 0.5) * side("y", 0.25) >= 0.8 * 0.5) & (F.col("area") <= 4 * 0.5)
    return f.join(t, "plan", "left").groupBy("plan", "ord").agg(F.coalesce(F.bool_or(middle | covers), F.lit(False)).alias("plaque"))
