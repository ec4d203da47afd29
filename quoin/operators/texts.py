"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.plans.bindings import bound
from quoin.registry import query

# Label texts of every shape the parser knows, made from a part's numbers; the SQL states what each must give.
LABEL = """CASE p_partkey % 10 WHEN 0 THEN concat('Bedroom (', CAST(p_size AS VARCHAR(9)), '''3 x ', CAST(p_size + 2 AS VARCHAR(9)), ''')')
 WHEN 1 THEN concat(CAST(p_size AS VARCHAR(9)), '′6½″ x 12′') WHEN 2 THEN concat(CAST(p_size AS VARCHAR(9)), ' x 12 ft')
 WHEN 3 THEN concat(CAST(p_size + 100 AS VARCHAR(9)), 'X340') WHEN 4 THEN concat(CAST(p_size AS VARCHAR(9)), ' m x 12 ft')
 WHEN 5 THEN concat(CAST(p_size AS VARCHAR(9)), '''13 x 12''') WHEN 6 THEN concat('abc', CAST(p_size AS VARCHAR(9)), ' x 4m')
 WHEN 7 THEN concat('Staircase  ', p_brand) WHEN 8 THEN concat('Toilet ', p_brand) ELSE p_name END"""


@query("dimension_parse", (205, 206, 207, 208, 209, 301), """
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS n, p_partkey % 10 AS k FROM part),
v AS (SELECT *, CASE k WHEN 0 THEN (n + 0.25)*0.3048 WHEN 1 THEN (n + 6.5/12)*0.3048 WHEN 2 THEN n*0.3048 WHEN 3 THEN (n+100)/100 WHEN 4 THEN n END AS w,
 CASE k WHEN 0 THEN (n + 2)*0.3048 WHEN 1 THEN 12*0.3048 WHEN 2 THEN 12*0.3048 WHEN 3 THEN 3.4 WHEN 4 THEN 12*0.3048 END AS h,
 CASE k WHEN 0 THEN 'ft' WHEN 1 THEN 'ft' WHEN 2 THEN 'ft' WHEN 3 THEN 'context_cm' WHEN 4 THEN 'mixed' END AS u FROM p)
SELECT p_partkey, CASE WHEN k = 5 THEN 'error' WHEN k > 5 THEN 'none' WHEN w BETWEEN 0.2 AND 80 AND h BETWEEN 0.2 AND 80 THEN 'value' ELSE 'error' END AS state,
 round(w, 6) AS width_m, round(h, 6) AS height_m, u AS unit FROM v""")
def dimension_parse(spark, d):
    p = bound(spark, d, "part").select("p_partkey", T.dimension_pair(F.expr(LABEL)).alias("v"))
    return p.select("p_partkey", "v.state", F.round("v.width_m", 6).alias("width_m"), F.round("v.height_m", 6).alias("height_m"), "v.unit")


@query("text_classify", (203, 204), """
SELECT p_partkey, CASE WHEN p_partkey % 10 < 5 THEN 'dimension' WHEN p_partkey % 10 = 7 THEN 'stair_label' WHEN p_partkey % 10 = 8 THEN 'room_label' ELSE 'text' END AS kind FROM part""")
def text_classify(spark, d):
    return bound(spark, d, "part").select("p_partkey", T.classify(F.expr(LABEL)).alias("kind"))


@query("material_names", (211, 212, 218, 219, 222), """
SELECT p_partkey, trim(regexp_replace(lower(concat(' ', p_brand, ' -- ', p_type, '!')), '[^a-z0-9]+', '_', 'g'), '_') AS key,
 CASE p_partkey % 4 WHEN 0 THEN 'ceramic_tile' WHEN 1 THEN 'wood' END AS material, CASE p_partkey % 4 WHEN 0 THEN 'kitchen_counter' WHEN 1 THEN 'wardrobe' END AS fixture FROM part""")
def material_names(spark, d):
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('Kitchen ', p_size) WHEN 1 THEN concat('main BEDROOM-', p_size) WHEN 2 THEN 'Hall' ELSE p_brand END")
    raw = F.concat(F.lit(" "), F.col("p_brand"), F.lit(" -- "), F.col("p_type"), F.lit("!"))
    return bound(spark, d, "part").select("p_partkey", T.material_key(raw).alias("key"), T.room_material(name).alias("material"), T.fixture_kind(name).alias("fixture"))


@query("furniture_families", (98, 216), """
WITH f AS (SELECT *, CASE category WHEN 'Double Bed' THEN 'bed' WHEN 'couch' THEN 'sofa' WHEN 'bedside-table' THEN 'table' WHEN 'Carpet' THEN 'rug' WHEN 'arm chair' THEN 'chair' ELSE 'bookshelf' END AS a FROM {furniture})
SELECT plan, ord, a AS alias, CASE WHEN a = 'bookshelf' THEN 'wardrobe' ELSE a END AS family, a = 'rug' AS walkable FROM f""")
def furniture_families(spark, d):
    f = bound(spark, d, "furniture")
    family = T.furniture_family(F.col("category"))
    return f.select("plan", "ord", T.furniture_alias(F.col("category")).alias("alias"), family.alias("family"), family.isin("floor_patch", "rug", "door", "window").alias("walkable"))


# Categories of every family and of none, from a part's numbers.
CATEGORY = """CASE p_partkey % 12 WHEN 0 THEN 'Kitchen-Sink' WHEN 1 THEN 'hob' WHEN 2 THEN 'side table' WHEN 3 THEN 'armchair' WHEN 4 THEN 'king_bed' WHEN 5 THEN 'COUCH' WHEN 6 THEN 'book shelf'
 WHEN 7 THEN 'wc' WHEN 8 THEN 'kitchen counter' WHEN 9 THEN 'bathtub' WHEN 10 THEN 'generic' ELSE p_brand END"""


@query("category_families", (215, 217, 318), f"""
WITH c AS (SELECT p_partkey, p_size, {CATEGORY} AS category FROM part), t AS (SELECT *, string_split(replace(replace(lower(trim(category)), '-', '_'), ' ', '_'), '_') AS t, replace(replace(lower(trim(category)), '-', '_'), ' ', '_') AS n FROM c),
f AS (SELECT *, CASE WHEN list_contains(t, 'sink') OR n LIKE '%sink' THEN 'sink' WHEN list_has_any(t, ['stove', 'hob']) THEN 'stove' WHEN list_contains(t, 'table') OR n LIKE '%table' THEN 'table' WHEN list_contains(t, 'chair') THEN 'chair'
  WHEN list_contains(t, 'bed') THEN 'bed' WHEN list_has_any(t, ['sofa', 'couch']) THEN 'sofa' WHEN list_has_any(t, ['wardrobe', 'shelf']) THEN 'wardrobe' WHEN list_has_any(t, ['toilet', 'wc']) THEN 'toilet' WHEN list_has_any(t, ['counter', 'kitchen']) THEN 'counter'
  WHEN n LIKE '%bath%' THEN 'fixture' ELSE 'generic' END AS asset,
 CASE WHEN n IN ('generic') THEN NULL WHEN list_contains(t, 'sink') OR n LIKE '%sink' THEN 'sink' WHEN list_has_any(t, ['stove', 'hob']) THEN 'stove' WHEN list_contains(t, 'table') OR n LIKE '%table' THEN 'table' WHEN list_has_any(t, ['chair', 'armchair']) THEN 'chair'
  WHEN list_contains(t, 'bed') THEN 'bed' WHEN list_has_any(t, ['sofa', 'couch']) THEN 'sofa' WHEN list_contains(t, 'counter') THEN 'counter' WHEN list_has_any(t, ['wardrobe', 'shelf']) THEN 'storage' WHEN n LIKE '%bath%' OR list_contains(t, 'toilet') THEN 'fixture' ELSE n END AS detected FROM t)
SELECT p_partkey, asset, detected, detected IS NULL OR detected = 'chair' AS fits_chair FROM f""")
def category_families(spark, d):
    """A category's family for assets and for detections, and whether a chair hint may name such a detection."""
    c = bound(spark, d, "part").select("p_partkey", F.expr(CATEGORY).alias("category"))
    return c.select("p_partkey", T.asset_family(F.col("category")).alias("asset"), T.detected_family(F.col("category")).alias("detected"), T.compatible(F.col("category"), F.lit("chair")).alias("fits_chair"))


@query("sample_directory", (221, 342), """
SELECT doc_id, concat(substr(trim(regexp_replace(concat(lang, '/', source, ' #', CAST(doc_id AS VARCHAR)), '[^A-Za-z0-9_-]+', '-', 'g'), '-'), 1, 64), '-',
 substr(sha256(concat(lang, '/', source, ' #', CAST(doc_id AS VARCHAR))), 1, 12)) AS directory, sha256(text) AS checksum FROM documents""")
def sample_directory(spark, d):
    name = F.concat("lang", F.lit("/"), "source", F.lit(" #"), F.col("doc_id").cast("string"))
    return bound(spark, d, "documents").select("doc_id", T.sample_directory(name).alias("directory"), F.sha2("text", 256).alias("checksum"))


@query("settings_text", (15, 223, 224, 226), """
WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'off' WHEN 2 THEN '' WHEN 3 THEN 'maybe' WHEN 4 THEN '1' ELSE 'FALSE' END AS t, p_partkey % 6 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 2 THEN 'null' WHEN k = 3 THEN 'error' ELSE 'value' END AS state, CASE WHEN k IN (0, 4) THEN true WHEN k IN (1, 5) THEN false END AS value,
 CASE WHEN k % 3 = 2 THEN 0 ELSE CAST(k AS INTEGER) END AS major, concat('k=1 Token=<redacted> next ', CAST(k AS VARCHAR)) AS line FROM p""")
def settings_text(spark, d):
    k = F.col("p_partkey") % 6
    t = F.when(k == 0, " Yes").when(k == 1, "off").when(k == 2, "").when(k == 3, "maybe").when(k == 4, "1").otherwise("FALSE")
    version = F.when(k % 3 == 2, "x.1").otherwise(F.concat(k.cast("string"), F.lit(".2")))
    line = F.concat(F.lit("k=1 Token=a5s"), F.col("p_brand"), F.lit(" next "), k.cast("string"))
    v = bound(spark, d, "part").select("p_partkey", T.flag(t).alias("f"), T.major_version(version).alias("major"), T.redact(line).alias("line"))
    return v.select("p_partkey", "f.state", "f.value", "major", "line")


@query("evidence_union", (166, 298), """
WITH e AS (SELECT l_orderkey AS plan, ord, CASE l_linenumber % 4 WHEN 0 THEN 'cv+ocr' WHEN 1 THEN 'unknown' WHEN 2 THEN 'ocr + user' ELSE '' END AS t FROM {lines}),
x AS (SELECT plan, ord, unnest(string_split(t, '+')) AS p, generate_subscripts(string_split(t, '+'), 1) AS i FROM e),
f AS (SELECT plan, trim(p) AS p, min(ord * 100 + i) AS k FROM x WHERE trim(p) NOT IN ('', 'unknown') GROUP BY ALL)
SELECT o.plan, coalesce(string_agg(f.p, '+' ORDER BY f.k), 'unknown') AS evidence FROM (SELECT DISTINCT plan FROM e) o LEFT JOIN f USING (plan) GROUP BY o.plan""")
def evidence_union(spark, d):
    t = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'cv+ocr' WHEN 1 THEN 'unknown' WHEN 2 THEN 'ocr + user' ELSE '' END")
    e = bound(spark, d, "lines").groupBy(F.col("l_orderkey").alias("plan")).agg(F.array_sort(F.collect_list(F.struct("ord", t.alias("t")))).alias("e"))
    return e.select("plan", T.evidence_union(F.col("e.t")).alias("evidence"))
