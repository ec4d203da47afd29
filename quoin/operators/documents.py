"""Plan documents as nested JSON: built from the bound tables, parsed with the fixed schema, migrated and exploded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.plans.bindings import bound
from quoin.registry import query
from quoin.sources import plans as P


def documents(spark, d) -> DataFrame:
    """plan, json: walls without ids at odd places, doors that name their wall by place; every other plan is version 2."""
    w = bound(spark, d, "walls")
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    wall = F.struct("ord", F.when(F.col("ord") % 2 == 0, F.col("id")).alias("id"), point("x1", "y1").alias("start"), point("x2", "y2").alias("end"), F.col("thickness").alias("thickness_m"), "external")
    walls = w.groupBy("plan").agg(F.array_sort(F.collect_list(wall)).alias("walls"))
    o = bound(spark, d, "openings")
    door = F.struct("ord", "id", F.substring("wall_id", 2, 9).alias("wall_id"), ((F.col("s") + F.col("e")) / 2).alias("offset_m"), F.when(F.col("ord") % 2 == 0, F.col("e") - F.col("s")).otherwise(0.0).alias("width_m"))
    doors = o.groupBy("plan").agg(F.array_sort(F.collect_list(door)).alias("doors"))
    version = F.when(F.col("plan") % 2 == 0, "2.1").otherwise("3.0")
    return walls.join(doors, "plan").select("plan", F.to_json(F.struct(version.alias("schema_version"), "walls", "doors")).alias("json"))


def parsed(docs: DataFrame) -> DataFrame:
    return docs.select("plan", F.from_json("json", P.PLAN).alias("p")).select("plan", "p.*")


@query("document_migrate", (1, 2, 4, 5), """
SELECT plan, ord, CASE WHEN plan % 2 = 0 THEN (s+e)/2 - w/2 END AS a, CASE WHEN plan % 2 = 0 THEN (s+e)/2 + w/2 END AS b, '3.0' AS version
FROM (SELECT *, CASE WHEN ord % 2 = 0 AND e > s THEN e - s ELSE 0.9 END AS w FROM {openings})""")
def document_migrate(spark, d):
    new = P.migrate(parsed(documents(spark, d)))
    doors = new.select("plan", "schema_version", F.posexplode("doors").alias("ord", "o"))
    return doors.select("plan", "ord", F.col("o.start_offset_m").alias("a"), F.col("o.end_offset_m").alias("b"), F.col("schema_version").alias("version"))


@query("document_wall_names", (6, 147), """
WITH n AS (SELECT plan, ord, CASE WHEN ord % 2 = 0 THEN id ELSE concat('wall_', lpad(CAST(ord AS VARCHAR), 3, '0')) END AS id FROM {walls})
SELECT o.plan, o.ord, coalesce(n.id, substr(o.wall_id, 2)) AS wall_id FROM {openings} o LEFT JOIN n ON n.plan = o.plan AND n.ord = CAST(substr(o.wall_id, 2) AS INTEGER)""")
def document_wall_names(spark, d):
    named = P.name_walls(parsed(documents(spark, d)))
    return named.select("plan", F.posexplode("doors").alias("ord", "o")).select("plan", "ord", F.col("o.wall_id").alias("wall_id"))


@query("document_round_trip", (22,), """
SELECT plan, count(*) AS walls, sum(x1 + y2) AS total, count(CASE WHEN ord % 2 = 0 THEN id END) AS named FROM {walls} GROUP BY plan""")
def document_round_trip(spark, d):
    """Documents written as JSON and parsed again hold the same walls."""
    p = parsed(parsed(documents(spark, d)).select("plan", F.to_json(F.struct("schema_version", "walls", "doors")).alias("json")))
    w = P.elements(p, "walls")
    return w.groupBy("plan").agg(F.count(F.lit(1)).alias("walls"), F.sum(F.col("start.x") + F.col("end.y")).alias("total"), F.count("id").alias("named"))


@query("path_rebase", (27,), """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/new' WHEN p_partkey % 3 = 1 THEN concat('/new/', p_name) ELSE concat('/stage2/', p_name) END AS path FROM part""")
def path_rebase(spark, d):
    k = F.col("p_partkey") % 3
    old = F.when(k == 0, "/stage").when(k == 1, F.concat(F.lit("/stage/"), "p_name")).otherwise(F.concat(F.lit("/stage2/"), "p_name"))
    return bound(spark, d, "part").select("p_partkey", P.rebase(old, "/stage", "/new").alias("path"))


@query("ocr_rows", (20, 21), """
SELECT plan, ord, trim(name) AS text, greatest(0, least(1, confidence * 1.5)) AS confidence FROM {labels_px} WHERE confidence * 1.5 >= 0.35 AND ord % 6 <> 3""")
def ocr_rows(spark, d):
    """Text rows of a scanner: no empty texts or polygons of less than four points, confidence clamped, weak rows out."""
    l = bound(spark, d, "labels_px")
    corners = F.when(F.col("ord") % 6 == 3, 3).otherwise(4)
    polygon = F.transform(F.sequence(F.lit(1), corners), lambda i: F.struct(F.col("x").alias("x"), (F.col("y") + i).alias("y")))
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") * 1.5))
    return l.withColumn("polygon", polygon).where((F.trim("name") != "") & (F.size("polygon") >= 4) & (c >= 0.35)).select("plan", "ord", F.trim("name").alias("text"), c.alias("confidence"))


@query("registry_lookup", (13, 14), """
SELECT ord, plan, CASE category WHEN 'Double Bed' THEN 'bed.glb' WHEN 'couch' THEN 'sofa.glb' END AS asset FROM {furniture}""")
def registry_lookup(spark, d):
    """Assets of a registry by normalised category; an inner table of a fixed size is broadcast."""
    from quoin.functions.text import material_key

    r = P.registry(spark, '{"Double  Bed": {"file": "bed.glb"}, "COUCH": {"file": "sofa.glb"}}').select("key", F.get_json_object("entry", "$.file").alias("asset"))
    f = bound(spark, d, "furniture").withColumn("key", material_key(F.col("category")))
    return f.join(F.broadcast(r), "key", "left").select("plan", "ord", "asset")


_SCENE = """CASE p_partkey % 5 WHEN 0 THEN '{"meshes":[{"primitives":[{"attributes":{"POSITION":0}}]}],"nodes":[{"mesh":0}],"accessors":[{"min":[0,0,0],"max":[1,2,3]}]}' WHEN 1 THEN '{"meshes":[],"nodes":[]}'
 WHEN 2 THEN '{"meshes":[{"primitives":[{"attributes":{"POSITION":0}}]}],"nodes":[{"mesh":0}],"accessors":[{"max":[1,2,3]}]}' WHEN 3 THEN '{"meshes":' ELSE '{"nodes":[{}]}' END"""


@query("glb_reports", (32,), """
WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_partkey % 7 = 0 AS cut FROM part)
SELECT p_partkey, CASE WHEN NOT cut AND k IN (0, 2) THEN 1 ELSE 0 END AS meshes, CASE WHEN cut THEN 'broken header' WHEN k = 0 THEN '' WHEN k = 2 THEN 'invalid or missing bounds' WHEN k = 3 THEN 'broken scene' ELSE 'invalid or missing bounds; no geometry found' END AS issues, NOT cut AND k = 0 AS valid FROM p""")
def glb_reports(spark, d):
    """Models checked from their bytes: header, scene, bounds and geometry; every seventh file is a byte short."""
    from quoin.sources.files import glb_report

    scene = F.expr(_SCENE).cast("binary")
    low = lambda n: F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(n), 8, "0"), F.lit("(..)"))), "")  # noqa: E731  little-endian
    size = F.octet_length(scene)
    whole = F.concat(F.unhex(F.concat(F.lit("676C5446" "02000000"), low(size + 20), low(size), F.lit("4A534F4E"))), scene)
    data = F.when(F.col("p_partkey") % 7 == 0, F.substring(whole, F.lit(1), F.octet_length(whole) - 1)).otherwise(whole)
    r = bound(spark, d, "part").select("p_partkey", glb_report(data).alias("r"))
    return r.select("p_partkey", "r.meshes", F.array_join("r.issues", "; ").alias("issues"), "r.valid")


@query("embedded_materials", (350,), """
WITH a AS (SELECT l_orderkey AS plan, concat('r', CAST(l_partkey % 4 AS VARCHAR)) AS target, arg_max(concat('preset', CAST(l_suppkey % 5 AS VARCHAR)), ord) AS preset FROM {lines} GROUP BY ALL),
m AS (SELECT r.plan, r.id, coalesce(a.preset, 'fallback') AS preset FROM {rooms} r LEFT JOIN a ON a.plan = r.plan AND a.target = r.id)
SELECT plan, concat('{"material_plan":{', string_agg(concat('"', id, '":"', preset, '"'), ',' ORDER BY id), '}}') AS metadata FROM m GROUP BY plan""")
def embedded_materials(spark, d):
    """A renderer's copy of each plan's metadata with the preset of every room in it."""
    a = bound(spark, d, "lines").groupBy(F.col("l_orderkey").alias("plan"), F.concat(F.lit("r"), (F.col("l_partkey") % 4).cast("string")).alias("id"))
    last = a.agg(F.max_by(F.concat(F.lit("preset"), (F.col("l_suppkey") % 5).cast("string")), "ord").alias("preset"))
    m = bound(spark, d, "rooms").select("plan", "id").join(last, ["plan", "id"], "left").select("plan", "id", F.coalesce("preset", F.lit("fallback")).alias("preset"))
    plan = F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "preset"))))
    return m.groupBy("plan").agg(F.to_json(F.struct(plan.alias("material_plan"))).alias("metadata"))


@query("json_replaced", (24,), "SELECT source, count(*) AS n FROM documents GROUP BY source")
def json_replaced(spark, d):
    """A report of counts, written as one JSON file that replaces an older one at once, and read back."""
    import tempfile

    from quoin.sources.files import replace_json

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="quoin-")
    counts = bound(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a source
    path = f"{folder.rstrip('/')}/quoin-report-{uuid.uuid4().hex}.json"
    for rows in ([], counts):
        replace_json(spark, path, {"counts": [{"source": r["source"], "n": r["n"]} for r in rows]})
    read = spark.read.schema("counts array<struct<source:string,n:long>>").option("multiLine", True).json(path)
    return read.select(F.inline("counts"))
