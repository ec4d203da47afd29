"""Plan documents: JSON with a fixed schema, migration to the current version, element tables, writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "3.0"
POINT = "struct<x:double,y:double>"
_OPENING = f"struct<id:string,center:{POINT},width_m:double,height_m:double,sill_height_m:double,wall_id:string,offset_m:double,start_offset_m:double,end_offset_m:double,hinge_side:string,swing_side:string,confidence:double,evidence_source:string>"
_RING = f"struct<id:string,face_id:string,name:string,points:array<{POINT}>,confidence:double,evidence_source:string,dimension_m:array<double>>"
PLAN = (
    "schema_version string, coordinate_system string, pixels_per_metre double, "
    f"walls array<struct<id:string,start:{POINT},end:{POINT},thickness_m:double,height_m:double,external:boolean,wall_type:string,confidence:double,evidence_source:string>>, "
    f"doors array<{_OPENING}>, windows array<{_OPENING}>, rooms array<{_RING}>, balconies array<{_RING}>, "
    f"furniture array<struct<id:string,provenance:string,category:string,center:{POINT},width_m:double,depth_m:double,rotation_deg:double,height_m:double>>, metadata variant"
)
# Widths that an opening takes if it has none.
DOOR_WIDTH, WINDOW_WIDTH = 0.90, 1.20


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON document, with its file as `plan`; a document that isn't JSON is an error."""
    rows = spark.read.schema(PLAN).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.col("_metadata.file_name").alias("plan"), *[f.split()[0] for f in _fields()])


def _fields() -> list[str]:
    return ["schema_version", "coordinate_system", "pixels_per_metre", "walls", "doors", "windows", "rooms", "balconies", "furniture", "metadata"]


def unknown_fields(spark: SparkSession, path: str) -> DataFrame:
    """(plan, field): top-level names that the schema doesn't have."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("plan"), F.explode(F.json_object_keys("value")).alias("field"))
    return raw.where(~F.col("field").isin(_fields()))


def migrate(plans: DataFrame) -> DataFrame:
    """Documents before version 3: intervals of openings from their middles, face ids of rooms; then the version."""
    old = F.coalesce(F.split("schema_version", r"\.")[0].try_cast("int"), F.lit(0)) < 3

    def filled(default):
        def fill(o):
            width = F.coalesce(F.nullif(o["width_m"], F.lit(0.0)), F.lit(default))
            missing = o["start_offset_m"].isNull() | o["end_offset_m"].isNull()
            use = missing & o["offset_m"].isNotNull()
            return o.withField("start_offset_m", F.when(use, o["offset_m"] - width / 2).otherwise(o["start_offset_m"])).withField(
                "end_offset_m", F.when(use, o["offset_m"] + width / 2).otherwise(o["end_offset_m"])
            )

        return fill

    def faced(r, i):
        return r.withField("face_id", F.coalesce(r["face_id"], r["id"], F.format_string("legacy_face_%03d", i)))

    return (
        plans.withColumn("doors", F.when(old, F.transform("doors", filled(DOOR_WIDTH))).otherwise(F.col("doors")))
        .withColumn("windows", F.when(old, F.transform("windows", filled(WINDOW_WIDTH))).otherwise(F.col("windows")))
        .withColumn("rooms", F.when(old, F.transform("rooms", faced)).otherwise(F.col("rooms")))
        .withColumn("schema_version", F.lit(SCHEMA_VERSION))
    )


def name_walls(plans: DataFrame) -> DataFrame:
    """Walls without an id get wall_000 and so on by place; openings that name a place get the wall's id."""
    walls = F.transform("walls", lambda w, i: w.withField("id", F.coalesce(w["id"], F.format_string("wall_%03d", i))))
    named = plans.withColumn("walls", walls)
    ids = F.transform("walls", lambda w: w["id"])

    def pointed(o):
        place = o["wall_id"].try_cast("int")
        by_place = F.when(~F.array_contains(F.coalesce(ids, F.array()), o["wall_id"]) & (place >= 0), F.get(ids, place))
        return o.withField("wall_id", F.coalesce(by_place, o["wall_id"]))

    return named.withColumn("doors", F.transform("doors", pointed)).withColumn("windows", F.transform("windows", pointed))


def elements(plans: DataFrame, kind: str) -> DataFrame:
    """An element table: plan, ord and the element's fields."""
    return plans.select("plan", F.posexplode(kind).alias("ord", "e")).select("plan", "ord", "e.*")


def write_plans(plans: DataFrame, path: str) -> None:
    """One JSON document a line; the write appears whole or not at all."""
    plans.select(F.to_json(F.struct(*plans.columns)).alias("value")).write.mode("overwrite").text(path)


def registry(spark: SparkSession, text: str) -> DataFrame:
    """A registry of name -> entry, given as JSON text: key (lower case, `_` for the rest) and entry."""
    rows = [(k, json.dumps(v, sort_keys=True)) for k, v in json.loads(text).items()]
    raw = spark.createDataFrame(rows, "name string, entry string")
    return raw.select(F.btrim(F.regexp_replace(F.lower(F.trim("name")), "[^a-z0-9]+", "_"), F.lit("_")).alias("key"), "entry")


def rebase(column, old: str, new: str):
    """Paths at or under `old` moved to `new`; others stay."""
    return F.when(column == old, new).when(column.startswith(old.rstrip("/") + "/"), F.concat(F.lit(new.rstrip("/")), F.substring(column, len(old.rstrip("/")) + 1, 1 << 30))).otherwise(column)
