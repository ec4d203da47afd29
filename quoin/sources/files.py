"""Files that are no tables: JSON documents replaced as a whole, and the check of binary glTF models."""

from __future__ import annotations

import json
import math
import struct
import uuid

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def replace_json(spark: SparkSession, path: str, value) -> None:
    """Write value as JSON with sorted keys beside path and rename it there: a reader sees the old file or the new one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    beside = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    # A context has atomic renames over an existing file, which a plain file system's rename() has not.
    files = hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(beside)
    try:
        out.write(bytearray((json.dumps(value, indent=2, sort_keys=True) + "\n").encode()))
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(beside, target, how)


def check_glb(data: bytes | None) -> tuple[int, int, list[str]]:
    """(meshes, nodes with a mesh, issues) of a binary glTF 2 file; no issues: valid."""
    if not data:
        return 0, 0, ["file is empty"]
    if len(data) < 20 or data[:4] != b"glTF":
        return 0, 0, ["not a binary glTF file"]
    version, length, size, kind = struct.unpack_from("<IIII", data, 4)
    if version != 2 or length != len(data) or kind != 0x4E4F534A or 20 + size > len(data):
        return 0, 0, ["broken header"]
    try:
        scene = json.loads(data[20 : 20 + size])
    except ValueError:
        return 0, 0, ["broken scene"]
    meshes, nodes = scene.get("meshes") or [], [n for n in scene.get("nodes") or [] if "mesh" in n]
    places = {p.get("attributes", {}).get("POSITION") for m in meshes for p in m.get("primitives", [])} - {None}
    accessors = scene.get("accessors") or []
    bounds = [v for i in places if i < len(accessors) for side in ("min", "max") for v in accessors[i].get(side) or [math.nan]]
    issues = [] if bounds and all(map(math.isfinite, bounds)) else ["invalid or missing bounds"]
    return len(meshes), len(nodes), issues if meshes and nodes else [*issues, "no geometry found"]


def glb_report(content: Column) -> Column:
    """Struct(meshes, nodes, issues, valid) of files' bytes, such as the column `content` of Spark's binaryFile source."""

    def run(files: pd.Series) -> pd.DataFrame:
        rows = [check_glb(bytes(f) if f is not None else None) for f in files]
        return pd.DataFrame([(m, n, issues, not issues) for m, n, issues in rows], columns=["meshes", "nodes", "issues", "valid"])

    return F.pandas_udf(run, "meshes int, nodes int, issues array<string>, valid boolean")(content)
