"""Annotated drawings in SVG: structural polygons with the transforms of all groups around them.

Files come through Spark's binaryFile source, so any store that Spark reads will do; each is pulled through as XML events,
with a stack of transforms as the only state, and becomes rows.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions.transforms import IDENTITY, affine, product

SCHEMA = "path string, ord int, category string, ring array<struct<x:double,y:double>>, error string"
#: Bytes that the parser is fed at a time.
CHUNK = 1 << 16


def category_of(classes: str) -> str | None:
    names = classes.split()
    if "Wall" not in names and "Space" not in names:
        return None
    return "outdoor_rooms" if "Outdoor" in names else "walls" if "Wall" in names else "rooms"


def corners(points: str, matrix: tuple) -> list[tuple[float, float]]:
    values = [float(v) for v in points.replace(",", " ").split()]
    if len(values) < 6 or len(values) % 2:
        raise ValueError("invalid polygon coordinates")
    a, b, c, d, e, f = matrix
    return [(a * x + c * y + e, b * x + d * y + f) for x, y in zip(values[::2], values[1::2])]


def structures(content: bytes) -> Iterator[tuple[int, str | None, list | None, str | None]]:
    """(ord, category, ring, error) of every structural group, in document order of their ends; one error ends a file
    that isn't XML."""
    parser, stack, found = ET.XMLPullParser(["start", "end"]), [], 0
    try:
        for at in range(0, len(content) or 1, CHUNK):
            parser.feed(content[at : at + CHUNK])
            if hasattr(parser, "flush"):  # newer parsers hold back what they have read
                parser.flush()
            for event, element in parser.read_events():
                if event == "start":
                    above = stack[-1] if stack else None
                    own = affine(element.get("transform", ""))
                    matrix = product(above["matrix"], own) if above and own and above["matrix"] else own if not above else None
                    if above and above["category"] and element.tag.rsplit("}", 1)[-1] == "polygon":
                        above["polygons"].append((element.get("points", ""), matrix))
                    category = category_of(element.get("class", ""))
                    stack.append({"matrix": matrix, "category": category, "ord": found, "polygons": []})
                    found += category is not None
                    continue
                group = stack.pop()
                element.clear()
                if not group["category"]:
                    continue
                ring, error = None, None
                if len(group["polygons"]) != 1:
                    error = "expected one direct polygon"
                elif group["polygons"][0][1] is None:
                    error = "unsupported transform"
                else:
                    try:
                        ring = corners(*group["polygons"][0])
                    except ValueError:
                        error = "invalid polygon coordinates"
                yield group["ord"], group["category"], ring, error
        parser.close()
    except ET.ParseError as e:
        yield -1, None, None, f"not XML: {e.msg.split(':')[0]}"


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA: a row for each structural group of the files at `path` (a pattern will do).

    category is walls, rooms or outdoor_rooms; ring is null and error says why where a group has not exactly one direct
    polygon, a transform can't be read, or coordinates are not pairs of numbers.  A file that is not XML gives its rows up
    to there and one without a category; an empty file gives none.
    """

    def run(batches):
        for batch in batches:
            rows = [(path, *row) for path, content in zip(batch["path"], batch["content"]) for row in structures(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "ord", "category", "ring", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, SCHEMA)


def clipped(found: DataFrame, width: float, height: float) -> DataFrame:
    """SCHEMA and area: each polygon's area inside the image, by even-odd where it crosses itself; a polygon without area
    there is an error."""
    from quoin.operators import sweeps

    image = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (width, 0), (width, height), (0, height))])
    # Behind a generator, so that each file is read and each area found once.
    joined = found.select("path", "ord", "category", "ring", "error", F.inline(F.array(F.struct(sweeps.common(F.col("ring"), image).alias("area")))))
    empty = F.col("ring").isNotNull() & ~(F.coalesce("area", F.lit(0.0)) > 1e-9)
    return joined.select("path", "ord", "category", "ring", F.when(empty, "no area in the image").otherwise(F.col("error")).alias("error"), F.when(~empty, F.col("area")).alias("area"))
