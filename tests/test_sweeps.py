"""Areas swept in arrays, against the same slabs as rows, and how often queries on them deal out their rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quoin.operators import overlay, sweeps

RINGS = "plan long, layer int, poly int, part int, ring array<struct<x:double,y:double>>"
SF = "/root/testdata/sf0.001"


def turned(cx, cy, w, d, degrees):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [(cx + x * c - y * s, cy + x * s + y * c) for x, y in ((-w / 2, -d / 2), (w / 2, -d / 2), (w / 2, d / 2), (-w / 2, d / 2))]


def test_swept_areas_are_those_of_the_cells(spark, monkeypatch):
    r, rings = random.Random(11), []
    for plan in range(40):
        for layer in (0, 1):
            for poly in range(r.randint(0, 4)):
                cx, cy, degrees = r.randint(0, 8) / 2, r.randint(0, 8) / 2, r.choice([0, 30, 90, 45, r.uniform(0, 360)])
                rings.append((plan, layer, poly, 0, turned(cx, cy, 2.0, r.randint(2, 6) / 2, degrees)))
                if r.random() < 0.4:  # a hole
                    rings.append((plan, layer, poly, 1, turned(cx, cy, 0.5, 0.5, degrees)))
    rings += [(50, 0, 0, 0, [(0.0, 0.0), (1.0, 1.0)]), (51, 0, 0, 0, [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]), (52, 0, 0, 0, []), (53, 1, 0, 0, [(0.0, 0.0), (None, 1.0), (3.0, 0.0), (0.0, 4.0)])]
    given = spark.createDataFrame(rings, RINGS)
    values = lambda df: {x.plan: [round(x[a], 7) for a in sweeps.AREAS] for x in df.collect()}
    expected = values(overlay.areas(overlay.cells(given)))
    assert values(sweeps.areas(sweeps.gathered(given))) == expected and len(expected) > 30
    monkeypatch.setattr(sweeps, "PAIRS", 7)
    monkeypatch.setattr(sweeps, "PLANS", 3)
    assert values(sweeps.areas(sweeps.gathered(given))) == expected


@pytest.mark.parametrize("name", ["free_space", "area_scores", "labels_in_free_space", "arc_coverage"])
def test_lines_are_dealt_out_once(spark, name):
    """Edges, slabs and their bins stay in the task that has the plan: what is shuffled is the table's rows."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_faces_and_drawings_are_overlaid_without_dealing_out_edges(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    pairs = spark.range(5).select(F.struct("id", (F.col("id") * 2).alias("k")).alias("plan"), sweeps.laid_over(ring, ring))
    found = sweeps.areas(pairs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.plan.k, r.both, r.left) for r in found.collect()} == {(2 * k, 4.0, 0.0) for k in range(5)}


def test_ears_are_cut_side_by_side(monkeypatch):
    """Rings of equally many corners go through each step together; how many at a time makes no difference."""
    import pyarrow as pa

    from quoin.functions import triangles

    r = random.Random(5)
    rings = []
    for _ in range(200):
        n = r.randint(1, 6)
        tops = [(x, h) for k in reversed(range(n)) for h in [r.randint(1, 8)] for x in (k + 1, k)]
        rings.append([{"x": float(x), "y": float(y)} for x, y in [(0, 0), (n, 0), *tops]][:: r.choice([1, -1])])
    rings += [None, [], [{"x": None, "y": 0.0}] * 4]
    given = pa.array(rings, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    calls, first = [], triangles._first
    monkeypatch.setattr(triangles, "_first", lambda *a: calls.append(1) or first(*a))
    found = triangles._ears(given).to_pylist()
    assert len(calls) < 60 and found[-3:] == [None, None, None]
    size = lambda t: sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(t, t[1:] + t[:1])) / 2
    assert all(abs(sum(map(size, t)) - abs(size(ring))) < 1e-9 for t, ring in zip(found[:200], rings))
    monkeypatch.setattr(triangles, "CORNERS", 20)
    assert triangles._ears(given).to_pylist() == found


def test_objects_are_boxed_side_by_side_and_once(spark):
    """Rows of equally many points take their steps together, and a filter on the boxes does not find them again."""
    plan = entry.queries()["object_footprints"].__globals__["footprints"](spark.createDataFrame([(1, 0, [(0.0, 0.0), (90.0, 0.0), (90.0, 60.0), (0.0, 60.0), (45.0, 30.0)]), (1, 1, [(0.0, 0.0), (1.0, 1.0)]), (1, 2, None)], "plan long, ord int, points array<struct<x:double,y:double>>"))
    assert [(r.ord, r.x, r.y, r.width, r.depth, r.rotation) for r in plan.collect()] == [(0, 45.0, 30.0, 90.0, 60.0, 0.0)]
    from quoin.functions.hulls import least_box

    one = F.array(*[F.struct(F.lit(float(x)).alias("x"), (F.lit(float(y)) + F.col("id")).alias("y")) for x, y in ((0, 0), (3, 0), (3, 2), (0, 2), (1, 1))])
    df = spark.range(3).select("id", F.inline(F.array(least_box(one)))).where("area > 1 and depth > 1")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1 and "transform" not in text
    assert [(r.id, round(r.area, 9), round(r.y, 9)) for r in df.orderBy("id").collect()] == [(k, 6.0, k + 1.0) for k in range(3)]


def test_drawings_are_read_once_to_be_clipped(spark):
    from quoin.sources import annotations

    square = [(-2.0, -2.0), (4.0, -2.0), (4.0, 3.0), (-2.0, 3.0)]
    rows = [("a", 0, "walls", square, None), ("a", 1, "rooms", [(20.0, 0.0), (30.0, 0.0), (30.0, 5.0)], None), ("a", 2, "walls", None, "expected one direct polygon")]
    given = spark.createDataFrame(rows, annotations.SCHEMA)
    found = annotations.clipped(given, 10, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and "Exchange" not in plan
    assert [(r.ord, r.error, r.area) for r in sorted(found.collect())] == [(0, None, 12.0), (1, "no area in the image", None), (2, "expected one direct polygon", None)]


def test_points_along_walls_are_no_rows(spark):
    plan = entry.queries()["presence_profile"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") <= 3
