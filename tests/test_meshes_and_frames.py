"""Triangles, voids, face pairs and rectified frames against plain versions and known cases."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.functions import projective as P
from quoin.functions import triangles as T
from quoin.operators import bands, meshes, overlay

RING = "id int, ring array<struct<x:double,y:double>>"


def plain_ears(ring):
    """Ears one by one, the first in the order of the ring each time."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2
    rest, out, slack = list(ring if area > 0 else ring[::-1]), [], max(abs(area), 1.0) * 1e-12
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    while len(rest) > 3:
        for i, b in enumerate(rest):
            a, c = rest[i - 1], rest[(i + 1) % len(rest)]
            turn = cross(a, b, c)
            others = [p for k, p in enumerate(rest) if k not in (i, (i - 1) % len(rest), (i + 1) % len(rest))]
            if abs(turn) <= slack or turn > 0 and not any(min(cross(a, b, p), cross(b, c, p), cross(c, a, p)) >= -slack for p in others):
                out += [[a, b, c]] if abs(turn) > slack else []
                del rest[i]
                break
        else:
            return None
    return out + [rest] if abs(cross(*rest)) > slack else out


def test_ears(spark):
    r = random.Random(2)
    rings = [[(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], [(0, 3), (4, 3), (4, 0), (0, 0)], [(0, 0), (2, 0), (4, 0), (4, 3), (4, 4), (0, 4)], [(0, 0), (2, 2), (2, 0), (0, 2)], [(0, 0), (1, 1)], []]
    for _ in range(60):  # star-shaped rings, turning either way
        n = r.randint(3, 16)
        ring = [((q := r.choice([0.5, 1.0, 2.0, r.uniform(0.2, 3)])) * math.cos(2 * math.pi * k / n), q * math.sin(2 * math.pi * k / n)) for k in range(n)]
        rings.append(ring[:: r.choice([1, -1])])
    for _ in range(20):  # combs
        tops = [r.randint(1, 4) for _ in range(r.randint(1, 6))]
        rings.append([(0, 0), (len(tops), 0)] + [p for k in range(len(tops) - 1, -1, -1) for p in ((k + 1, tops[k]), (k, tops[k]))])
    rings = [[(float(x), float(y)) for x, y in ring] for ring in rings]
    got = {row.id: row.t for row in spark.createDataFrame([*enumerate(rings), (999, None)], RING).select("id", T.ears(F.col("ring")).alias("t")).collect()}
    assert got.pop(999) is None
    for i, ring in enumerate(rings):
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2
        want = plain_ears(ring) if len(ring) > 2 and area else None
        found = got[i] and [[tuple(p) for p in t] for t in got[i]]
        assert found == (want or None), i
        if want:
            assert sum((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) for a, b, c in found) / 2 == pytest.approx(area)


def test_rings_that_touch(spark):
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    floors = {
        1: [box(0, 0, 10, 10), box(2, 2, 4, 4), box(6, 6, 8, 8)],
        2: [box(0, 0, 10, 10), [(0, 0), (3, 1), (1, 3)]],  # a corner on a corner
        3: [box(0, 0, 10, 10), box(2, 2, 4, 4), box(4, 4, 6, 6)],  # two holes meet in a point
        4: [box(0, 0, 4, 4), box(3, 3, 5, 5)],  # a hole leaves the floor
        5: [box(0, 0, 10, 10), box(2, 0, 4, 4)],  # along a side
        6: [box(0, 0, 10, 10), box(2, 2, 8, 8), box(2.5, 2.5, 3, 3)],  # one hole inside another
        7: [box(0, 0, 10, 10)],
    }
    rows = [(p, 0, 0, part, [tuple(map(float, c)) for c in ring]) for p, rings in floors.items() for part, ring in enumerate(rings)]
    given = spark.createDataFrame(rows, "plan long, layer int, poly int, part int, ring array<struct<x:double,y:double>>")
    assert sorted(r.plan for r in meshes.contacts(given).collect()) == [2, 3, 4, 5]
    assert {r.plan: r.first for r in overlay.areas(overlay.cells(given.where("plan in (1, 6)"))).collect()} == {1: 92.0, 6: 64.25}


BANDS = "plan long, ord int, orientation string, place double, s double, e double, thickness double, confidence double, external boolean"


def test_pairs_best_first(spark):
    """Rounds give what taking pairs one by one gives: also in chains, with ties and with ends in many pairs."""
    r, rows, want = random.Random(6), [], set()
    for plan in range(40):
        n = r.randint(2, 14)
        chain = [(i, i + 1, i / 100) for i in range(n)] if plan % 4 == 0 else []
        pairs = chain or list({(a, b): (a, b, r.choice([0.5, 0.6, r.random()])) for a, b in (sorted(r.sample(range(n), 2)) for _ in range(20))}.values())
        rows += [(plan, *p) for p in pairs]
        used = set()
        for a, b, score in sorted(pairs, key=lambda p: (p[2], p[0], p[1]), reverse=True):
            if not {a, b} & used:
                used |= {a, b}
                want.add((plan, a, b, score))
    given = spark.createDataFrame(rows, "plan int, a int, b int, score double")
    assert {tuple(x[c] for c in ("plan", "a", "b", "score")) for x in bands.best_first(given).collect()} == want
    assert bands.best_first(given.limit(0)).count() == 0


def test_candidates_meet_in_neighbouring_bins_only(spark):
    r = random.Random(3)
    rows = [(p, i, r.choice("hv"), r.uniform(0, 120), s := r.choice([0.0, 3.0, 40.0]), s + r.choice([100.0, 104.0, 150.0]), r.choice([2.0, 9.0]), 0.5, False) for p in range(3) for i in range(60)]
    want = set()
    for p, i, o, c, s, e, t, *_ in rows:
        for q, k, o2, c2, s2, e2, t2, *_ in rows:
            both = max(0.0, min(e, e2) - max(s, s2))
            if p == q and i < k and o == o2 and max(t, t2) <= 6 and 7 <= abs(c - c2) <= 24 and both / max(e - s, e2 - s2) >= 0.55 and both / min(e - s, e2 - s2) >= 0.9:
                want.add((p, i, k))
    assert {(x.plan, x.a, x.b) for x in bands.face_candidates(spark.createDataFrame(rows, BANDS)).collect()} == want and len(want) > 50


def test_outlined_drawings_lose_dimension_lines(spark):
    face = lambda i, o, c, s, e, t=2.0: (1, i, o, float(c), float(s), float(e), t, 0.5, i == 0)
    walls = [face(0, "h", 100, 100, 400), face(1, "h", 115, 100, 600), face(2, "v", 100, 100, 400), face(3, "v", 115, 100, 400), face(4, "h", 400, 100, 400), face(5, "h", 414, 100, 400)]
    lines = [face(6, "h", 700, 100, 400), face(7, "h", 710, 100, 180), face(8, "v", 300, 100, 390, 8.0), face(9, "v", 250, 100, 350)]
    got = {(r.ord, r.other): r for r in bands.pair_faces(spark.createDataFrame(walls + lines, BANDS)).collect()}
    assert set(got) == {(0, 1), (2, 3), (4, 5), (7, None), (8, None), (9, None)}
    assert (got[0, 1].s, got[0, 1].e) == (100.0, 407.5)  # the longer face's tail is a measure
    two = [*walls[:2], *walls[4:], *lines]  # no upright pair: the drawing shows no outlined walls
    assert (6, None) in {(r.ord, r.other) for r in bands.pair_faces(spark.createDataFrame(two, BANDS)).collect()}
    near = [face(1, "h", 115, 90, 405)]  # a face that is hardly longer pairs, and the wall ends half its width on
    got = {(r.ord, r.other): r for r in bands.pair_faces(spark.createDataFrame([walls[0], *near, *walls[2:], *lines], BANDS)).collect()}
    assert (6, None) not in got and {(0, 1), (2, 3), (4, 5), (7, None), (8, None), (9, None)} == set(got)
    wall = got[0, 1]
    assert (wall.place, wall.s, wall.e, wall.thickness, wall.confidence, wall.external) == (107.5, 92.5, 405.0, 17.0, 0.62, True)


def test_elimination(spark):
    r = np.random.default_rng(1)
    systems = [r.normal(size=(8, 9)) for _ in range(30)]
    systems[0][:, 0] = 0  # no solution
    systems[1][0, 0] = 0  # needs another pivot
    systems[2] = np.concatenate([np.eye(8)[::-1], np.arange(8.0)[:, None]], axis=1)
    rows = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(systems)], "id int, m array<array<double>>")
    got = {x.id: x.h for x in rows.select("id", P.solve(F.col("m"), 8).alias("h")).collect()}
    assert got[0] is None
    for i, s in enumerate(systems[1:], 1):
        assert np.allclose(got[i], np.linalg.solve(s[:, :8], s[:, 8]), rtol=1e-8)


def test_frames_of_corners(spark):
    quads = {
        1: [(0, 0), (1000, 0), (1000, 800), (0, 800)], 2: [(100, 50), (900, 120), (980, 700), (30, 780)],
        3: [(0, 0), (1, 1), (2, 2), (3, 3)],  # on a line
        4: [(500, 0), (500, 0), (500, 800), (500, 800)], 5: [(100, 100), (900, 100), (500, 101), (400, 101)], 6: [(100, 100), (200, 100), (150, 120), (160, 700)],
    }
    given = spark.createDataFrame([(k, [tuple(map(float, p)) for p in q], t) for k, q in quads.items() for t in range(4)], "id int, c array<struct<x:double,y:double>>, turns int")
    size = (F.lit(1000), F.lit(800))
    # Corners are pixels of the turned image; for the test they are those of the source, turned.
    turned = F.transform("c", lambda p: P.applied(P.quarter_turn(F.col("turns"), *size), p["x"], p["y"]))
    found = given.withColumn("m", P.rectified(turned, F.col("turns"), *size, F.lit(300), F.lit(200))).collect()
    for row in found:
        if row.id in (3, 4, 6):
            assert row.m is None, row.id
            continue
        m = np.array(row.m)
        for (x, y), want in zip(quads[row.id], [(0, 0), (300, 0), (300, 200), (0, 200)]):
            image = m @ [x, y, 1]
            assert np.allclose(image[:2] / image[2], want, atol=1e-6)
    whole = given.where("id = 2 and turns = 1").select(P.analysed(P.rectified(turned, F.col("turns"), *size, F.lit(300), F.lit(200)), *[F.lit(v) for v in (10.0, 20.0, 200.0, 100.0)], F.lit(400), F.lit(300)).alias("a")).first()["a"]
    there, back = np.array(whole["source_to_analysis"]), np.array(whole["analysis_to_source"])
    assert np.allclose(there @ back / (there @ back)[2, 2], np.eye(3), atol=1e-9)
    empty = given.limit(1).select(P.analysed(P.matrix(1, 0, 0, 0, 1, 0, 0, 0, 1), *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)], F.lit(4), F.lit(3)).alias("a")).first()
    assert empty["a"] is None
