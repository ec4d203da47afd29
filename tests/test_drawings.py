"""Annotation files, ink, hulls, fitted furniture and door signs against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from quoin.functions import hulls as H
from quoin.operators import drawings, furnishing, ink, swings
from quoin.sources.annotations import annotations, clipped


def test_annotation_files(spark, tmp_path):
    files = {
        "plain": '<svg width="50" height="50" viewBox="0 0 50 50"><g class="Wall"><polygon points="10,10 20,10 20,40 10,40"/></g><g class="Space Bedroom"><polygon points="20,10 40,10 40,40 20,40"/></g>'
        '<g class="Space Outdoor"><polygon points="0,0 5,0 5,5 0,5"/></g><g class="Label"><polygon points="0,0 1,0 1,1"/></g></svg>',
        "nested": '<svg xmlns="http://www.w3.org/2000/svg"><g transform="translate(10 20)"><g class="Wall" transform="scale(2)"><polygon points="0,0 5,0 5,10 0,10"/></g>'
        '<g class="Space Bedroom"><g><polygon points="9,9 1,1 2,2"/></g><polygon transform="translate(5,0)" points="0,0 10,0 10,10 0,10"/></g></g></svg>',
        "inside": '<svg><g class="Space" transform="rotate(90)"><polygon points="0,0 4,0 4,-4 0,-4"/><g class="Wall"><polygon points="0,-1 2,-1 2,-2 0,-2"/></g></g></svg>',
        "faults": '<svg><g class="Wall"/><g class="Wall"><polygon points="0,0 1,0 1,1"/><polygon points="0,0 1,0 1,1"/></g><g class="Wall" transform="skewX(3)"><polygon points="0,0 1,0 1,1"/></g>'
        '<g class="Space"><polygon points="0,0 1,0 1"/></g><g class="Space"><polygon points="0,0 1,x 1,1"/></g><g class="Space"><polygon points="-5,-5 -1,-5 -1,-1"/></g><g class="Space"><polygon points="0,0 4,4 4,0 0,4"/></g></svg>',
        "cut": '<svg><g class="Wall"><polygon points="0,0 1,0 1,1"/></g><g class="Wall">', "empty": "",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.svg").write_text(text)
    found = clipped(annotations(spark, f"file://{tmp_path}/*.svg"), 100, 100)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.path, r.ord)):
        got.setdefault(r.path.split("/")[-1][:-4], []).append((r.category, r.error, r.area if r.area is None else round(r.area, 6)))
    assert [(c, a) for c, _, a in got["plain"]] == [("walls", 300.0), ("rooms", 600.0), ("outdoor_rooms", 25.0)]
    assert [(c, e, a) for c, e, a in got["nested"]] == [("walls", None, 200.0), ("rooms", None, 100.0)]
    assert [(c, e, a) for c, e, a in got["inside"]] == [("rooms", None, 16.0), ("walls", None, 2.0)]
    assert [e for _, e, *_ in got["faults"]] == ["expected one direct polygon", "expected one direct polygon", "unsupported transform", "invalid polygon coordinates", "invalid polygon coordinates", "no area in the image", None]
    assert got["faults"][-1][2] == 8.0  # a ring that crosses itself, by even-odd
    assert [(c, e) for c, e, *_ in got["cut"]] == [(None, "not XML: no element found"), ("walls", None)] and "empty" not in got
    nested = {r.ord: r.ring for r in annotations(spark, f"file://{tmp_path}/nested.svg").collect()}
    assert [(p.x, p.y) for p in nested[0]] == [(10, 20), (20, 20), (20, 40), (10, 40)] and [(p.x, p.y) for p in nested[1]] == [(15, 20), (25, 20), (25, 30), (15, 30)]


def plain_hull(points):
    """Corners from which all points lie to the left of some side: tried for every pair."""
    out = set()
    for a, b in itertools.permutations(set(points), 2):
        cross = [((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]), p) for p in points]
        if all(c >= -1e-9 for c, _ in cross):
            line = sorted(p for c, p in cross if abs(c) <= 1e-9)
            out |= {line[0], line[-1]}
    return out


def test_hulls_and_least_boxes(spark):
    r, rows = random.Random(4), []
    for i in range(60):
        if i % 3 == 0:
            points = [(float(r.randint(0, 6)), float(r.randint(0, 6))) for _ in range(r.randint(3, 14))]
        else:
            points = [(r.uniform(0, 9), r.uniform(0, 9)) for _ in range(r.randint(3, 20))]
        rows.append((i, points))
    turned = [(x * math.cos(0.4) - y * math.sin(0.4), x * math.sin(0.4) + y * math.cos(0.4)) for x in (0, 1, 2, 3) for y in (0, 0.5, 1)]
    rows += [(100, turned), (101, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]), (102, []), (103, None), (104, [(0.0, 0.0)] * 5)]
    df = spark.createDataFrame(rows, "id int, p array<struct<x:double,y:double>>")
    got = {x.id: x for x in df.select("id", H.hull(F.col("p")).alias("hull"), H.least_box(F.col("p")).alias("b")).collect()}
    for i, points in rows[:60]:
        want = plain_hull(points)
        if len(want) < 3:
            continue
        ring = [tuple(p) for p in got[i].hull]
        assert set(ring) == want and len(ring) == len(want)
        assert all((b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]) > 0 for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2]))
        least = min(
            (max(x * c + y * s for x, y in points) - min(x * c + y * s for x, y in points)) * (max(y * c - x * s for x, y in points) - min(y * c - x * s for x, y in points))
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]) for c, s in [((bx - ax) / math.hypot(bx - ax, by - ay), (by - ay) / math.hypot(bx - ax, by - ay))]
        )
        assert got[i].b.area == pytest.approx(least)
    box = got[100].b
    assert (round(box.width, 6), round(box.depth, 6), round(box.rotation, 4)) == (3.0, 1.0, round(math.degrees(0.4), 4))
    assert all(got[i].b is None for i in (101, 102, 103, 104))


def test_small_and_repeated_objects_go(spark):
    square = lambda x, y, n: [(float(x + i), float(y + j)) for i in (0, n) for j in (0, n)]
    rows = [(1, 0, square(0, 0, 20)), (1, 1, square(1, 1, 18)), (1, 2, square(60, 0, 9)), (1, 3, square(0, 60, 10)), (1, 4, [(0.0, 90.0), (200.0, 90.0), (200.0, 92.0), (0.0, 92.0)]), (2, 0, square(0, 0, 12))]
    got = drawings.footprints(spark.createDataFrame(rows, "plan long, ord int, points array<struct<x:double,y:double>>")).collect()
    assert {(r.plan, r.ord) for r in got} == {(1, 0), (1, 3), (2, 0)}


def flooded(pixels):
    left, out = set(pixels), []
    while left:
        todo, mine = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            mine.add((x, y))
            near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        out.append(mine)
    return out


def test_bands_of_ink(spark):
    """Components, boxes, medians of columns and shares against a flood of single pixels, on snakes and blots."""
    r, boxes = random.Random(9), []
    for plan in range(6):
        for _ in range(25):
            x, y, w, h = r.randint(0, 60), r.randint(0, 60), r.choice([1, 3, 8, 20]), r.choice([1, 1, 2, 5])
            boxes.append((plan, x, y, x + w, y + h))
    boxes += [(9, 0, 2 * k, 40, 2 * k + 1) for k in range(12)] + [(9, 0 if k % 2 else 38, 2 * k + 1, 2 if k % 2 else 40, 2 * k + 2) for k in range(11)]  # one long snake
    boxes += [(10, 5, 5, 5, 9), (10, 0, 0, 12, 2)]
    pixels = {}
    for plan, x0, y0, x1, y1 in boxes:
        pixels.setdefault(plan, set()).update((x, y) for x in range(x0, x1) for y in range(y0, y1))
    mask = ink.drawn(spark.createDataFrame(boxes, "plan long, x0 int, y0 int, x1 int, y1 int"))
    labelled = {}
    for run in ink.components(mask).collect():
        labelled.setdefault((run.plan, run.label), set()).update((x, run.y) for x in range(run.x0, run.x1))
    want = [(p, c) for p, held in pixels.items() for c in flooded(held)]
    assert sorted((p, sorted(c)) for (p, _), c in labelled.items()) == sorted((p, sorted(c)) for p, c in want)
    expected = []
    for p, c in want:
        xs, ys = [x for x, _ in c], [y for _, y in c]
        x, y, w, h = min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
        if w >= 10 and 2 <= h <= 12 and len(c) / (w * h) >= 0.22:
            middle = statistics.median([xs.count(k) for k in set(xs)])
            expected.append((p, x, y, w, h, float(middle), round(max(0.1, min(1.0, len(c) / (w * h) * min(1.0, w / 30))), 9)))
    got = [(b.plan, b.x, b.y, b.w, b.h, float(b.ink), round(b.confidence, 9)) for b in ink.level_bands(mask, 10.0, 2, 12.0).collect()]
    assert sorted(got) == sorted(expected) and len(expected) > 5
    assert ink.level_bands(mask.limit(0), 10.0, 2, 12.0).count() == 0


def test_closing_and_opening(spark):
    mask = ink.drawn(spark.createDataFrame([(1, 0, 0, 4, 1), (1, 6, 0, 9, 1), (1, 12, 0, 14, 1)], "plan long, x0 int, y0 int, x1 int, y1 int"), gap=2)
    assert sorted((m.x0, m.x1) for m in mask.collect()) == [(0, 9), (12, 14)]
    assert [(m.x0, m.x1) for m in ink.opened(mask, 5).collect()] == [(0, 9)]


ROOMS = {
    1: [(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)],  # an L
    2: [(10, 0), (14, 0), (14, 3), (10, 3)], 3: [(0, 10), (4, 10), (2, 10.3), (0, 14)], 4: [(20, 0), (20.1, 0), (20.1, 3), (20, 3)], 5: [(10.5, 0.5), (12, 0.5), (12, 2), (10.5, 2)],
    6: [(30, 0), (31, 0), (31, 4), (34, 4), (34, 0), (35, 0), (35, 5), (30, 5)],  # a U, whose centroid is outside
}


def gap(x, y, ring):
    """Distance to the ring's sides, below 0 outside."""
    odd, least = False, math.inf
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        least = min(least, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    return least if odd else -least


@pytest.fixture(scope="module")
def rooms(spark):
    return spark.createDataFrame([(1, k, [tuple(map(float, c)) for c in ring]) for k, ring in ROOMS.items()], "plan long, room int, ring array<struct<x:double,y:double>>")


def test_safe_points(spark, rooms):
    for p in furnishing.safe_points(furnishing.bounds(rooms)).collect():
        ring = ROOMS[p.room]
        xs, ys = zip(*ring)
        best = max(gap(min(xs) + (max(xs) - min(xs)) * i / 120, min(ys) + (max(ys) - min(ys)) * j / 120, ring) for i in range(1, 120) for j in range(1, 120))
        assert gap(p.sx, p.sy, ring) == pytest.approx(p.clear) and p.clear >= best - 0.03 - 1e-9
        if p.room == 2:
            assert (p.sx, p.sy) == (12.0, 1.5)


def test_fitting(spark, rooms):
    """Every item at the first candidate whose footprint, sampled along its sides, keeps the margin."""
    r = random.Random(12)
    items = [(1, i, r.choice(["bed", "sofa"]), *(r.choice(ROOMS[k := r.choice(list(ROOMS))])[j] + r.uniform(-0.6, 0.6) for j in (0, 1)), r.uniform(0.1, 2), r.uniform(0.1, 2), r.choice([0.0, 30.0, 90.0, 200.0])) for i in range(120)]
    df = spark.createDataFrame(items, "plan long, ord int, category string, x double, y double, w double, d double, rot double")
    got = {p.ord: p for p in furnishing.fit(df, rooms).collect()}
    points = {p.room: p for p in furnishing.safe_points(furnishing.bounds(rooms)).collect()}
    n = 0
    for _, i, _, x, y, w, d, rot in items:
        # rooms that are large enough; the smallest around the item, else the nearest
        held = ROOMS
        size = {k: (max(c[0] for c in ring) - min(c[0] for c in ring), max(c[1] for c in ring) - min(c[1] for c in ring)) for k, ring in held.items()}
        around = [k for k in held if gap(x, y, held[k]) >= -1e-9]
        near = [k for k in held if abs(gap(x, y, held[k])) <= 0.35]
        room = min(around, key=lambda k: (size[k][0] * size[k][1], k)) if around else min(near, key=lambda k: (abs(gap(x, y, held[k])), k)) if near else None
        want = None
        if room is not None and min(size[room]) > 0.16 and points[room].clear > 0.08:
            w0, d0 = (min(own, max(0.2, side - 0.16), max(0.2, side * 0.9)) for own, side in zip((w, d), size[room]))
            c, s = math.cos(math.radians(rot)), math.sin(math.radians(rot))
            for m, q in itertools.product((0.0, 0.2, 0.4, 0.6, 0.8, 1.0), (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)):
                cx, cy, fw, fd = x + (points[room].sx - x) * m, y + (points[room].sy - y) * m, max(0.2, w0 * q), max(0.2, d0 * q)
                edge = [(u * fw / 2, v * fd / 2) for t in range(-40, 41) for u, v in ((t / 40, 1), (t / 40, -1), (1, t / 40), (-1, t / 40))]
                if min(gap(cx + u * c - v * s, cy + u * s + v * c, held[room]) for u, v in edge) >= 0.08 - 1e-9:
                    want = (room, cx, cy, fw, fd)
                    break
        found = got.get(i) and (got[i].room, got[i].x, got[i].y, got[i].w, got[i].d)
        assert (found is None) == (want is None) and (found is None or found == pytest.approx(want)), i
        n += want is not None
    assert n > 20 and furnishing.fit(df.limit(0), rooms).count() == 0 and furnishing.fit(df, rooms.limit(0)).count() == 0


def test_first_kept(spark):
    r, items, clashes, want = random.Random(5), [], [], set()
    for plan in range(30):
        n = r.randint(1, 12)
        items += [(plan, i) for i in range(n)]
        mine = {(i, i + 1) for i in range(n - 1)} if plan % 5 == 0 else {tuple(sorted(r.sample(range(n), 2))) for _ in range(r.randint(0, 15))} if n > 1 else set()
        clashes += [(plan, a, b) for a, b in mine] * 2
        kept = []
        for i in range(n):
            if not any((k, i) in mine for k in kept):
                kept.append(i)
        want |= {(plan, i) for i in kept}
    got = furnishing.first_kept(spark.createDataFrame(items, "plan int, ord int"), spark.createDataFrame(clashes, "plan int, early int, late int"))
    assert {tuple(x) for x in got.collect()} == want


def test_dealt_in_order(spark):
    r, rows, want = random.Random(8), [], set()
    for plan in range(30):
        mine = {(t, g): r.choice([0.5, 0.6, r.random()]) for t in range(r.randint(1, 7)) for g in range(6) if r.random() < 0.6}
        rows += [(plan, t, g, v) for (t, g), v in mine.items()]
        used = set()
        for t in sorted({t for t, _ in mine}):
            able = [(-v, g) for (k, g), v in mine.items() if k == t and g not in used]
            if able:
                v, g = min(able)
                used.add(g)
                want.add((plan, t, g, -v))
    given = spark.createDataFrame(rows, "plan int, taker int, given int, value double")
    assert {tuple(x) for x in swings.dealt_in_order(given).select("plan", "taker", "given", "value").collect()} == want
    assert swings.dealt_in_order(given.limit(0)).count() == 0


def test_arcs(spark):
    """A drawn quarter circle is seen from its hinge to one side; a patch of ink on it is not."""
    def pixels(angles, radius=40):
        return {(round(60 + radius * math.cos(math.radians(a / 4))), round(60 + radius * math.sin(math.radians(a / 4)))) for a in angles}

    masks = {1: pixels(range(0, 361)), 2: pixels(range(100, 160)), 3: pixels(range(30, 280)), 4: set()}
    runs = [(p, y, x - 1, x + 2) for p, held in masks.items() for x, y in held]
    mask = ink.drawn(spark.createDataFrame([(p, x0, y, x1, y + 1) for p, y, x0, x1 in runs], "plan long, x0 int, y0 int, x1 int, y1 int"))
    arcs = spark.createDataFrame([(p, 0, side, 60.0, 60.0, 40.0, 2.0, 0.0) for p in masks for side in (1, -1)], "plan long, ord int, side int, cx double, cy double, radius double, dx double, dy double")
    got = {(a.plan, a.side): a.coverage for a in swings.arc_coverage(arcs, mask, 200, 200).collect()}
    assert got[1, 1] == 1.0 and got[2, 1] == 0.0 and 0.6 < got[3, 1] < 1.0 and all(got[p, -1] == 0.0 for p in masks) and got[4, 1] == 0.0
