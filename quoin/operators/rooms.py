"""From walls to rooms: faces that become rooms, names that carry over, closure of the outline."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.operators import sweeps
from quoin.operators.grouped import line_gaps, per_plan
from quoin.operators.polygons import faces, ring_area
from quoin.operators.swings import dealt_in_order
from quoin.plans.bindings import bound
from quoin.registry import query
from quoin.sources.folders import settle

# Fixed values in square metres and metres: least room, snap of junctions, thickness; shares that count as the same room and as full.
ROOM_LEAST, SNAP, THICKNESS = 0.45, 0.20, 0.12
OVERLAP, FULL_COVER = 0.5, 0.70


def snapped_ends(walls: list[tuple], reach: float = SNAP) -> list[tuple]:
    """Walls (x1, y1, x2, y2, ...) with both ends moved to the nearest other wall within reach; all by the walls as given."""
    out = []
    for i, w in enumerate(walls):
        ends = []
        for x, y in ((w[0], w[1]), (w[2], w[3])):
            best = None
            for j, (x1, y1, x2, y2, *_) in enumerate(walls):
                n = (x2 - x1) ** 2 + (y2 - y1) ** 2
                if j == i or n == 0:
                    continue
                t = min(1.0, max(0.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n))
                px, py = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
                dist = math.hypot(px - x, py - y)
                if dist <= reach and (best is None or dist < best[0]):
                    best = (dist, px, py)
            ends += best[1:] if best and best[0] > 1e-9 else (x, y)
        out.append((*ends, *w[4:]))
    return out


def rooms_of(walls: list[tuple]) -> list[list[tuple]]:
    """Faces of the walls' graph once their ends are snapped and gaps up to SNAP on one line are closed."""
    walls = snapped_ends([w for w in walls if w[0] != w[2] or w[1] != w[3]])
    lines = [w[:4] for w in walls]
    for flat in (True, False):
        a, b, line = (0, 2, 1) if flat else (1, 3, 0)
        mine = [(i, (w[line] + w[line + 2]) / 2, min(w[a], w[b]), max(w[a], w[b])) for i, w in enumerate(walls) if (abs(w[2] - w[0]) >= abs(w[3] - w[1])) == flat]
        for i, j, s, e in line_gaps(mine, max(0.04, min((w[4] for w in walls), default=THICKNESS) * 0.75)):
            if e - s <= SNAP:
                end, start = max((walls[i][:2], walls[i][2:4]), key=lambda p: p[not flat]), min((walls[j][:2], walls[j][2:4]), key=lambda p: p[not flat])
                lines.append((*end, *start))
    return [ring for ring in faces(lines) if ring_area(ring) >= ROOM_LEAST]


WALL = ["x1", "y1", "x2", "y2", "thickness"]


@query("rooms_from_walls", (229,), None)
def rooms_from_walls(spark, d):
    """Rooms as faces of each plan's wall graph, the largest first: corners, area, and its bounds."""

    def run(part):
        out = []
        for i, ring in enumerate(rooms_of(list(part[WALL].itertuples(name=None)))):
            xs, ys = [p[0] for p in ring], [p[1] for p in ring]
            out.append((f"room_{i:03d}", len(ring), ring_area(ring), min(xs), min(ys), max(xs), max(ys)))
        return out

    return per_plan(bound(spark, d, "room_walls"), run, "plan long, id string, corners int, area double, x0 double, y0 double, x1 double, y1 double")


@query("exterior_closure", (153,), None)
def exterior_closure(spark, d):
    """How much of the box about a plan's walls their faces fill, 70 % counting as all."""

    def run(part):
        walls = list(part[WALL].itertuples(name=None))
        xs, ys = [v for w in walls for v in (w[0], w[2])], [v for w in walls for v in (w[1], w[3])]
        box = max((max(xs) - min(xs)) * (max(ys) - min(ys)), 1e-6)
        return [(min(1.0, sum(map(ring_area, rooms_of(walls))) / box / FULL_COVER),)]

    return per_plan(bound(spark, d, "room_walls"), run, "plan long, closure double")


def carried(faces_, rooms) -> DataFrame:
    """(plan, face, room): faces, the largest first, each with the earlier room left over that shares most with it.

    faces_: plan, face, ring, from the largest on; rooms: plan, room, ring.  What counts is the common area's part of the
    smaller one, OVERLAP at least; of equal ones the first room is taken.
    """
    pairs = faces_.select("plan", "face", F.col("ring").alias("a")).join(rooms.select("plan", "room", F.col("ring").alias("b")), "plan")
    edge = lambda r, c, f: f(F.transform(r, lambda p: p[c]))
    near = [(edge("a", c, F.array_min) < edge("b", c, F.array_max)) & (edge("b", c, F.array_min) < edge("a", c, F.array_max)) for c in "xy"]
    pairs = pairs.where(near[0] & near[1]).select(F.struct("plan", "face", "room").alias("plan"), sweeps.laid_over(F.col("a"), F.col("b")))
    area = sweeps.areas(pairs)
    share = F.try_divide(F.col("both"), F.least("first", "second"))
    wishes = area.select("plan.plan", F.col("plan.face").alias("taker"), F.col("plan.room").alias("given"), share.alias("value")).where(F.col("value") >= OVERLAP)
    return dealt_in_order(wishes).select("plan", F.col("taker").alias("face"), F.col("given").alias("room"))


@query("carried_rooms", (117,), None)
def carried_rooms(spark, d):
    """Faces of each plan's walls with the earlier room whose name they keep, if any."""

    def run(part):
        return [(i, [{"x": x, "y": y} for x, y in ring]) for i, ring in enumerate(rooms_of(list(part[WALL].itertuples(name=None))))]

    found = settle(per_plan(bound(spark, d, "room_walls"), run, "plan long, face int, ring array<struct<x:double,y:double>>"), "faces")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
    rooms = bound(spark, d, "rooms").select("plan", F.col("ord").alias("room"), ring.alias("ring"))
    return found.select("plan", "face").join(carried(found, rooms), ["plan", "face"], "left")
