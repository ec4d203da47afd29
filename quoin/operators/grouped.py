"""Order-dependent operators of one plan: greedy and maximum matching, suppression, gap walks, merging, routes.

Each runs as an Arrow-batched function for each plan; a plan is one document, and its elements fit in a task.  Elements
are taken in list order, so results don't depend on how rows were dealt.
"""

from __future__ import annotations

import collections
import functools
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.operators.bands import best_first
from quoin.operators.furnishing import dedupe
from quoin.plans.bindings import bound
from quoin.registry import query

# Fixed value: share of their union that two rooms have in common if they match.
ROOM_SHARE = 0.5


class Part:
    """The rows of one plan: a stretch of a batch's columns, each taken from the frame once a batch."""

    def __init__(self, columns: dict[str, np.ndarray], low: int, high: int):
        self.columns, self.low, self.high = columns, low, high

    def __len__(self) -> int:
        return self.high - self.low

    def __getitem__(self, name):
        if isinstance(name, str):
            return self.columns[name][self.low : self.high]
        return Part({n: self.columns[n] for n in name}, self.low, self.high)

    def itertuples(self, index: bool = False, name: str | None = "Row"):
        rows = zip(*[c[self.low : self.high].tolist() for c in self.columns.values()])
        return rows if name is None else map(_row_class(tuple(self.columns))._make, rows)


@functools.cache
def _row_class(names: tuple[str, ...]):
    return collections.namedtuple("Row", names)


def per_plan(rows: DataFrame, f, schema: str) -> DataFrame:
    """f(Part of one plan in list order) -> list of tuples after the plan's key.

    Plans lie side by side in sorted partitions and stream through Arrow batches; a call for each plan, not a task's
    set-up for each, and no more than a batch and a plan in memory.  The numbering asks for rows dealt and sorted by
    plan, so rows that are dealt so already are not shuffled again.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        held = None
        for batch in batches:
            batch = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
            plans = batch["plan"].to_numpy()
            columns = {c: batch[c].to_numpy() for c in batch.columns}
            starts = [0, *(np.flatnonzero(plans[1:] != plans[:-1]) + 1).tolist()]
            out = []
            for low, high in zip(starts, starts[1:]):
                out += [(plans[low], *x) for x in f(Part(columns, low, high))]
            held = batch.iloc[starts[-1] :]
            yield pd.DataFrame(out, columns=names)
        if held is not None and len(held):
            columns = {c: held[c].to_numpy() for c in held.columns}
            yield pd.DataFrame([(columns["plan"][0], *x) for x in f(Part(columns, 0, len(held)))], columns=names)

    in_order = F.row_number().over(Window.partitionBy("plan").orderBy("ord"))
    return rows.where("plan is not null").withColumn("nth", in_order).mapInPandas(run, schema)


def most_pairs(edges: list[tuple]) -> list[tuple]:
    """A maximum-cardinality matching by augmenting paths; of a node's edges the best (lowest score) is tried first."""
    near: dict = {}
    for score, a, b in sorted(edges):
        near.setdefault(a, []).append(b)
    owner: dict = {}
    for root in near:
        # A walk of (node, its untried neighbours); what it has passed is taken over from the end when a free one is met.
        walk, passed, seen = [(root, iter(near[root]))], [], set()
        while walk:
            b = next((b for b in walk[-1][1] if b not in seen), None)
            if b is None:
                walk.pop()
                passed = passed[: max(0, len(walk) - 1)]
                continue
            seen.add(b)
            passed.append(b)
            if b not in owner:
                for (a, _), taken in zip(walk, passed):
                    owner[taken] = a
                break
            walk.append((owner[b], iter(near[owner[b]])))
    return sorted((a, b) for b, a in owner.items())


def line_gaps(walls: list[tuple], tolerance: float) -> list[tuple]:
    """(first, second, start, end) of gaps between collinear walls.

    walls: (ord, line coordinate, from, to) of one orientation.  A wall joins the nearest group whose running mean
    coordinate is in reach; inside a group the wall that reaches farthest so far ends the covered part.
    """
    groups: list[list[tuple]] = []
    for wall in sorted(walls, key=lambda w: w[1]):
        means = [(abs(wall[1] - sum(w[1] for w in g) / len(g)), -i) for i, g in enumerate(groups)]
        near = min((m for m in means if m[0] <= tolerance), default=None)
        if near is None:
            groups.append([wall])
        else:
            groups[-near[1]].append(wall)
    out = []
    for group in groups:
        first, *rest = sorted(group, key=lambda w: w[2])
        for wall in rest:
            if wall[2] - first[3] > 1e-6:
                out.append((first[0], wall[0], first[3], wall[2]))
                first = wall
            elif wall[3] > first[3]:
                first = wall
    return out


def gaps(walls: DataFrame, tolerance: float) -> DataFrame:
    def run(part):
        out = []
        for flat in (True, False):
            mine = []
            for w in part.itertuples():
                if (abs(w.x2 - w.x1) >= abs(w.y2 - w.y1)) == flat:
                    span = (w.x1, w.x2) if flat else (w.y1, w.y2)
                    mine.append((w.ord, ((w.y1 + w.y2) if flat else (w.x1 + w.x2)) / 2, min(span), max(span)))
            out += [(a, b, flat, s, e) for a, b, s, e in line_gaps(mine, tolerance)]
        return out

    return per_plan(walls, run, "plan long, wall_a int, wall_b int, horizontal boolean, gap_start double, gap_end double")


def merged(walls: list[tuple], reach: float, gap: float) -> list[tuple]:
    """Connected components of walls whose lines and spans are near: (least ord, n, mean line, from, to, thickest)."""
    parent = list(range(len(walls)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = sorted(range(len(walls)), key=lambda i: walls[i][1])
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if walls[j][1] - walls[i][1] > reach:
                break
            if max(walls[i][2], walls[j][2]) - min(walls[i][3], walls[j][3]) <= gap:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups: dict[int, list[tuple]] = {}
    for i, w in enumerate(walls):
        groups.setdefault(find(i), []).append(w)
    return [(min(w[0] for w in g), len(g), sum(w[1] for w in g) / len(g), min(w[2] for w in g), max(w[3] for w in g), max(w[4] for w in g)) for g in groups.values()]


def breadth_first(free: set, start: tuple) -> dict:
    """Steps from start to every free cell, four neighbours."""
    if start not in free:
        return {}
    steps, line = {start: 0}, [start]
    for x, y in line:
        for cell in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if cell in free and cell not in steps:
                steps[cell] = steps[x, y] + 1
                line.append(cell)
    return steps


def nearest_free(free: set, wanted: tuple, reach: int) -> tuple | None:
    """The first free cell in rings of growing Manhattan distance; +x, -x, +y, -y first."""
    seen, ring = {wanted}, [wanted]
    for _ in range(reach + 1):
        for cell in ring:
            if cell in free:
                return cell
        following = []
        for x, y in ring:
            for cell in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if cell not in seen:
                    seen.add(cell)
                    following.append(cell)
        ring = following
    return None


def a_star(free: set, start: tuple, goal: tuple) -> list[tuple] | None:
    """A shortest path of four-neighbour steps; ties by (f, g, cell)."""
    if start not in free or goal not in free:
        return None
    ahead = lambda c: abs(c[0] - goal[0]) + abs(c[1] - goal[1])
    heap, cost, came = [(ahead(start), 0, start)], {start: 0}, {}
    while heap:
        _, g, cell = heapq.heappop(heap)
        if cell == goal:
            path = [cell]
            while cell in came:
                cell = came[cell]
                path.append(cell)
            return path[::-1]
        if g > cost[cell]:
            continue
        x, y = cell
        for other in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if other in free and g + 1 < cost.get(other, 1 << 60):
                cost[other], came[other] = g + 1, cell
                heapq.heappush(heap, (g + 1 + ahead(other), g + 1, other))
    return None


def pulled(path: list[tuple], visible) -> list[tuple]:
    """From each kept point on to the farthest later point that it sees."""
    out, i = path[:1], 0
    while i < len(path) - 1:
        j = next((j for j in range(len(path) - 1, i, -1) if visible(path[i], path[j])), i + 1)
        out.append(path[j])
        i = j
    return out


SIDE = 16


def blocked_cells(part) -> set:
    return {(int(a), int(b)) for a, b in zip(part["gx"], part["gy"])}


def _grid(spark, d):
    """Blocked cells of a grid, one for each line of a part."""
    cell = lambda c: (c % SIDE).cast("int")
    gx, gy = cell(F.col("l_suppkey") * 5 + F.col("l_linenumber")), cell(F.col("l_suppkey") + F.col("l_quantity").cast("int") + F.col("l_linenumber") * 7)
    return bound(spark, d, "lineitem").select(F.col("l_partkey").alias("plan"), gx.alias("gx"), gy.alias("gy")).distinct().withColumn("ord", F.col("gx") * SIDE + F.col("gy"))


def _free(part) -> set:
    return {(x, y) for x in range(SIDE) for y in range(SIDE)} - blocked_cells(part) | {(0, 0)}


@query("greedy_match", (119,), """
WITH RECURSIVE c AS (SELECT a.plan, a.ord AS hint, b.ord AS item, round((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), 9) AS score FROM {furniture} a JOIN {furniture} b ON a.plan = b.plan AND a.ord % 2 = 1 AND b.ord % 2 = 0 AND abs(a.x-b.x) <= 2 AND abs(a.y-b.y) <= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY score, hint, item) AS n FROM c),
g AS (SELECT DISTINCT plan, CAST(0 AS BIGINT) AS n, CAST([] AS INTEGER[]) AS used, CAST(NULL AS INTEGER) AS hint, CAST(NULL AS INTEGER) AS item, CAST(NULL AS DOUBLE) AS score FROM o UNION ALL
 SELECT o.plan, o.n, CASE WHEN list_has_any(used, [o.hint, o.item]) THEN used ELSE list_concat(used, [o.hint, o.item]) END, CASE WHEN NOT list_has_any(used, [o.hint, o.item]) THEN o.hint END, o.item, o.score FROM g JOIN o ON o.plan = g.plan AND o.n = g.n + 1)
SELECT plan, hint, item, score FROM g WHERE hint IS NOT NULL""")
def greedy_match(spark, d):
    """Hints (odd places) to footprints (even places) of a plan, nearest first, each used once."""
    f = bound(spark, d, "furniture").select("plan", "ord", "x", "y")
    a, b = f.where("ord % 2 = 1").alias("a"), f.where("ord % 2 = 0").alias("b")
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    near = a.join(b, (F.col("a.plan") == F.col("b.plan")) & (F.abs(dx) <= 2) & (F.abs(dy) <= 2))
    # Places and distances below 0: the best pair is the nearest one, of equal ones that of the smaller places.
    pairs = near.select(F.col("a.plan").alias("plan"), (-F.col("a.ord")).alias("a"), (-F.col("b.ord")).alias("b"), (-F.round(dx * dx + dy * dy, 9)).alias("score"))
    return best_first(pairs).select("plan", (-F.col("a")).alias("hint"), (-F.col("b")).alias("item"), (-F.col("score")).alias("score"))


@query("maximum_match", (120,), None)
def maximum_match(spark, d):
    """As many one-to-one pairs as there can be between odd and even rooms that overlap by half their union."""

    def run(part):
        rows = list(part.itertuples())
        edges = []
        for a in rows:
            for b in rows:
                if a.ord % 2 and not b.ord % 2:
                    both = max(0, min(a.x1, b.x1) - max(a.x0, b.x0)) * max(0, min(a.y1, b.y1) - max(a.y0, b.y0))
                    union = (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - both
                    if both / union >= ROOM_SHARE:
                        edges.append((-both / union, int(a.ord), int(b.ord)))
        return most_pairs(edges)

    return per_plan(bound(spark, d, "rooms"), run, "plan long, a int, b int")


_KEPT = """WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY w*d DESC, ord) AS nth FROM {{furniture}}),
g AS (SELECT DISTINCT plan, CAST(0 AS BIGINT) AS nth, CAST([] AS STRUCT(c VARCHAR, x DOUBLE, y DOUBLE, s DOUBLE)[]) AS kept, CAST(NULL AS INTEGER) AS taken FROM i UNION ALL
 SELECT plan, nth, CASE WHEN near OR len(kept) = {most} THEN kept ELSE list_append(kept, struct_pack(c := category, x := x, y := y, s := least(w, d))) END, CASE WHEN near OR len(kept) = {most} THEN NULL ELSE ord END
 FROM (SELECT i.*, kept, len(list_filter(kept, lambda h: {kind} AND sqrt((h.x-i.x)*(h.x-i.x) + (h.y-i.y)*(h.y-i.y)) < greatest(0.25, {side}))) > 0 AS near FROM g JOIN i ON i.plan = g.plan AND i.nth = g.nth + 1))
SELECT plan, taken AS ord FROM g WHERE taken IS NOT NULL"""


@query("suppress_fit", (161, 191), _KEPT.format(most=100, kind="h.c = i.category", side="least(i.w, i.d)*0.55"))
def suppress_fit(spark, d):
    """Furniture less what lies too near a kept larger piece of its kind."""
    return dedupe(bound(spark, d, "furniture")).select("plan", "ord")


@query("suppress_detect", (162,), _KEPT.format(most=80, kind="true", side="least(h.s, i.w, i.d)*0.5"))
def suppress_detect(spark, d):
    """Detected pieces less what lies too near a kept larger one of any kind, by the shorter side of both."""
    return dedupe(bound(spark, d, "furniture"), same_kind=False, of_both=True, part=0.5, most=80).select("plan", "ord")


@query("merge_collinear", (142, 143, 144), None)
def merge_collinear(spark, d):
    """Walls of an orientation whose lines are within .2 m and spans within .15 m, as one wall each."""

    def run(part):
        out = []
        for flat in (True, False):
            mine = []
            for w in part.itertuples():
                if (abs(w.x2 - w.x1) >= abs(w.y2 - w.y1)) == flat:
                    span = (w.x1, w.x2) if flat else (w.y1, w.y2)
                    mine.append((int(w.ord), ((w.y1 + w.y2) if flat else (w.x1 + w.x2)) / 2, min(span), max(span), w.thickness))
            out += [(a, n, flat, c, s, e, t) for a, n, c, s, e, t in merged(mine, 0.2, 0.15)]
        return out

    return per_plan(bound(spark, d, "walls"), run, "plan long, ord int, n int, horizontal boolean, line double, s double, e double, thickness double")


@query("grid_distance", (235, 237), """
WITH RECURSIVE w AS (SELECT l_partkey AS plan, list(DISTINCT CAST((l_suppkey*5 + l_linenumber) % 16 * 16 + (l_suppkey + CAST(l_quantity AS INTEGER) + l_linenumber*7) % 16 AS INTEGER)) AS walls FROM lineitem GROUP BY l_partkey),
b AS (SELECT plan, walls, CAST(0 AS INTEGER) AS steps, [CAST(0 AS BIGINT)] AS edge, [CAST(0 AS BIGINT)] AS seen FROM w UNION ALL
 SELECT plan, walls, steps + 1, n, list_concat(seen, n) FROM (SELECT *, list_distinct(list_filter(flatten(list_transform(edge, lambda c: [CASE WHEN c >= 16 THEN c - 16 END, CASE WHEN c < 240 THEN c + 16 END, CASE WHEN c % 16 > 0 THEN c - 1 END, CASE WHEN c % 16 < 15 THEN c + 1 END])),
  lambda c: c IS NOT NULL AND NOT list_contains(walls, c) AND NOT list_contains(seen, c))) AS n FROM b) WHERE len(n) > 0)
SELECT plan, CAST(c // 16 AS INTEGER) AS gx, CAST(c % 16 AS INTEGER) AS gy, steps FROM (SELECT plan, steps, unnest(edge) AS c FROM b)""")
def grid_distance(spark, d):
    """Steps from the corner to every free cell that can be reached."""
    return per_plan(_grid(spark, d), lambda part: [(x, y, n) for (x, y), n in sorted(breadth_first(_free(part), (0, 0)).items())], "plan long, gx int, gy int, steps int")


@query("grid_route", (187, 238, 335), None)
def grid_route(spark, d):
    """A route across the grid between the free cells nearest to two corners, then pulled straight along free lines."""

    def run(part):
        free = _free(part)
        a, b = nearest_free(free, (0, 0), 20), nearest_free(free, (SIDE - 1, SIDE - 1), 20)
        path = a_star(free, a, b) if a and b else None
        if path is None:
            return []

        def visible(p, q):
            n = 2 * max(abs(p[0] - q[0]), abs(p[1] - q[1])) or 1
            return all((round(p[0] + (q[0] - p[0]) * i / n), round(p[1] + (q[1] - p[1]) * i / n)) in free for i in range(n + 1))

        short = pulled(path, visible)
        return [(i, x, y, len(path) - 1) for i, (x, y) in enumerate(short)]

    return per_plan(_grid(spark, d), run, "plan long, step int, gx int, gy int, length int")


@query("tour_nearest_first", (192,), """
WITH RECURSIVE r AS (SELECT plan, list(struct_pack(o := ord, x := (x0+x1)/2, y := (y0+y1)/2)) AS rooms FROM {rooms} GROUP BY plan),
t AS (SELECT plan, -1 AS stop, rooms, 0e0 AS x, 0e0 AS y, CAST(NULL AS INTEGER) AS room FROM r UNION ALL
 SELECT plan, stop + 1, list_filter(rooms, lambda v: v.o <> b.o), b.x, b.y, b.o FROM (SELECT plan, stop, rooms, list_sort(list_transform(rooms, lambda v: struct_pack(d := (v.x-x)*(v.x-x) + (v.y-y)*(v.y-y), o := v.o, x := v.x, y := v.y)))[1] AS b FROM t WHERE len(rooms) > 0))
SELECT plan, stop, room FROM t WHERE stop >= 0""")
def tour_nearest_first(spark, d):
    """Rooms in the order of a walk that goes to the nearest unvisited middle each time."""

    def run(part):
        left = [(int(r.ord), (r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2) for r in part.itertuples()]
        at, out = (0.0, 0.0), []
        while left:
            room = min(left, key=lambda r: ((r[1] - at[0]) ** 2 + (r[2] - at[1]) ** 2, r[0]))
            left.remove(room)
            out.append((len(out), room[0]))
            at = room[1:]
        return out

    return per_plan(bound(spark, d, "rooms"), run, "plan long, stop int, room int")
