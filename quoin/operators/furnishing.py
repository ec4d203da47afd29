"""Furniture fitted into rooms: each item's room, the first place and size that fit there, and duplicates dropped.

Rooms are rings of any shape.  An item fits where its turned footprint keeps a margin to every side of the room, so no
room has to be shrunk.  Candidates are rows, and so are a room's sides; what fits is an aggregate over both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import geometry as G
from quoin.functions.text import let
from quoin.plans.bindings import bound
from quoin.registry import query
from quoin.sources.folders import settle

# Metres that an item keeps from its room's sides, that it may be moved into a room, least side and size of what is fitted.
MARGIN, REACH, LEAST_SIDE, LEAST_ROOM = 0.08, 0.35, 0.20, 0.02
# Fifths of the way to the room's safe point and tenths of the size, tried in this order, all sizes at each place.
# Products are divided: 0.9 is not nine tenths, and sizes that should tie would not.
MOVES, SCALES, PART_OF_ROOM = (0, 1, 2, 3, 4, 5), (10, 9, 8, 7, 6, 5), 0.90
# Metres within which the safe point is found; least distance of two items of one kind, and its share of the smaller side; most items.
TOLERANCE, NEAR, NEAR_PART, MOST = 0.03, 0.25, 0.55, 100
#: Slack of comparisons: touching counts.
SLACK = 1e-9


def sides(rooms: DataFrame) -> DataFrame:
    """(plan, room, x1, y1, x2, y2): the sides of rooms (plan, room, ring)."""
    pairs = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = rooms.where("size(ring) >= 3").select("plan", "room", F.explode(pairs).alias("e"))
    return each.select("plan", "room", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def _crossed(px: Column, py: Column) -> Column:
    """1 if a ray to the right of the point meets the side (x1, y1)-(x2, y2): odd sums are inside."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    at = F.try_divide((x2 - x1) * (py - y1), y2 - y1) + x1
    return F.when(((y1 > py) != (y2 > py)) & (px < at), 1).otherwise(0)


def _to_side(px: Column, py: Column) -> Column:
    """Distance of a point to the side (x1, y1)-(x2, y2)."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    length = (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)
    t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1), length))), F.lit(0.0))
    return G.distance(px, py, x1 + t * (x2 - x1), y1 + t * (y2 - y1))


def bounds(rooms: DataFrame) -> DataFrame:
    """rooms with left, bottom, width, depth and area; rings of under three corners or LEAST_ROOM don't count."""
    of = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    out = rooms.where("size(ring) >= 3").withColumns({"left": of(F.array_min, "x"), "bottom": of(F.array_min, "y"), "right": of(F.array_max, "x"), "top": of(F.array_max, "y"), "area": G.area(F.col("ring"))})
    return out.withColumns({"width": F.col("right") - F.col("left"), "depth": F.col("top") - F.col("bottom")}).where(F.col("area") > LEAST_ROOM)


def safe_points(rooms: DataFrame) -> DataFrame:
    """(plan, room, sx, sy, clear): the point of each room (of bounds) farthest from its sides, within TOLERANCE.

    The ring's centroid is tried first; where nothing can be better by more than TOLERANCE (as in a rectangle) it stays.
    Other rooms are covered with square cells; a round takes the best middle of all cells of a room and splits the cells
    that could still hold a better point, until there are none.
    """
    side = settle(sides(rooms), "sides")

    def measured(points: DataFrame) -> DataFrame:
        """points (plan, room, x, y, half) with their distance to the sides, below 0 outside."""
        met = points.join(side, ["plan", "room"])
        found = met.groupBy("plan", "room", "x", "y", "half").agg(F.min(_to_side(F.col("x"), F.col("y"))).alias("d"), (F.sum(_crossed(F.col("x"), F.col("y"))) % 2).alias("odd"))
        return found.withColumn("d", F.when(F.col("odd") == 1, F.col("d")).otherwise(-F.col("d"))).drop("odd")

    cross = F.zip_with("ring", F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)), lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("w"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    mean = lambda c: F.try_divide(F.aggregate(cross, F.lit(0.0), lambda t, v: t + v["w"] * v[c]), 3 * F.aggregate(cross, F.lit(0.0), lambda t, v: t + v["w"]))
    first = measured(rooms.select("plan", "room", mean("x").alias("x"), mean("y").alias("y"), F.lit(0.0).alias("half")))
    best = settle(first.select("plan", "room", F.struct("d", "x", "y").alias("best")), "centres")
    most = F.least("width", "depth") / 2
    open_rooms = rooms.join(best, ["plan", "room"]).where(most - F.col("best.d") > TOLERANCE)
    size = F.least("width", "depth")
    grid = lambda low, n: F.explode(F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), lambda i: low + (i + 0.5) * size))
    cells = open_rooms.withColumn("x", grid(F.col("left"), F.col("width"))).withColumn("y", grid(F.col("bottom"), F.col("depth"))).select("plan", "room", "x", "y", (size / 2).alias("half"))
    while not cells.isEmpty():
        seen = settle(measured(cells), "cells")
        better = seen.groupBy("plan", "room").agg(F.max(F.struct("d", "x", "y")).alias("top"))
        best = settle(best.join(better, ["plan", "room"], "left").select("plan", "room", F.when(F.col("top.d") > F.col("best.d"), F.col("top")).otherwise(F.col("best")).alias("best")), "best")
        hopeful = seen.join(best, ["plan", "room"]).where(F.col("d") + F.col("half") * 2**0.5 - F.col("best.d") > TOLERANCE)
        quarter = F.array(*[F.struct((F.col("x") + i * F.col("half") / 2).alias("x"), (F.col("y") + j * F.col("half") / 2).alias("y")) for i in (-1, 1) for j in (-1, 1)])
        cells = hopeful.select("plan", "room", F.explode(quarter).alias("q"), (F.col("half") / 2).alias("half")).select("plan", "room", "q.x", "q.y", "half")
    return best.select("plan", "room", F.col("best.x").alias("sx"), F.col("best.y").alias("sy"), F.col("best.d").alias("clear"))


def rooms_of(items: DataFrame, rooms: DataFrame) -> DataFrame:
    """(plan, ord, room): the smallest room around an item's middle, or else the nearest within REACH; others have none."""
    x, y = F.col("x"), F.col("y")
    near = items.select("plan", "ord", "x", "y").join(rooms.select("plan", "room", "left", "bottom", "right", "top", (F.col("width") * F.col("depth")).alias("box")), "plan")
    near = near.where(x.between(F.col("left") - REACH, F.col("right") + REACH) & y.between(F.col("bottom") - REACH, F.col("top") + REACH))
    met = near.join(sides(rooms), ["plan", "room"]).groupBy("plan", "ord", "room", "box").agg(F.min(_to_side(x, y)).alias("d"), (F.sum(_crossed(x, y)) % 2).alias("odd"))
    within = (F.col("odd") == 1) | (F.col("d") <= SLACK)
    choice = F.when(within, F.struct(F.lit(0).alias("k"), F.col("box").alias("by"), "room")).when(F.col("d") <= REACH, F.struct(F.lit(1).alias("k"), F.col("d").alias("by"), "room"))
    return met.groupBy("plan", "ord").agg(F.min(choice).alias("c")).where("c is not null").select("plan", "ord", "c.room")


def fit(items: DataFrame, rooms: DataFrame) -> DataFrame:
    """Items (plan, ord, category, x, y, w, d, rot) with their room, at the first place and size of the candidates that fit.

    Candidates go from the item's middle to its room's safe point in MOVES and at each place through SCALES; sides don't
    fall below LEAST_SIDE.  Items without a room, or for which nothing fits, are left out.  Rooms (plan, room, ring) with
    no more than twice the margin to spare take nothing.
    """
    rooms = settle(bounds(rooms), "rooms")
    usable = rooms.join(safe_points(rooms), ["plan", "room"]).where((F.col("width") > 2 * MARGIN) & (F.col("depth") > 2 * MARGIN) & (F.col("clear") > MARGIN))
    mine = items.join(rooms_of(items, rooms), ["plan", "ord"]).join(usable.select("plan", "room", "sx", "sy", "left", "bottom", "right", "top", "width", "depth"), ["plan", "room"])
    side = lambda own, room: F.least(own, F.greatest(F.lit(LEAST_SIDE), room - 2 * MARGIN), F.greatest(F.lit(LEAST_SIDE), room * PART_OF_ROOM))
    sized = settle(mine.withColumns({"w0": side(F.col("w"), F.col("width")), "d0": side(F.col("d"), F.col("depth")), "c": F.cos(F.radians("rot")), "s": F.sin(F.radians("rot"))}), "sized")
    tries = F.array(*[F.struct(F.lit(len(SCALES) * i + j).alias("k"), F.lit(m).alias("move"), F.lit(s).alias("scale")) for i, m in enumerate(MOVES) for j, s in enumerate(SCALES)])
    tried = sized.select("*", F.explode(tries).alias("t")).withColumns({
        "cx": F.col("x") + (F.col("sx") - F.col("x")) * F.col("t.move") / 5, "cy": F.col("y") + (F.col("sy") - F.col("y")) * F.col("t.move") / 5,
        "fw": F.greatest(F.lit(LEAST_SIDE), F.col("w0") * F.col("t.scale") / 10), "fd": F.greatest(F.lit(LEAST_SIDE), F.col("d0") * F.col("t.scale") / 10),
    }).select("plan", "ord", "room", F.col("t.k").alias("k"), "cx", "cy", "fw", "fd", "left", "bottom", "right", "top", "c", "s")
    # What does not fit into the room's bounds, turned as it is, needs no further look.
    reach = [(F.abs(F.col(a)) * F.col("fw") + F.abs(F.col(b)) * F.col("fd")) / 2 + MARGIN - SLACK for a, b in (("c", "s"), ("s", "c"))]
    tried = settle(tried.where(F.col("cx").between(F.col("left") + reach[0], F.col("right") - reach[0]) & F.col("cy").between(F.col("bottom") + reach[1], F.col("top") - reach[1])), "tried")
    # In the item's own frame its footprint is a box about 0, and a side of the room a segment.  Rows are few bytes and much
    # work, so they are dealt to all cores, by room, whatever their size.
    spark = items.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = tried.repartition(n, "plan", "room").join(sides(rooms), ["plan", "room"])
    local = {k: ((F.col(f"x{k}") - F.col("cx")) * F.col("c") + (F.col(f"y{k}") - F.col("cy")) * F.col("s"), (F.col(f"y{k}") - F.col("cy")) * F.col("c") - (F.col(f"x{k}") - F.col("cx")) * F.col("s")) for k in (1, 2)}
    frame = F.struct(_crossed(F.col("cx"), F.col("cy")).alias("odd"), *[c.alias(n) for n, c in zip(("ax", "ay", "bx", "by"), (*local[1], *local[2]))], (F.col("fw") / 2).alias("hx"), (F.col("fd") / 2).alias("hy"))
    # Behind a generator, so that the ends' places are not copied into every step of the distance.
    met = met.select("plan", "ord", "room", "k", "cx", "cy", "fw", "fd", F.inline(F.array(frame)))
    gaps = met.select("plan", "ord", "room", "k", F.inline(F.array(F.struct("odd", box_gap().alias("gap")))))
    fitting = gaps.groupBy("plan", "ord", "room", "k").agg(F.min("gap").alias("gap"), F.sum("odd").alias("odd")).where((F.col("gap") >= MARGIN - SLACK) & (F.col("odd") % 2 == 1))
    first = fitting.groupBy("plan", "ord", "room").agg(F.min("k").alias("k")).join(tried, ["plan", "ord", "room", "k"])
    first = first.select("plan", "ord", "room", F.struct("cx", "cy", "fw", "fd").alias("p"))
    return items.drop("x", "y", "w", "d").join(first, ["plan", "ord"]).select("plan", "ord", "room", "category", F.col("p.cx").alias("x"), F.col("p.cy").alias("y"), F.col("p.fw").alias("w"), F.col("p.fd").alias("d"), "rot")


def box_gap() -> Column:
    """Distance of the segment (ax, ay)-(bx, by) to the box of half sides hx, hy about 0; 0 if they meet."""
    ax, ay, bx, by, hx, hy = (F.col(c) for c in ("ax", "ay", "bx", "by", "hx", "hy"))

    def clip(a, b, h):  # the part of the segment, 0 to 1, between -h and h
        p, q = F.try_divide(-h - a, b - a), F.try_divide(h - a, b - a)
        still = F.when(F.abs(a) <= h, 0.0).otherwise(2.0)
        return F.coalesce(F.least(p, q), still), F.coalesce(F.greatest(p, q), F.lit(1.0))

    (x0, x1), (y0, y1) = clip(ax, bx, hx), clip(ay, by, hy)
    meets = F.greatest(x0, y0, F.lit(0.0)) < F.least(x1, y1, F.lit(1.0)) - SLACK
    out = lambda x, y: F.sqrt(F.pow(F.greatest(F.abs(x) - hx, F.lit(0.0)), 2) + F.pow(F.greatest(F.abs(y) - hy, F.lit(0.0)), 2))
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)

    def corner(p):  # one function for all corners: written out four times it would be too long for the JVM to compile
        t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((p["x"] - ax) * (bx - ax) + (p["y"] - ay) * (by - ay), length))), F.lit(0.0))
        return let(t, lambda t: G.distance(p["x"], p["y"], ax + t * (bx - ax), ay + t * (by - ay)))

    corners = F.array(*[F.struct((i * hx).alias("x"), (j * hy).alias("y")) for i in (-1, 1) for j in (-1, 1)])
    return F.when(meets, 0.0).otherwise(F.least(out(ax, ay), out(bx, by), F.array_min(F.transform(corners, corner))))


def first_kept(items: DataFrame, clashes: DataFrame) -> DataFrame:
    """(plan, ord) of the items that stay when they are gone through in order and each that clashes with a kept one goes.

    clashes: (plan, early, late).  A round decides all items whose earlier clashing ones are decided, so rounds are as many
    as the longest chain of clashes; items without clashes never take part.
    """
    clashes = settle(clashes.select("plan", "early", "late").distinct(), "clashes")
    ends = clashes.select("plan", F.explode(F.array("early", "late")).alias("ord")).distinct()
    free = items.select("plan", "ord").join(ends, ["plan", "ord"], "left_anti")
    left, kept = settle(ends, "undecided"), None
    while not left.isEmpty():
        waiting = clashes.join(left.withColumnRenamed("ord", "early"), ["plan", "early"], "left_semi").select("plan", F.col("late").alias("ord")).distinct()
        now = settle(left.join(waiting, ["plan", "ord"], "left_anti"), "kept")
        kept = now if kept is None else kept.unionByName(now)
        beaten = clashes.join(now.withColumnRenamed("ord", "early"), ["plan", "early"], "left_semi").select("plan", F.col("late").alias("ord"))
        left = settle(left.join(now, ["plan", "ord"], "left_anti").join(beaten, ["plan", "ord"], "left_anti"), "undecided")
    return free if kept is None else free.unionByName(kept)


def dedupe(items: DataFrame, same_kind: bool = True, of_both: bool = False, part: float = NEAR_PART, most: int = MOST) -> DataFrame:
    """Items without those that lie too near a kept larger one of the same category; of equally large ones the first stays.

    Too near is less than `part` of the item's shorter side, or (of_both) of the shorter side of both, and NEAR at least.
    Without same_kind any larger item counts.  At most `most` items of a plan stay, the largest.
    """
    place = F.row_number().over(Window.partitionBy("plan").orderBy(F.desc(F.col("w") * F.col("d")), "ord"))
    ranked = settle(items.withColumn("nth", place), "ranked")
    a, b = ranked.alias("a"), ranked.alias("b")
    side = F.least("a.w", "a.d", "b.w", "b.d") if of_both else F.least("b.w", "b.d")
    limit = F.greatest(F.lit(NEAR), side * part)
    kind = F.col("a.category") == F.col("b.category") if same_kind else F.lit(True)
    near = G.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) < limit
    met = a.join(b, (F.col("a.plan") == F.col("b.plan")) & kind & (F.col("a.nth") < F.col("b.nth")) & near)
    clashes = met.select(F.col("a.plan").alias("plan"), F.col("a.ord").alias("early"), F.col("b.ord").alias("late"))
    stays = ranked.join(first_kept(ranked, clashes), ["plan", "ord"])
    nth = F.row_number().over(Window.partitionBy("plan").orderBy("nth"))
    return stays.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def rectangles(rooms: DataFrame) -> DataFrame:
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return rooms.select("plan", F.col("ord").alias("room"), F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)).alias("ring"))


@query("fitted_furniture", (161, 191, 294, 295), """
WITH RECURSIVE r AS (SELECT plan, ord AS room, x0, y0, x1, y1, x1-x0 AS rw, y1-y0 AS rd FROM {rooms} WHERE (x1-x0)*(y1-y0) > 0.02), f AS (SELECT * FROM {furniture}),
n AS (SELECT f.plan, f.ord, r.room, rw*rd AS box, sqrt(greatest(x0-x, x-x1, 0)*greatest(x0-x, x-x1, 0) + greatest(y0-y, y-y1, 0)*greatest(y0-y, y-y1, 0)) AS away FROM f JOIN r ON r.plan = f.plan),
o AS (SELECT plan, ord, room FROM n WHERE away <= 0.35 QUALIFY row_number() OVER (PARTITION BY plan, ord ORDER BY CASE WHEN away = 0 THEN 0 ELSE 1 END, CASE WHEN away = 0 THEN box ELSE away END, room) = 1),
s AS (SELECT f.*, r.*, least(w, greatest(0.2e0, rw - 0.16e0), greatest(0.2e0, rw*0.9e0)) AS w0, least(d, greatest(0.2e0, rd - 0.16e0), greatest(0.2e0, rd*0.9e0)) AS d0, (x0+x1)/2 AS sx, (y0+y1)/2 AS sy
 FROM f JOIN o ON o.plan = f.plan AND o.ord = f.ord JOIN r ON r.plan = o.plan AND r.room = o.room WHERE rw > 0.16e0 AND rd > 0.16e0),
t AS (SELECT plan, ord, room, category, rot, m*6 + q AS k, x + (sx-x)*CAST(m AS DOUBLE)/5 AS cx, y + (sy-y)*CAST(m AS DOUBLE)/5 AS cy, greatest(0.2e0, w0*(10-q)/10) AS fw, greatest(0.2e0, d0*(10-q)/10) AS fd, x0, y0, x1, y1 FROM s, range(0, 6) a(m), range(0, 6) b(q)),
e AS (SELECT *, abs(cos(radians(rot)))*fw/2 + abs(sin(radians(rot)))*fd/2 AS ex, abs(sin(radians(rot)))*fw/2 + abs(cos(radians(rot)))*fd/2 AS ey FROM t),
p AS (SELECT * FROM e WHERE cx-ex >= x0 + 0.08 - 1e-9 AND cx+ex <= x1 - 0.08 + 1e-9 AND cy-ey >= y0 + 0.08 - 1e-9 AND cy+ey <= y1 - 0.08 + 1e-9 QUALIFY row_number() OVER (PARTITION BY plan, ord ORDER BY k) = 1),
i AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY fw*fd DESC, ord) AS nth FROM p),
g AS (SELECT DISTINCT plan, CAST(0 AS BIGINT) AS nth, CAST([] AS STRUCT(c VARCHAR, x DOUBLE, y DOUBLE)[]) AS kept, CAST(NULL AS INTEGER) AS taken FROM i UNION ALL
 SELECT plan, nth, CASE WHEN near THEN kept ELSE list_append(kept, struct_pack(c := category, x := cx, y := cy)) END, CASE WHEN near THEN NULL ELSE ord END
 FROM (SELECT i.*, kept, len(list_filter(kept, lambda h: h.c = i.category AND sqrt((h.x-i.cx)*(h.x-i.cx) + (h.y-i.cy)*(h.y-i.cy)) < greatest(0.25, least(i.fw, i.fd)*0.55))) > 0 AS near FROM g JOIN i ON i.plan = g.plan AND i.nth = g.nth + 1))
SELECT i.plan, i.ord, i.room, i.category, round(cx, 6) + 0.0 AS x, round(cy, 6) + 0.0 AS y, round(fw, 6) AS w, round(fd, 6) AS d FROM g JOIN i ON i.plan = g.plan AND i.ord = g.taken""")
def fitted_furniture(spark, d):
    """Every plan's furniture as it fits into its rooms, without duplicates."""
    placed = dedupe(fit(bound(spark, d, "furniture"), rectangles(bound(spark, d, "rooms"))))
    return placed.select("plan", "ord", "room", "category", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x", "y", "w", "d")])
