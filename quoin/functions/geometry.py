"""Plane geometry as Column expressions; all stay inside generated code.  Coordinates are metres unless marked px."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grid, snap angle and its axes, least length that is not a point.
GRID_M, SNAP_DEGREES, POINT_M = 0.05, 7.0, 1e-6


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def horizontal(x1, y1, x2, y2) -> Column:
    return F.abs(x2 - x1) >= F.abs(y2 - y1)


def snap(v, grid: float = GRID_M) -> Column:
    """Nearest multiple of the grid, ties to even."""
    return F.rint(v / grid) * grid


def axis_by_ratio(x1, y1, x2, y2, degrees: float = SNAP_DEGREES) -> Column:
    """Struct of ends: near-vertical segments take the mean x, near-horizontal ones the mean y."""
    dx, dy = F.abs(x2 - x1), F.abs(y2 - y1)
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    return (
        F.when(dx < dy * degrees / 45, _ends(mx, y1, mx, y2)).when(dy < dx * degrees / 45, _ends(x1, my, x2, my)).otherwise(_ends(x1, y1, x2, y2))
    )


def axis_by_angle(x1, y1, x2, y2, degrees: float = SNAP_DEGREES) -> Column:
    """Struct of ends: within `degrees` of an axis both ends take the mean of the other coordinate."""
    angle = F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    return (
        F.when((angle <= degrees) | (angle >= 180 - degrees), _ends(x1, my, x2, my))
        .when(F.abs(angle - 90) <= degrees, _ends(mx, y1, mx, y2))
        .otherwise(_ends(x1, y1, x2, y2))
    )


def upward(x1, y1, x2, y2) -> Column:
    """Struct of ends, swapped where the dominant axis descends."""
    down = F.when(horizontal(x1, y1, x2, y2), x1 > x2).otherwise(y1 > y2)
    return F.when(down, _ends(x2, y2, x1, y1)).otherwise(_ends(x1, y1, x2, y2))


def _ends(x1, y1, x2, y2) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def free_offset(px, py, x1, y1, x2, y2) -> Column:
    """Place along the segment's line, not clamped; 0 for a point."""
    length = distance(x1, y1, x2, y2)
    return F.when(length <= POINT_M, 0.0).otherwise(((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / length)


def offset(px, py, x1, y1, x2, y2) -> Column:
    """Place of the nearest point of the segment, from its start."""
    return F.least(F.greatest(free_offset(px, py, x1, y1, x2, y2), F.lit(0.0)), distance(x1, y1, x2, y2))


def at_offset(o, x1, y1, x2, y2) -> Column:
    length = distance(x1, y1, x2, y2)
    t = F.when(length <= POINT_M, 0.0).otherwise(o / length)
    return F.struct((x1 + t * (x2 - x1)).alias("x"), (y1 + t * (y2 - y1)).alias("y"))


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    p = at_offset(offset(px, py, x1, y1, x2, y2), x1, y1, x2, y2)
    return distance(px, py, p["x"], p["y"])


def interval(s, e, at, width) -> Column:
    """An opening's (s, e): as given if both are, else around its offset, else null."""
    half = width / 2
    return F.when(s.isNotNull() & e.isNotNull(), F.struct(s.alias("s"), e.alias("e"))).when(
        at.isNotNull() & width.isNotNull(), F.struct((at - half).alias("s"), (at + half).alias("e"))
    )


def sound_interval(s, e) -> Column:
    """Both ends or neither, and the end after the start."""
    return F.when(s.isNull() & e.isNull(), True).otherwise(F.coalesce(e > s, F.lit(False)))


def _next(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def signed_area(ring: Column) -> Column:
    """Shoelace over an open ring of struct(x, y)."""
    terms = F.zip_with(ring, _next(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(terms, F.lit(0.0), lambda total, t: total + t) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def inside(px, py, ring: Column) -> Column:
    """Even-odd ray cast: an upper or right boundary is outside."""
    crossing = F.zip_with(
        ring,
        _next(ring),
        lambda a, b: ((a["y"] > py) != (b["y"] > py)) & (px < F.try_divide((b["x"] - a["x"]) * (py - a["y"]), b["y"] - a["y"]) + a["x"]),
    )
    return F.size(F.filter(crossing, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def on_boundary(px, py, ring: Column) -> Column:
    touch = F.zip_with(
        ring,
        _next(ring),
        lambda a, b: ((b["x"] - a["x"]) * (py - a["y"]) == (b["y"] - a["y"]) * (px - a["x"]))
        & px.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))
        & py.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])),
    )
    return F.exists(touch, lambda t: t)


def covers(px, py, ring: Column) -> Column:
    """Closed point-in-polygon: the boundary counts."""
    return inside(px, py, ring) | on_boundary(px, py, ring)


def local(px, py, cx, cy, degrees) -> Column:
    """The point in the frame of a footprint at (cx, cy)."""
    a = F.radians(degrees)
    return F.struct(
        ((px - cx) * F.cos(a) + (py - cy) * F.sin(a)).alias("x"), ((py - cy) * F.cos(a) - (px - cx) * F.sin(a)).alias("y")
    )


def in_footprint(px, py, cx, cy, w, d, degrees, margin: float = 0.0) -> Column:
    p = local(px, py, cx, cy, degrees)
    return (F.abs(p["x"]) <= w / 2 + margin) & (F.abs(p["y"]) <= d / 2 + margin)


def footprint(cx, cy, w, d, degrees) -> Column:
    """Ring of a rotated footprint, counter-clockwise from its lower left corner."""
    a = F.radians(degrees)

    def corner(sx, sy):
        x, y = sx * w / 2, sy * d / 2
        return F.struct((cx + x * F.cos(a) - y * F.sin(a)).alias("x"), (cy + x * F.sin(a) + y * F.cos(a)).alias("y"))

    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def box(x0, y0, x1, y1) -> Column:
    """Ring of an upright box, counter-clockwise from its lower left corner."""
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def kelvin_rgb(kelvin) -> Column:
    """Black-body colour of 1000 to 12000 K, each part 0 to 1."""
    t = kelvin / 100.0
    # The published fit's coefficients.
    red = F.when(t <= 66, 255.0).otherwise(329.698727446 * F.pow(F.greatest(t - 60, F.lit(1.0)), F.lit(-0.1332047592)))
    green = F.when(t <= 66, 99.4708025861 * F.log(t) - 161.1195681661).otherwise(288.1221695283 * F.pow(F.greatest(t - 60, F.lit(1.0)), F.lit(-0.0755148492)))
    blue = F.when(t > 66, 255.0).when(t <= 19, 0.0).otherwise(138.5177312231 * F.log(F.greatest(t - 10, F.lit(1.0))) - 305.0447927307)
    return F.struct(*[(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)) / 255).alias(n) for n, v in (("r", red), ("g", green), ("b", blue))])


def crosses(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Proper crossing of two segments: touching and collinear ones don't cross."""

    def side(px, py, qx, qy, rx, ry):
        return (qx - px) * (ry - py) - (qy - py) * (rx - px)

    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)
