"""Convex hulls and least boxes of point sets, as Column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.functions.text import let

_POINTS = "array<struct<x:double,y:double>>"
#: Turns up to this size, of twice a triangle's area, count as straight.
STRAIGHT = 1e-9
#: Points that are boxed at a time.
POINTS = 1 << 17


def hull(points: Column) -> Column:
    """Corners of the convex hull, counter-clockwise from the leftmost; corners on a straight side are left out.

    The lower chain from left to right, then the upper one back.  A chain is convex, so the corners that a new point hides
    are a run at its end: a filter takes them off.
    """

    def chain(ordered):
        def add(held, p):
            hidden = lambda v, j: (F.get(held, j - 1)["x"] - v["x"]) * (p["y"] - v["y"]) - (F.get(held, j - 1)["y"] - v["y"]) * (p["x"] - v["x"]) >= -STRAIGHT
            return F.concat(F.filter(held, lambda v, j: (j == 0) | ~hidden(v, j)), F.array(p)).cast(_POINTS)

        whole = F.aggregate(ordered, F.array().cast(_POINTS), add)
        return F.slice(whole, F.lit(1), F.greatest(F.size(whole) - 1, F.lit(0)))

    def both(ordered):
        return F.when(F.size(ordered) < 3, ordered).otherwise(F.concat(chain(ordered), chain(F.reverse(ordered))))

    known = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return let(F.array_sort(F.array_distinct(known)).cast(_POINTS), both)


def _chains(x, y):
    """Of rows of points in order, the corners of the hull's lower chain but the last: places in the row, and how many."""
    n, m = x.shape
    held, size, row = np.zeros((n, m), np.int64), np.zeros(n, np.int64), np.arange(n)
    for j in range(m):
        px, py = x[:, j], y[:, j]
        top = held[row, size - 1]
        left = np.flatnonzero((size > 1) & ~((x[row, top] == px) & (y[row, top] == py)))
        fresh = (size == 0) | ~((x[row, top] == px) & (y[row, top] == py))
        while len(left):
            v, u = held[left, size[left] - 1], held[left, size[left] - 2]
            vx, vy = x[left, v], y[left, v]
            hidden = (x[left, u] - vx) * (py[left] - vy) - (y[left, u] - vy) * (px[left] - vx) >= -STRAIGHT
            left = left[hidden]
            size[left] -= 1
            left = left[size[left] > 1]
        here = np.flatnonzero(fresh)
        held[here, size[here]] = j
        size[here] += 1
    return held, np.maximum(size - 1, 0)


def _boxes(x, y):
    """Columns area, x, y, width, depth, rotation of the least boxes of rows of points; NaN for points on a line."""
    order = np.lexsort((y, x))
    x, y = np.take_along_axis(x, order, 1), np.take_along_axis(y, order, 1)
    (low, n_low), (high, n_high) = _chains(x, y), _chains(x[:, ::-1], y[:, ::-1])
    n = n_low + n_high
    h = max(int(n.max(initial=0)), 1)
    k = np.arange(h)
    at = np.where(k < n_low[:, None], low[:, np.minimum(k, x.shape[1] - 1)], x.shape[1] - 1 - np.take_along_axis(high, np.clip(k - n_low[:, None], 0, x.shape[1] - 1), 1))
    # Places beyond the ring repeat its first corner, which changes no bounds.
    at = np.where(k < n[:, None], at, at[:, :1])
    x, y = np.take_along_axis(x, at, 1), np.take_along_axis(y, at, 1)
    best = np.full((6, len(x)), np.nan)
    for i in range(h):
        mine = np.flatnonzero((i < n) & (n >= 3))
        px, py = (x, y) if len(mine) == len(x) else (x[mine], y[mine])
        on, row = np.where(i + 1 < n[mine], min(i + 1, h - 1), 0), np.arange(len(mine))
        dx, dy = px[row, on] - px[:, i], py[row, on] - py[:, i]
        length = np.sqrt(dx * dx + dy * dy)
        with np.errstate(invalid="ignore", divide="ignore"):
            ux, uy = dx / length, dy / length
        forward, side = px * ux[:, None] + py * uy[:, None], py * ux[:, None] - px * uy[:, None]
        f0, f1, s0, s1 = forward.min(1), forward.max(1), side.min(1), side.max(1)
        w, d, mf, ms = f1 - f0, s1 - s0, (f1 + f0) / 2, (s1 + s0) / 2
        angle = np.degrees(np.arctan2(uy, ux))
        square = np.abs(w - d) <= 1e-6 * np.maximum(w, d)
        rotation = np.where(square, np.mod(np.round(angle, 6), 90.0), np.mod(np.round(np.where(w >= d, angle, angle + 90), 6), 180.0))
        found = np.stack([w * d, mf * ux - ms * uy, mf * uy + ms * ux, np.maximum(w, d), np.minimum(w, d), rotation])
        known = best[:, mine]
        better, tied = np.isnan(known[0]), ~np.isnan(known[0])
        for new, held in zip(found, known):
            better, tied = better | (tied & (new < held)), tied & (new == held)
        best[:, mine[better]] = found[:, better]
    return best


def _least(points: pa.Array) -> pa.Array:
    n = len(points)
    corner, of = points.flatten(), pc.list_parent_indices(points).to_numpy()
    x, y = (pc.struct_field(corner, c).to_numpy(zero_copy_only=False) for c in "xy")
    known = ~(np.isnan(x) | np.isnan(y))
    x, y, of = x[known], y[known], of[known]
    sizes = np.bincount(of, minlength=n)
    starts, out = np.cumsum(sizes) - sizes, np.full((6, n), np.nan)
    for m in np.unique(sizes[sizes >= 3]):
        rows = np.flatnonzero(sizes == m)
        for mine in np.array_split(rows, -(-len(rows) * m // POINTS)):
            at = starts[mine, None] + np.arange(m)
            out[:, mine] = _boxes(x[at], y[at])
    names = ["area", "x", "y", "width", "depth", "rotation"]
    return pa.StructArray.from_arrays([pa.array(v) for v in out], names=names, mask=pa.array(np.isnan(out[0])))


def least_box(points: Column) -> Column:
    """Struct(area, x, y, width, depth, rotation) of the smallest box around the points: one of its sides lies on a side of
    the hull.  width is the longer side and rotation its direction in degrees, 0 to 180 (of a square, 0 to 90).  Null for
    points on a line.  Rows of equally many points are boxed side by side.
    """
    return F.arrow_udf(_least, "area double, x double, y double, width double, depth double, rotation double")(points)
