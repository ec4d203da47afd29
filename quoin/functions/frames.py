"""Image frames: crops, turns, affine maps and projective points as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crop_ok(x, y, w, h, width, height) -> Column:
    """A crop of whole pixels inside its image."""
    return (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height)


def padded(x, y, w, h, pad, width, height) -> Column:
    """A region with its padding, clamped to the image: struct(x, y, w, h)."""
    left, top = F.greatest(x - pad, F.lit(0)), F.greatest(y - pad, F.lit(0))
    right, low = F.least(x + w + pad, width), F.least(y + h + pad, height)
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (low - top).alias("h"))


def turned_size(width, height, quarters, degrees) -> Column:
    """Size of the canvas after quarter turns and a fine turn: struct(width, height)."""
    odd = F.pmod(quarters, F.lit(2)) == 1
    w, h = F.when(odd, height).otherwise(width), F.when(odd, width).otherwise(height)
    a = F.radians(degrees)
    c, s = F.abs(F.cos(a)), F.abs(F.sin(a))
    # Fixed value: a hair off before rounding up, so that a turn by nothing keeps its size.
    grown = lambda v: F.ceil(v - 1e-9).cast("long")
    return F.struct(grown(w * c + h * s).alias("width"), grown(w * s + h * c).alias("height"))


def projected(x, y, m: list[list[float]]) -> Column:
    """A point under a 3 x 3 matrix: struct(x, y), null where the denominator vanishes."""
    d = m[2][0] * x + m[2][1] * y + m[2][2]
    row = lambda r: F.try_divide(m[r][0] * x + m[r][1] * y + m[r][2], F.nullif(d, F.lit(0.0)))
    return F.struct(row(0).alias("x"), row(1).alias("y"))


def one_sign(ring: Column, m: list[list[float]]) -> Column:
    """Whether the denominators at all points have one strict sign."""
    d = F.transform(ring, lambda p: m[2][0] * p["x"] + m[2][1] * p["y"] + m[2][2])
    return F.forall(d, lambda v: v > 0) | F.forall(d, lambda v: v < 0)


def convex(ring: Column) -> Column:
    """Whether an open ring turns strictly one way at every corner."""
    after = lambda n: F.concat(F.slice(ring, n + 1, 1000), F.slice(ring, 1, n))
    edges = F.zip_with(ring, after(1), lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    nexts = F.concat(F.slice(edges, 2, 1000), F.slice(edges, 1, 1))
    turns = F.zip_with(edges, nexts, lambda a, b: a["x"] * b["y"] - a["y"] * b["x"])
    return F.forall(turns, lambda t: t > 0) | F.forall(turns, lambda t: t < 0)


def valid_matrix(rows: Column) -> Column:
    """Three rows of three finite numbers."""
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce((F.size(rows) == 3) & F.forall(rows, lambda r: (F.size(r) == 3) & F.forall(r, good)), F.lit(False))
