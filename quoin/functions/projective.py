"""Homographies as Column expressions: linear systems by elimination, 3 x 3 matrices, guards, the frame of a rectified plan.

Matrices are arrays of rows.  A homography maps (x, y) to the first two of matrix * (x, y, 1), divided by the third.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.functions.text import let

_ROWS = "array<array<double>>"
#: Greatest condition of a matrix, and least denominator, in a frame of unit size; least pivot of a system.
MOST_CONDITION, LEAST_DENOMINATOR, LEAST_PIVOT = 1e8, 1e-8, 1e-14
UNIT = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))


def solve(rows: Column, n: int) -> Column:
    """Unknowns of n equations (rows of n factors and the right side), by elimination with the largest pivot of each column.

    Null for a system without one solution: a pivot below LEAST_PIVOT.
    """

    def eliminated(rows, k):
        size = lambda i: F.struct(F.abs(F.get(F.get(rows, i), k)).alias("size"), (-i).alias("i"))
        best = F.array_max(F.transform(F.sequence(k, F.lit(n - 1)), size))

        def swapped(best):
            p = -best["i"]
            by = F.get(F.get(rows, p), k)
            pivot = F.transform(F.get(rows, p), lambda x: x / by)

            def cleared(pivot):
                other = lambda r, i: F.when(i == p, F.get(rows, k)).otherwise(r)
                less = lambda r: F.zip_with(r, pivot, lambda x, y: x - F.get(r, k) * y)
                return F.transform(rows, lambda r, i: F.when(i == k, pivot).otherwise(let(other(r, i), less)))

            return F.when(best["size"] >= LEAST_PIVOT, let(pivot, cleared))

        return let(best, swapped)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows.cast(_ROWS), lambda state, k: F.when(state.isNotNull(), eliminated(state, k)).cast(_ROWS))
    return F.transform(done, lambda r: F.get(r, F.lit(n)))


def matrix(*entries) -> Column:
    nine = [e if isinstance(e, Column) else F.lit(float(e)) for e in entries]
    return F.array(*[F.array(*nine[3 * i : 3 * i + 3]) for i in range(3)])


def _entry(m: Column, i: int, j: int) -> Column:
    return F.get(F.get(m, F.lit(i)), F.lit(j))


def times(a: Column, b: Column) -> Column:
    return let(a, lambda a: let(b, lambda b: matrix(*[sum((_entry(a, i, k) * _entry(b, k, j) for k in range(1, 3)), _entry(a, i, 0) * _entry(b, 0, j)) for i in range(3) for j in range(3)])))


def adjugate(m: Column) -> Column:
    """The inverse times the determinant, which is the inverse homography."""

    def of(m):
        minor = lambda i, j: _entry(m, (i + 1) % 3, (j + 1) % 3) * _entry(m, (i + 2) % 3, (j + 2) % 3) - _entry(m, (i + 1) % 3, (j + 2) % 3) * _entry(m, (i + 2) % 3, (j + 1) % 3)
        return matrix(*[minor(j, i) for i in range(3) for j in range(3)])

    return let(m, of)


def scaled(m: Column) -> Column:
    """The same homography with 1 in the last place, unless that is near 0: then as it is."""
    return let(m, lambda m: F.when(F.abs(_entry(m, 2, 2)) > 1e-12, F.transform(m, lambda r: F.transform(r, lambda x: x / _entry(m, 2, 2)))).otherwise(m))


def applied(m: Column, x: Column, y: Column) -> Column:
    """Struct(x, y) of the image; null where the denominator is 0."""

    def of(m):
        row = [_entry(m, i, 0) * x + _entry(m, i, 1) * y + _entry(m, i, 2) for i in range(3)]
        return F.when(row[2] != 0, F.struct(F.try_divide(row[0], row[2]).alias("x"), F.try_divide(row[1], row[2]).alias("y")))

    return let(m, of)


def unit_to_corners(corners: Column) -> Column:
    """The homography of the unit square's corners (0, 0), (1, 0), (1, 1), (0, 1) to four points; null if there is none."""

    def of(c):
        rows = []
        for k, (u, v) in enumerate(UNIT):
            x, y = F.get(c, F.lit(k))["x"], F.get(c, F.lit(k))["y"]
            rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x, x], [0, 0, 0, u, v, 1, -u * y, -v * y, y]]
        system = F.array(*[F.array(*[e if isinstance(e, Column) else F.lit(float(e)) for e in row]) for row in rows])
        return let(solve(system, 8), lambda h: F.when(h.isNotNull(), matrix(*[F.get(h, F.lit(k)) for k in range(8)], 1.0)))

    return let(corners, of)


def _size(m: Column) -> Column:
    return F.sqrt(F.aggregate(F.flatten(m), F.lit(0.0), lambda total, x: total + x * x))


def condition(m: Column) -> Column:
    """Product of the sizes (root of the sum of squares) of a matrix and its inverse: 1 to 3 times the spectral condition."""
    det = lambda m, a: _entry(m, 0, 0) * _entry(a, 0, 0) + _entry(m, 0, 1) * _entry(a, 1, 0) + _entry(m, 0, 2) * _entry(a, 2, 0)
    return let(m, lambda m: let(adjugate(m), lambda a: F.try_divide(_size(m) * _size(a), F.abs(det(m, a)))))


def one_sided(m: Column, points: Column) -> Column:
    """Whether no point lies at or near the pole, and all on one side of it."""

    def of(m):
        length = F.sqrt(sum((_entry(m, 2, j) * _entry(m, 2, j) for j in (1, 2)), _entry(m, 2, 0) * _entry(m, 2, 0)))
        far = F.transform(points, lambda p: F.try_divide(_entry(m, 2, 0) * p["x"] + _entry(m, 2, 1) * p["y"] + _entry(m, 2, 2), length))
        return F.forall(far, lambda v: F.coalesce(v > LEAST_DENOMINATOR, F.lit(False))) | F.forall(far, lambda v: F.coalesce(v < -LEAST_DENOMINATOR, F.lit(False)))

    return let(m, of)


def quarter_turn(turns: Column, width: Column, height: Column) -> Column:
    """Pixels of an image turned clockwise by quarters, from pixels of the image."""
    w, h = width.cast("double"), height.cast("double")
    turned = [matrix(1, 0, 0, 0, 1, 0, 0, 0, 1), matrix(0, -1, h, 1, 0, 0, 0, 0, 1), matrix(-1, 0, w, 0, -1, h, 0, 0, 1), matrix(0, 1, 0, -1, 0, w, 0, 0, 1)]
    return F.get(F.array(*turned), F.pmod(turns.cast("int"), F.lit(4)))


def rectified(corners: Column, turns: Column, width: Column, height: Column, out_width: Column, out_height: Column) -> Column:
    """The homography of a source image to the upright rectangle of out_width x out_height that its corners stand for.

    corners (top left, top right, bottom right, bottom left) are pixels of the image turned by `turns` quarters.  Null where
    the corners have no homography, its condition is over MOST_CONDITION, or a corner lies near its pole.
    """
    odd = F.pmod(turns.cast("int"), F.lit(2)) == 1
    w, h = F.when(odd, height).otherwise(width).cast("double"), F.when(odd, width).otherwise(height).cast("double")
    small = F.transform(corners, lambda p: F.struct((p["x"] / w).alias("x"), (p["y"] / h).alias("y")))
    square = F.array(*[F.struct(F.lit(u).alias("x"), F.lit(v).alias("y")) for u, v in UNIT])

    def framed(small):
        def checked(back):
            def placed(unit):
                whole = times(matrix(out_width.cast("double"), 0, 0, 0, out_height.cast("double"), 0, 0, 0, 1), times(unit, matrix(1 / w, 0, 0, 0, 1 / h, 0, 0, 0, 1)))
                sound = (condition(back) <= MOST_CONDITION) & one_sided(unit, small) & one_sided(back, square)
                return F.when(sound, times(whole, quarter_turn(turns, width, height)))

            return F.when(back.isNotNull(), let(scaled(adjugate(back)), placed))

        return let(unit_to_corners(small), checked)

    return let(small, framed)


def analysed(source_to_prepared: Column, x: Column, y: Column, w: Column, h: Column, analysis_width: Column, analysis_height: Column) -> Column:
    """Struct(source_to_analysis, analysis_to_source): on through the crop (x, y, w, h) and its resize; null if the crop is empty."""
    sx, sy = F.try_divide(analysis_width.cast("double"), w), F.try_divide(analysis_height.cast("double"), h)
    crop = matrix(sx, 0, -x * sx, 0, sy, -y * sy, 0, 0, 1)

    def both(m):
        return F.when(m.isNotNull(), F.struct(m.alias("source_to_analysis"), scaled(adjugate(m)).alias("analysis_to_source")))

    return F.when((w > 0) & (h > 0) & (x >= 0) & (y >= 0) & source_to_prepared.isNotNull(), let(scaled(times(crop, source_to_prepared)), both))
