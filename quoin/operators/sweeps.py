"""Areas of overlaid polygons, whole plans in a task: the slabs of `overlay`, swept in arrays.

`overlay.cells` deals edges and slabs out as rows, which suits few plans of many edges; with millions of small plans its
rows are a hundred times the rings.  Here a plan's rings are one row, and a task sweeps some hundred plans at a time, so
that nothing but the rings is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimals that coordinates keep, as in `overlay`; plans swept and pairs of edges compared at a time.
DECIMALS, PLANS, PAIRS = 9, 250, 1 << 20
AREAS = ("first", "second", "both", "either", "left")


def gathered(rings: DataFrame) -> DataFrame:
    """(plan, rings) from rings (plan, layer, poly, part, ring)."""
    return rings.groupBy("plan").agg(F.collect_list(F.struct("layer", "poly", "part", "ring")).alias("rings"))


def laid_over(a, b):
    """The array `rings` of one plan: ring a as layer 0, ring b as layer 1."""
    each = lambda layer, ring: F.struct(F.lit(layer).alias("layer"), F.lit(0).alias("poly"), F.lit(0).alias("part"), ring.alias("ring"))
    return F.array(each(0, a), each(1, b)).alias("rings")


def steps(counts):
    """0, 1, ... up to each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def edges(rings: pa.Array) -> tuple:
    """(row, layer, polygon, x1, y1, x2, y2) of the edges of rows' rings, left to right; see overlay.edges."""
    each, row = rings.flatten(), pc.list_parent_indices(rings).to_numpy()
    ring = pc.struct_field(each, "ring")
    corner, of = ring.flatten(), pc.list_parent_indices(ring).to_numpy()
    x, y = (np.round(pc.struct_field(corner, c).to_numpy(zero_copy_only=False), DECIMALS) for c in "xy")
    known = ~(np.isnan(x) | np.isnan(y))
    known &= (np.bincount(of[known], minlength=len(row)) >= 3)[of]
    x, y, of = x[known], y[known], of[known]
    last = np.append(of[1:] != of[:-1], True)[: len(of)]
    starts = np.flatnonzero(np.append(True, last[:-1]))[: last.sum()]
    after = np.arange(len(of)) + 1
    after[last] = starts
    u, v = x[after], y[after]
    turned = (u < x) | ((u == x) & (v < y))
    layer, poly = (pc.struct_field(each, c).to_numpy(zero_copy_only=False) for c in ("layer", "poly"))
    order = np.lexsort((poly, layer, row))
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row[order]) != 0) | (np.diff(layer[order]) != 0) | (np.diff(poly[order]) != 0)
    number = np.empty(len(row), np.int64)
    number[order] = np.cumsum(new)
    return row[of], layer[of], number[of], np.where(turned, u, x), np.where(turned, v, y), np.where(turned, x, u), np.where(turned, y, v)


def crossings(row, x1, y1, x2, y2, m, n: int):
    """(row, x) where two edges of a row cross between their ends; a chunk of pairs at a time."""
    later = np.cumsum(np.bincount(row, minlength=n))[row] - np.arange(len(row)) - 1
    out, chunk = [(row[:0], x1[:0])], np.cumsum(later) // PAIRS
    for low, high in zip(*(lambda cut: (cut[:-1], cut[1:]))(np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(row)))):
        i = np.repeat(np.arange(low, high), later[low:high])
        j = i + 1 + steps(later[low:high])
        near = (x1[i] < x2[j]) & (x1[j] < x2[i])
        i, j = i[near], j[near]
        near = (np.minimum(y1[i], y2[i]) <= np.maximum(y1[j], y2[j])) & (np.minimum(y1[j], y2[j]) <= np.maximum(y1[i], y2[i])) & (np.abs(m[i] - m[j]) > 1e-12)
        i, j = i[near], j[near]
        x = np.round(x1[i] + (y1[j] + (x1[i] - x1[j]) * m[j] - y1[i]) / (m[i] - m[j]), DECIMALS)
        met = (x > np.maximum(x1[i], x1[j])) & (x < np.minimum(x2[i], x2[j]))
        out.append((row[i[met]], x[met]))
    return tuple(map(np.concatenate, zip(*out)))


def swept(rings: pa.Array):
    """For each row of rings: whether anything is covered, and its AREAS."""
    n = len(rings)
    row, layer, poly, x1, y1, x2, y2 = edges(rings)
    e = np.flatnonzero(x1 < x2)
    m = (y2[e] - y1[e]) / (x2[e] - x1[e])
    cross_row, cross_x = crossings(row[e], x1[e], y1[e], x2[e], y2[e], m, n)
    at, x = np.concatenate([row, row, cross_row]), np.concatenate([x1, x2, cross_x])
    order = np.lexsort((x, at))
    at, x = at[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (at[1:] != at[:-1]) | (x[1:] != x[:-1])
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    x = x[new]
    # An edge crosses the slabs from its left end's place to its right end's.
    first, slabs = place[: len(row)][e], (place[len(row) : 2 * len(row)] - place[: len(row)])[e]
    i, k = np.repeat(np.arange(len(e)), slabs), np.repeat(first, slabs) + steps(slabs)
    if not len(k):
        return np.zeros(n, bool), np.zeros((len(AREAS), n))
    middle = y1[e][i] + ((x[k] + x[k + 1]) / 2 - x1[e][i]) * m[i]
    up = np.lexsort((middle, k))
    i, k, middle = i[up], k[up], middle[up]
    # Of a polygon's edges in a slab, every other one opens it.
    mine = poly[e][i]
    by = np.argsort(k * (mine.max() + 1) + mine, kind="stable")
    begins = np.ones(len(by), bool)
    begins[1:] = (np.diff(k[by]) != 0) | (np.diff(mine[by]) != 0)
    start = np.flatnonzero(begins)
    turn = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    step = np.empty(len(by), np.int64)
    step[by] = 1 - 2 * (turn % 2)
    which = layer[e][i]
    # What opens in a slab closes there, so the sums need no new start.
    a, b = (np.cumsum(np.where(which == layer_, step, 0))[:-1] > 0 for layer_ in (0, 1))
    height = np.diff(middle)
    cell = (k[1:] == k[:-1]) & (height > 0) & (a | b)
    a, b, k, of = a[cell], b[cell], k[:-1][cell], row[e][i[:-1][cell]]
    area = (x[k + 1] - x[k]) * height[cell]
    sums = [np.bincount(of, weights=area * keep, minlength=n) for keep in (a, b, a & b, a | b, a & ~b)]
    return np.bincount(of, minlength=n) > 0, np.stack(sums)


def common(a: Column, b: Column) -> Column:
    """The area that the rings a and b have in common, null where there is no ring a."""

    def both(rings: pa.Array) -> pa.Array:
        parts = [swept(rings.slice(low, PLANS))[1][AREAS.index("both")] for low in range(0, len(rings), PLANS)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return F.when(a.isNotNull(), F.arrow_udf(both, "double")(laid_over(a, b)))


def areas(plans: DataFrame) -> DataFrame:
    """(plan, AREAS) of plans (plan, rings): what overlay.areas(overlay.cells(...)) gives of the same rings.

    A plan of which no ring has an area has no row.  A task holds the pairs of PAIRS edges and the slabs of PLANS plans.
    """
    kind = plans.schema["plan"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, PLANS):
                part = batch.slice(low, PLANS)
                some, sums = swept(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(some)), *[pa.array(s[some]) for s in sums]], names=["plan", *AREAS])

    return plans.select("plan", "rings").mapInArrow(run, f"plan {kind}, " + ", ".join(f"{a} double" for a in AREAS))
