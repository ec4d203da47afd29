"""Affine transforms written as text, such as `translate(3, 4) rotate(90 1 2) scale(2)`."""

from __future__ import annotations

import math
import re

import pandas as pd

_CALL = re.compile(r"\s*,?\s*([a-zA-Z]+)\s*\(([^()]*)\)")
#: Numbers that each function may be given.
ARITY = {"matrix": {6}, "translate": {1, 2}, "scale": {1, 2}, "rotate": {1, 3}}
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def product(m: tuple, n: tuple) -> tuple:
    """m after n: (a, b, c, d, e, f) stands for x' = ax + cy + e, y' = bx + dy + f."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f


def single(name: str, v: list[float]) -> tuple:
    if name == "matrix":
        return tuple(v)
    if name == "translate":
        return 1.0, 0.0, 0.0, 1.0, v[0], v[1] if len(v) > 1 else 0.0
    if name == "scale":
        return v[0], 0.0, 0.0, v[-1], 0.0, 0.0
    c, s = math.cos(math.radians(v[0])), math.sin(math.radians(v[0]))
    turn = (c, s, -s, c, 0.0, 0.0)
    if len(v) == 1:
        return turn
    return product(product((1.0, 0.0, 0.0, 1.0, v[1], v[2]), turn), (1.0, 0.0, 0.0, 1.0, -v[1], -v[2]))


def affine(text: str | None) -> tuple | None:
    """The transforms multiplied from left to right; null, and anything left over or with too few numbers, give None."""
    if text is None:
        return None
    out, at = IDENTITY, 0
    while text[at:].strip():
        m = _CALL.match(text, at)
        if m is None:
            return None
        try:
            v = [float(x) for x in re.split(r"[\s,]+", m[2].strip())]
        except ValueError:
            return None
        if len(v) not in ARITY.get(m[1], ()) or not all(map(math.isfinite, v)):
            return None
        out, at = product(out, single(m[1], v)), m.end()
    return out


def affines(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([affine(t) or (None,) * 6 for t in texts], columns=list("abcdef"), dtype="float64")
