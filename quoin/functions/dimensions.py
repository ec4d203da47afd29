"""Reading `A x B` with feet, inches, fractions and metric units from a label's text.

The text is cut into numbers, fractions, unit words and separators, each with its place; a pair is an operand, a
separator and an operand that stand next to each other, with nothing but spaces between.  A pair must stand alone: what
it touches on either side may not be part of a word, a number or another measure.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd

# Units in metres, and the words for feet and inches.
METRES = {"m": 1.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "in": 0.0254}
UNITS = {"feet": "ft", "foot": "ft", "ft": "ft", "'": "ft", "inches": "in", "inch": "in", "in": "in", '"': "in", "mm": "mm", "cm": "cm", "m": "m"}
SEPARATORS = {"x", "*", "by", "×"}
SMALLEST, LARGEST, CENTIMETRES_OVER = 0.20, 80.0, 20
#: Longer words first, so that `mm` is not two metres; digits with a slash are one fraction.
_TOKEN = re.compile("|".join([r"(?P<part>\d+/\d+)", r"(?P<number>\d+(?:\.\d+)?)", "(?P<word>" + "|".join(map(re.escape, sorted({*UNITS, *SEPARATORS}, key=len, reverse=True))) + ")", r"(?P<dash>-)", r"(?P<other>\S)"]), re.ASCII)
_TOUCHES_LEFT, _TOUCHES_RIGHT = set(".,'\"/+-"), set(".,'\"/")


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Operand:
    value: float | None
    unit: str | None
    next: int
    end: int


def tokens_of(text: str) -> list[Token]:
    return [Token(m.lastgroup, m[0].lower(), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def _word(char: str) -> bool:
    return char.isascii() and (char.isalnum() or char == "_")


class Reader:
    def __init__(self, text: str):
        self.text, self.tokens = text, tokens_of(text)

    def at(self, i: int, kind: str, words=None) -> Token | None:
        t = self.tokens[i] if i < len(self.tokens) else None
        return t if t and t.kind == kind and (words is None or t.text in words) else None

    def operand(self, i: int) -> Operand | None:
        """A number with its unit; feet may be followed by inches.  The value is None if the inches can't be."""
        number = self.at(i, "number")
        if number is None:
            return None
        unit = self.at(i + 1, "word", UNITS)
        if unit is None:
            return Operand(float(number.text), None, i + 1, number.end)
        if UNITS[unit.text] != "ft":
            return Operand(float(number.text), UNITS[unit.text], i + 2, unit.end)
        inches, j, end = self.inches(i + 3 if self.at(i + 2, "dash") else i + 2)
        if j is None:
            return Operand(float(number.text), "ft", i + 2, unit.end)
        good = inches is not None and 0 <= inches < 12
        return Operand(float(number.text) + float(inches) / 12 if good else None, "ft", j, end)

    def inches(self, i: int):
        """(inches or None, next token, end) of `6`, `1/2`, `6 1/2`, with or without a unit; next is None if there are none."""
        total, j = Fraction(0), i
        for kind in ("number", "part"):
            t = self.at(j, kind)
            if t is None:
                continue
            if kind == "part" and j > i and ("." in self.tokens[i].text or not self.text[self.tokens[i].end : t.start].strip() == "" or t.start == self.tokens[i].end):
                break
            over = t.text.partition("/")[2]
            total = None if over and not int(over) else total + Fraction(t.text)
            j += 1
            if total is None:
                break
        if j == i:
            return None, None, 0
        unit = self.at(j, "word", [u for u, x in UNITS.items() if x == "in"])
        j += unit is not None
        return total, j, self.tokens[j - 1].end

    def alone(self, start: int, end: int) -> bool:
        before, after = self.text[start - 1 : start], self.text[end:]
        if before and (_word(before) or before in _TOUCHES_LEFT):
            return False
        return not (after and (_word(after[0]) or after[0] in _TOUCHES_RIGHT or after.lstrip()[:1].isdigit()))

    def pair(self) -> tuple[Operand, Operand] | None:
        for i, t in enumerate(self.tokens):
            a = self.operand(i)
            if a is None or not self.at(a.next, "word", SEPARATORS) and not self.at(a.next, "other", SEPARATORS):
                continue
            b = self.operand(a.next + 1)
            if b is not None and self.alone(t.start, b.end):
                return a, b
        return None


def metres(value: float | None, unit: str | None) -> tuple[float | None, str]:
    """Metres and the unit taken; bare numbers over CENTIMETRES_OVER are centimetres."""
    if value is None:
        return None, unit or ""
    if unit is None:
        return (value / 100, "context_cm") if value > CENTIMETRES_OVER else (value, "context_m")
    return value / (1000 if unit == "mm" else 100) if unit in ("mm", "cm") else value * METRES[unit], unit


def read_pair(text: str | None) -> tuple:
    """(state, width_m, height_m, unit); an operand without a unit has the other's."""
    found = Reader(text).pair() if text else None
    if found is None:
        return "none", None, None, None
    a, b = found
    (w, used_a), (h, used_b) = metres(a.value, a.unit or b.unit), metres(b.value, b.unit or a.unit)
    if w is None or h is None or not (SMALLEST <= w <= LARGEST and SMALLEST <= h <= LARGEST):
        return "error", None, None, None
    return "value", w, h, used_a if used_a == used_b else "mixed"


def read_pairs(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_pair(t) for t in texts], columns=["state", "width_m", "height_m", "unit"])
