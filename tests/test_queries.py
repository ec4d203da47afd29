"""Every query of the plan operators against its SQL in DuckDB, and the others for their rows."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quoin import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v + 0.0:.7g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLE:
        assert columns and len(got) > 0
        return
    found = duck.execute(registry.ORACLE[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_claims_leave_out_what_is_not_done():
    """The README's table is that of the registry, and no operator is both claimed and listed as not done."""
    import re
    from pathlib import Path

    text = Path(__file__).parents[1].joinpath("README.md").read_text()
    table = {m[1]: {int(n) for n in re.findall(r"\d+", m[2])} for m in re.finditer(r"^\| `(\w+)` \| ([\d, ]+|none) \|", text, re.M)}
    assert all(table[name] == set(covers) for name, covers in registry.COVERS.items() if name in table)
    missing = {int(n) for part in re.findall(r"\b[ABCN]?:? ?\[([\d, ]+)\]", text) for n in part.split(", ")}
    claimed = {n for covers in registry.COVERS.values() for n in covers}
    assert {240, 283} <= missing and not missing & claimed
