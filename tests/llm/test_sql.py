"""The training-data queries that have SQL against it in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v + 0.0:.7g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_chat_quotes", "op8_line_dedup", "op11_fill_in_middle"])
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
