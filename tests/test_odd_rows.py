"""Queries on small tables of odd rows, against their SQL in DuckDB."""

from __future__ import annotations

import datetime
import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__  # noqa: F401  it registers the queries
from quoin import registry

LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
EVENT = ("event_id", "ts", "user_id", "event_type", "value", "props")
DAY = datetime.datetime(1996, 1, 1)


def line(plan, part, supplier, number, quantity, status="O", price=1.0):
    return plan, part, supplier, number, float(quantity), price, 0.05, 0.02, "R", status, DAY


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v + 0.0:.7g}" if isinstance(v, float) else str(v)


def agrees(spark, folder, name, rows, table="lineitem"):
    """The query's rows over a table of `rows`, which must be those of its SQL."""
    columns = LINE if table == "lineitem" else EVENT
    pq.write_table(pa.table({c: [r[i] for r in rows] for i, c in enumerate(columns)}), folder / f"{table}.parquet", coerce_timestamps="us")
    df = registry.QUERIES[name](spark, str(folder))
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    duck = duckdb.connect()
    duck.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    found = duck.execute(registry.ORACLE[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in sorted(df.columns)) for r in found.fetchall())
    return got


#: Plans of sf0.1, repeated with shifted keys, in which two walls or two pieces tie but for rounding.
TIES = [
    line(629189, *r)
    for r in ((83774, 4144, 2, 28, "F", 1), (92763, 4934, 3, 35, "F", 2), (98624, 4607, 3, 29, "F", 3), (86413, 4700, 3, 10, "O", 4), (82163, 4019, 4, 4, "F", 5), (95644, 4011, 6, 26, "O", 6))
] + [
    line(480693, *r)
    for r in ((60463, 3533, 2, 6, "F", 1), (69415, 3070, 2, 35, "O", 2), (60758, 3749, 5, 19, "O", 3), (75869, 3272, 5, 43, "O", 4), (73070, 3159, 5, 28, "F", 5), (71337, 3017, 5, 11, "O", 6), (66062, 3449, 5, 6, "F", 7))
]


def test_nearest_wall_rounds_as_its_sql(spark, tmp_path):
    assert agrees(spark, tmp_path, "nearest_wall", TIES)


def test_draft_cap_rounds_halves_to_even(spark, tmp_path):
    at = lambda k: DAY + datetime.timedelta(minutes=k)
    rows = [(k, at(k), 1, "view", v, "") for k, v in enumerate((96.5, 102.5))] + [(k + 9, at(k), 2, "view", v, "") for k, v in enumerate((97.5, 102.5))]
    got = agrees(spark, tmp_path, "draft_cap", [*rows, (20, at(1), 3, "view", None, "")], "events")
    assert {r[0] for r in got} == {"True", "False", ""}


def test_monotone_version_before_1970_and_without_a_time(spark, tmp_path):
    old = datetime.datetime(1969, 12, 31, 23, 58, 59)
    rows = [(1, old, 1, "view", 1.0, ""), (2, None, 1, "view", 1.0, ""), (3, DAY, 1, "view", 1.0, ""), (4, old, 2, "view", 1.0, ""), (None, DAY, 3, "view", 1.0, ""), (5, DAY, 3, "view", 1.0, "")]
    assert len(agrees(spark, tmp_path, "monotone_version", rows, "events")) == 6


@pytest.mark.parametrize(
    "rows",
    [
        [(5250, 160, 2, 7, "F"), (12279, 944, 3, 41, "F"), (9534, 7, 6, 28, "F"), (8670, 727, 7, 40, "O")],
        [(101298, 5141, 3, 12, "F"), (116153, 5162, 4, 34, "O"), (105959, 5451, 4, 25, "F"), (109015, 5664, 6, 15, "O"), (117569, 5576, 7, 20, "O")],
    ],
)
def test_fitted_furniture_ties_by_size_as_its_sql(spark, tmp_path, rows):
    assert agrees(spark, tmp_path, "fitted_furniture", [line(889935, *r) for r in rows])


def test_safe_point_looks_at_a_column_and_a_row_and_not_at_every_point(spark, tmp_path):
    rows = [line(k, 64 * k + k % 64, 64 * k + k // 3, k % 8, k % 51) for k in range(120)]
    assert agrees(spark, tmp_path, "safe_point", rows)
    plan = registry.QUERIES["safe_point"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "sequence(" not in plan
