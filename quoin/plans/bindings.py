"""Plan elements bound to the star-schema tables, in SQL that Spark and DuckDB read alike.

A plan is an order.  Coordinates are multiples of 1/16, so both engines compute them exactly.  `ord` is the place of
an element in its plan: list order decides ties, so every element has one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quoin.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# What a line is as a room, as a piece of furniture and as a label's place.
_ROOM = """CAST(l_partkey % 64 AS DOUBLE) / 8 AS x0, CAST(l_suppkey % 64 AS DOUBLE) / 8 AS y0,
        CAST(l_partkey % 64 + 8 + l_linenumber * 4 AS DOUBLE) / 8 AS x1,
        CAST(l_suppkey % 64 + 8 + l_quantity AS DOUBLE) / 8 AS y1"""
_PIECE = """CAST(l_partkey % 16 AS DOUBLE) / 2 AS x, CAST(l_suppkey % 8 AS DOUBLE) / 2 AS y,
        CAST(l_linenumber AS DOUBLE) / 4 AS w, CAST(l_quantity % 4 + 1 AS DOUBLE) / 4 AS d,
        CAST(l_quantity * 30 - 720 AS DOUBLE) AS rot"""
_WALL = """CAST((l_partkey * 7 + l_linenumber * 13) % 160 AS DOUBLE) / 16 AS {x}1,
        CAST((l_suppkey * 11 + l_linenumber * 5) % 160 AS DOUBLE) / 16 AS {y}1,
        CAST((l_partkey * 3 + l_suppkey) % 160 AS DOUBLE) / 16 AS {x}2,
        CAST((l_partkey + l_linenumber * 29) % 160 AS DOUBLE) / 16 AS {y}2"""
_LABEL = """CAST((l_partkey * 5 + l_linenumber * 3) % 128 AS DOUBLE) / 8 AS {x},
        CAST((l_suppkey * 9 + l_linenumber) % 128 AS DOUBLE) / 8 AS {y}"""

VIEWS = {
    # Lines of an order in list order.
    "lines": """SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
        l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS INTEGER) AS ord FROM {lineitem}""",
    # Wall segments with thickness, in metres.
    "walls": f"""SELECT l_orderkey AS plan, ord, concat('w', CAST(ord AS VARCHAR(10))) AS id,
        {_WALL.format(x="x", y="y")},
        CAST(l_quantity % 8 + 1 AS DOUBLE) / 32 AS thickness, l_returnflag = 'R' AS external,
        CAST(l_linenumber AS DOUBLE) / 8 AS confidence FROM {{lines}}""",
    # Walls along the axes, on a grid of quarter metres: even places are level, odd ones upright.
    "axis_walls": """SELECT plan, ord, concat('w', CAST(ord AS VARCHAR(10))) AS id, x1, y1,
        CASE WHEN ord % 2 = 0 THEN x1 + run ELSE x1 END AS x2, CASE WHEN ord % 2 = 0 THEN y1 ELSE y1 + run END AS y2,
        thickness, external, confidence FROM (SELECT l_orderkey AS plan, ord,
        CAST((l_partkey * 7 + l_linenumber * 13) % 25 AS DOUBLE) / 4 AS x1, CAST((l_suppkey * 11 + l_linenumber * 5) % 25 AS DOUBLE) / 4 AS y1,
        CAST((l_partkey + l_linenumber * 3) % 13 AS DOUBLE) / 4 AS run, CAST(l_quantity % 8 + 1 AS DOUBLE) / 32 AS thickness,
        l_returnflag = 'R' AS external, CAST(l_linenumber AS DOUBLE) / 8 AS confidence FROM {lines})""",
    # Openings on the walls: an interval on wall l_suppkey % 3 of the plan.
    "openings": """SELECT l_orderkey AS plan, ord, concat('w', CAST(l_suppkey % 3 AS VARCHAR(10))) AS wall_id,
        concat('o', CAST(ord AS VARCHAR(10))) AS id,
        CAST((l_partkey * 7 + l_linenumber * 13) % 97 AS DOUBLE) AS s,
        CAST((l_partkey * 7 + l_linenumber * 13) % 97 + l_quantity AS DOUBLE) AS e,
        l_linestatus AS kind FROM {lines}""",
    # Rooms are rectangles; label points lie about them.
    "rooms": f"""SELECT l_orderkey AS plan, ord, concat('r', CAST(ord AS VARCHAR(10))) AS id,
        {_ROOM} FROM {{lines}} WHERE l_linestatus = 'O'""",
    # The four sides of every room as walls.
    "room_walls": """SELECT plan, ord * 4 + side AS ord, concat('w', CAST(ord * 4 + side AS VARCHAR(10))) AS id,
        CASE side WHEN 1 THEN x1 ELSE x0 END AS x1, CASE side WHEN 2 THEN y1 ELSE y0 END AS y1,
        CASE side WHEN 3 THEN x0 ELSE x1 END AS x2, CASE side WHEN 0 THEN y0 ELSE y1 END AS y2, CAST(0.125 AS DOUBLE) AS thickness
        FROM (SELECT * FROM {rooms}) r CROSS JOIN (VALUES (0), (1), (2), (3)) s(side)""",
    "labels_px": f"""SELECT l_orderkey AS plan, ord, {_LABEL.format(x="x", y="y")}, 1 - l_discount * 5 AS confidence,
        concat(CASE l_linenumber % 4 WHEN 0 THEN 'Kitchen' WHEN 1 THEN 'Bedroom' WHEN 2 THEN 'Bath' ELSE 'Hall' END,
               ' ', CAST(l_linenumber AS VARCHAR(10))) AS name FROM {{lines}} WHERE l_linestatus = 'F'""",
    # Scale constraints: a tier, a measured pair in pixels and an expected pair in metres.
    "constraints": """SELECT l_orderkey AS plan, ord, CASE l_returnflag WHEN 'R' THEN 'room_dimension' WHEN 'A' THEN 'door_width'
        ELSE 'wall_thickness' END AS tier, l_extendedprice AS m0, l_extendedprice * (1 + l_tax) AS m1,
        l_quantity AS e0, l_quantity * (1 - 3 * l_discount) AS e1, 1 - l_discount AS weight FROM {lines}""",
    "furniture": f"""SELECT l_orderkey AS plan, ord, {_PIECE}, CASE l_partkey % 6 WHEN 0 THEN 'Double Bed' WHEN 1 THEN 'couch'
        WHEN 2 THEN 'bedside-table' WHEN 3 THEN 'Carpet' WHEN 4 THEN 'arm chair' ELSE 'bookshelf' END AS category FROM {{lines}}""",
    # Walls, rooms, furniture and labels of one reading: every line is a wall and a piece, and by its status a room (O) or a
    # label (F) too.
    "shapes": f"""SELECT l_orderkey AS plan, ord, l_linestatus AS status, {_ROOM}, {_PIECE}, {_LABEL.format(x="lx", y="ly")},
        {_WALL.format(x="wx", y="wy")} FROM {{lines}}""",
    # A drawing of a thousand pixels a side for each supplier: level and upright bands of ink in four lengths.
    "bands": """SELECT l_suppkey AS plan, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
        l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS INTEGER) AS ord, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS orientation,
        CAST((l_orderkey * 37 + l_partkey * 11) % 4000 AS DOUBLE) / 4 AS place, CAST(l_partkey % 4 * 200 + l_orderkey % 9 AS DOUBLE) AS s,
        CAST(l_partkey % 4 * 260 + 90 + l_quantity % 8 AS DOUBLE) AS e, CAST(l_quantity % 8 + 1 AS DOUBLE) AS thickness,
        CAST(l_linenumber AS DOUBLE) / 8 AS confidence, l_returnflag = 'R' AS external FROM {lineitem}""",
}
_NAME = re.compile(r"\{(\w+)\}")


def expand(sql: str) -> str:
    """SQL with each {view} as a subquery and each {table} as its name: what DuckDB runs."""
    return _NAME.sub(lambda m: f"({expand(VIEWS[m[1]])})" if m[1] in VIEWS else m[1], sql)


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's DataFrame over the tables of sf_dir."""
    sql = f"{{{name}}}" if name in TABLES else VIEWS[name]
    while any(m in VIEWS for m in _NAME.findall(sql)):
        sql = _NAME.sub(lambda m: f"({VIEWS[m[1]]})" if m[1] in VIEWS else m[0], sql)
    if name in TABLES:
        return table(spark, sf_dir, name)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(_NAME.findall(sql))})
