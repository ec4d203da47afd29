"""The table of queries: name -> callable(spark, sf_dir), the SQL that states the same, and the operators it covers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, tuple[int, ...]] = {}


def query(name: str, covers: tuple[int, ...], oracle: str | None = None):
    def add(f):
        QUERIES[name], COVERS[name] = f, covers
        if oracle is not None:
            from quoin.plans.bindings import expand

            ORACLE[name] = expand(oracle)
        return f

    return add
