"""Queries and their oracle SQL, gathered from the operator modules."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Entry(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) with the DuckDB SQL that gives the same rows."""

    def add(run):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = Entry(run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
