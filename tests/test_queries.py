"""Every registered query that SQL can say gives the rows of its DuckDB SQL."""

import datetime
import math
from pathlib import Path

import duckdb
import granary.plans  # noqa: F401
import pytest
from granary.registry import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", [n for n, e in QUERIES.items() if e.sql])
def test_query_equals_its_sql(spark, oracle, name):
    df = QUERIES[name].run(spark, DATA)
    found = oracle.execute(QUERIES[name].sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", [n for n, e in QUERIES.items() if not e.sql])
def test_query_without_sql_runs_and_repeats(spark, name):
    first, second = (sorted(map(repr, QUERIES[name].run(spark, DATA).collect())) for _ in range(2))
    assert first and first == second


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
