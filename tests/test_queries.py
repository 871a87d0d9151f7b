"""Every registered query against DuckDB on the smallest tables, as the driver compares them."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

from momentlake.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    """Whole numbers alike whatever their type, others to six digits."""
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float) and math.isfinite(v):
        return str(int(v)) if v == int(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in mine.collect())
    if name not in ORACLES:
        assert got or name in ("q7_repair_ranges",)
        return
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cur.fetchall())
