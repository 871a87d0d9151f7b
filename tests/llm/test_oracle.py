"""Queries with SQL against DuckDB on a small table."""

from __future__ import annotations

import duckdb

from momentlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_sql_gives_the_same_rows(spark):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in ORACLES.items():
        mine = QUERIES[name](spark, SF)
        cur = con.execute(sql)
        columns = [c[0] for c in cur.description]
        assert sorted(columns) == sorted(mine.columns)
        want = sorted((tuple(dict(zip(columns, r, strict=True))[c] for c in mine.columns) for r in cur.fetchall()), key=repr)
        assert sorted(map(tuple, mine.collect()), key=repr) == want
