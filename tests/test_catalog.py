"""Every query of the library against DuckDB on the same tables."""

import math

import duckdb
import pytest

from turnlens.plans.catalog import Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names, rows):
    def cell(x):
        return repr(round(x, 9) + 0.0) if isinstance(x, float) and math.isfinite(x) else str(x)

    return sorted(tuple(cell(x) for _, x in sorted(zip(names, r, strict=True))) for r in rows)


@pytest.mark.parametrize("name", sorted(Q))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    fn, sql = Q[name]
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    want = cur.fetchall()
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, want)
