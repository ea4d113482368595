"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from arboryx.plans import catalog


def norm(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.7g}"
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf), duck.sql(catalog.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert norm(got.select(*names).collect()) == norm(want.select(*[f'"{n}"' for n in names]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
