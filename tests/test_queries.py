"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest
from tickforge.plans import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows, names):
    cell = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    return sorted((tuple(cell(v) for v in r) for r in rows), key=lambda r: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    q = QUERIES[name]
    got = q(spark, SF)
    names = sorted(got.columns)
    rows = plain((tuple(r) for r in got.select(*names).collect()), names)
    assert rows or name in ("dataset_sequences", "dataset_multiscale")  # three samples a day are too few for a window here
    if q.oracle:
        want = tables.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({q.oracle})").fetchall()
        assert rows == plain(want, names)
