"""Every registered query with an oracle against DuckDB, on a folder of tables."""

import math
import os
from pathlib import Path

import pytest

from tessera import catalog

duckdb = pytest.importorskip("duckdb")
SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cell = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else str(x)
    return sorted((tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    mine, theirs = catalog.QUERIES[name](spark, str(SF)).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
