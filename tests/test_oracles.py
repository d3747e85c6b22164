"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pixelloom.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(records, columns):
    k = sorted(columns)
    return sorted((tuple(0.0 if v == 0 else v for v in (r[c] for c in k)) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, tables, name):
    df = QUERIES[name](spark, SF)
    cur = tables.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows([r.asDict() for r in df.collect()], columns) == rows([dict(zip(columns, r, strict=True)) for r in cur.fetchall()], columns)
