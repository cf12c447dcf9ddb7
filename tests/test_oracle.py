"""Every catalogued query against its DuckDB oracle at sf0.01 (sorted rows, names, values)."""

import math

import duckdb
import pytest

from tests.conftest import SF
from tickframe.catalogue import ENTRIES, oracle, spark_query

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES = {name: spark_query(name) for name in ENTRIES}
ORACLE = {name: sql for name in ENTRIES if (sql := oracle(name)) is not None}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if type(v).__name__ == "date":
        return (1, v.isoformat())
    return (1, repr(v) if isinstance(v, float) else str(v))


def _rows(rs):
    return sorted(tuple(_norm(x) for x in r) for r in rs)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    res = duck.execute(ORACLE[name])
    assert df.columns == [d[0] for d in res.description]
    assert _rows(tuple(r) for r in df.collect()) == _rows(res.fetchall())
