"""Every query with SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"op7_ngram_jaccard"}


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return str(x) if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_same_rows(spark, duck, name):
    cur = duck.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in cur.description)
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want and want
