"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import pytest

from foliant import plans

NAMES = sorted(plans.queries())
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, str)) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tiny, duck, name):
    df = plans.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_names():
    assert set(plans.oracle_sql()) <= set(NAMES)
