"""Every registered query that has SQL gives the same rows as DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lexispark.plans import registry

DATA = Path("/root/testdata/sf0.001")
SLOW = {"ppmi_svd"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None) == (b is None) and (a is None or abs(float(a) - float(b)) < 2e-6)
    return a == b


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL)))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, str(DATA))
    names = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=str)
    cursor = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in names)} from ({registry.ORACLE_SQL[name]})")
    want = sorted(cursor.fetchall(), key=str)
    assert len(rows) == len(want)
    if rows != want:
        key = lambda r: tuple(str(round(x, 4)) if isinstance(x, float) else str(x) for x in r)
        for a, b in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
            assert all(same(x, y) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["token", "idx", "freq"] and out.count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE_SQL) <= set(entry.oracle_sql())
