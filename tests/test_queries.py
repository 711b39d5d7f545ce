"""Every registered query of the library against its SQL on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from planweave.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    own.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        own.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return own


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime):
        return str(v.date()) if v.time() == datetime.time() else str(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    own = registry.QUERIES[name](spark, SF)
    columns = sorted(own.columns)
    got = sorted((tuple(plain(v) for v in r) for r in own.select(columns).collect()), key=repr)
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want
