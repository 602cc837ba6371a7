"""Every query with SQL gives that SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from marlstone.plans import ORACLE, QUERIES

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")
TABLES = [f[:-8] for f in sorted(os.listdir(DATA)) if f.endswith(".parquet")] if os.path.isdir(DATA) else []


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, list):
        return tuple(map(plain, v))
    if isinstance(v, (bool, int, str)) or v is None:
        return v
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not TABLES, reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA)
    cursor = db.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    want = rows(names, cursor.fetchall())
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    assert len(got) == len(want)
    assert got == want
    assert got or DATA.endswith("sf0.001")
