"""Queries of the subpackage with SQL give that SQL's rows."""

import os

import duckdb
import pytest

from marlstone.llm.queries import ORACLE, QUERIES

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA)
    cursor = db.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(names).collect()), key=repr) == sorted(map(tuple, cursor.fetchall()), key=repr)
