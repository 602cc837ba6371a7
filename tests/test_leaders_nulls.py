"""Leaders of rows without a time or an order."""

import pytest

from marlstone.operators import ordered as O


def test_leaders_without_order_come_last(spark):
    x = spark.createDataFrame([("g", 10, None), ("g", 12, 5), ("g", 40, None)], "g string, n long, o long")
    assert sorted(tuple(r) for r in O.leaders(x, ["g"], "n", 3, "o").collect()) == [("g", 12), ("g", 40)]


def test_events_without_time_or_id(spark, tmp_path):
    import duckdb

    import __spark_entry__ as E

    x = "(1, 7, TIMESTAMP '2024-01-01 00:00:00'), (2, 7, NULL), (3, 7, NULL), (NULL, 7, TIMESTAMP '2024-01-01 00:05:00'), (4, 8, NULL), (5, 9, TIMESTAMP '1969-12-31 23:59:00.5')"
    with duckdb.connect() as c:
        c.sql(f"COPY (SELECT * FROM (VALUES {x}) e(event_id, user_id, ts)) TO '{tmp_path}/events.parquet'")
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        want = c.sql(E.oracle_sql()["leader_dedupe_events"]).fetchall()
    got = [tuple(r) for r in E.queries()["leader_dedupe_events"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("year", ["1969", "2024"])
def test_events_around_a_full_minute(spark, tmp_path, year):
    """Milliseconds are rounded, so the last half millisecond of a minute is the next one's; infinite times have no minute."""
    import duckdb

    import __spark_entry__ as E

    ends = ["59.999", "59.999499", "59.9995", "59.999501", "59.999999", "00.0", "00.000499", "00.0005", "00.000501", "00.0015", "30.25"]
    rows = ", ".join(f"({i}, {i}, TIMESTAMP '{year}-12-31 23:{m}:{s}')" for i, (m, s) in enumerate((m, s) for m in ("00", "44", "59") for s in ends))
    rows += ", (90, 90, TIMESTAMP 'infinity'), (91, 91, TIMESTAMP '-infinity')"
    with duckdb.connect() as c:
        c.sql(f"COPY (SELECT * FROM (VALUES {rows}) e(event_id, user_id, ts)) TO '{tmp_path}/events.parquet'")
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        want = c.sql(E.oracle_sql()["leader_dedupe_events"]).fetchall()
    got = [tuple(r) for r in E.queries()["leader_dedupe_events"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
