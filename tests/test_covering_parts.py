"""Spans are dealt out before they become many cells."""

from pyspark.sql import functions as F

from marlstone.operators import match


def test_covering_spans_are_dealt_out_before_their_cells(spark):
    needs = spark.range(40).selectExpr("id as need_id", "id % 4 as run", "id % 7 as lo", "id % 7 + 2 as hi")
    reads = spark.range(90).selectExpr("id as read_ord", "id % 4 as run", "id % 5 as a", "id % 5 + 6 as b")
    found = match.latest_covering(needs, reads)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = next(n for n, line in enumerate(plan) if "Generate explode" in line and "_c" in line)
    assert any("RepartitionByExpression" in line for line in plan[made:])
    want = {n.need_id: max((r.read_ord for r in reads.collect() if r.run == n.run and r.a <= n.lo and r.b >= n.hi), default=None) for n in needs.collect()}
    assert {r.need_id: r.read_ord for r in found.collect()} == want
    assert found.agg(F.count("*")).first()[0] == 40
