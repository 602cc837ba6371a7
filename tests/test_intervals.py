"""Spans met through cells, against all pairs in Python, and files whose pairs could not be made."""

import random
import time

from pyspark.sql import functions as F

from marlstone.operators import intervals, match, review


def test_cells_cover_a_span_once(spark):
    spans = [(lo, hi) for lo in range(-9, 10) for hi in range(lo - 1, 12)] + [(None, 3), (3, None), (0, 2**40), (-(2**40), 7)]
    rows = spark.createDataFrame(spans, "lo long, hi long").select("lo", "hi", intervals.span_cells(F.col("lo"), F.col("hi")).alias("c")).collect()
    for lo, hi, cells in rows:
        if lo is None or hi is None or hi < lo:
            assert not cells
            continue
        parts = sorted((c.cell << c.width, (c.cell + 1) << c.width) for c in cells)
        assert parts[0][0] == lo and parts[-1][1] == hi + 1 and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert max(sum(c.width == w for c in cells) for w in {c.width for c in cells}) <= 2


def test_against_all_pairs(spark):
    r = random.Random(4)
    span = lambda: (lambda a: (a, a + r.choice([0, 1, 3, 20, 200, -1])))(r.randrange(-50, 300))
    file = lambda: r.choice(["a", "b", "c", None])
    spans = [(file(), i, *span()) for i in range(300)] + [("a", 300, None, 4), ("a", 301, 5, None)]
    asks = [(i, file(), *span()) for i in range(300)] + [(300, "a", None, 2)]
    s = spark.createDataFrame([(*x, f"n{x[1]}") for x in spans], "file string, span_ord int, lo int, hi int, name string")
    held = [x for x in spans if x[0] and None not in x]

    points = spark.createDataFrame([(i, f, lo) for i, f, lo, _ in asks], "point_ord int, file string, line int")
    over = {i: min(((lo, o) for g, o, lo, hi in held if f == g and at is not None and lo <= at <= hi), default=None) for i, f, at, _ in asks}
    got = {x.point_ord: x.name for x in match.first_enclosing(points, s).collect()}
    assert len(got) == len(asks) and {i for i, o in over.items() if o} == {i for i, n in got.items() if n and n.startswith("n")}
    assert all(got[i] == f"n{o[1]}" for i, o in over.items() if o)
    outside = {x.point_ord for x in review.outside_handlers(points, s.select("file", "lo", "hi")).collect()}
    assert outside == {i for i, o in over.items() if not o}

    needs = spark.createDataFrame(asks, "need_id int, run string, lo int, hi int")
    reads = spark.createDataFrame(spans, "run string, read_ord int, a int, b int")
    want = {i: max((o for g, o, a, b in held if f == g and lo is not None and a <= lo <= hi <= b), default=None) for i, f, lo, hi in asks}
    assert {x.need_id: x.read_ord for x in match.latest_covering(needs, reads).collect()} == want

    want = {(f, lo, hi): min((o for g, o, a, b in held if f == g and a <= b and a <= hi and b >= lo), default=None) for _, f, lo, hi in asks if f and lo is not None and lo <= hi}
    met = intervals.least_overlapping(needs, reads, ["run"], "lo", "hi", "a", "b", F.col("read_ord")).collect()
    assert {(x.run, x.lo, x.hi): x.least for x in met} == {k: v for k, v in want.items() if v is not None}

    sinks = spark.createDataFrame([(f, "x", a) for f, _, a, _ in spans], "file string, family string, line int")
    c = spark.createDataFrame([(i, f, "x", at) for i, f, at, _ in asks], "candidate_id int, file string, family string, line int")
    near = {x.candidate_id: x.protected for x in review.near_protected(c, sinks).collect()}
    assert near == {i: any(f is not None and f == g and a is not None and at is not None and abs(a - at) <= 3 for g, _, a, _ in spans) for i, f, at, _ in asks}


def test_hot_file(spark):
    """60,000 points under 60,000 spans of one file: 1.8e9 pairs if they met."""
    n = 60_000
    spans = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("span_ord"), (F.col("id") / 2).cast("long").alias("lo"), (F.col("id") + n).alias("hi"), F.col("id").cast("string").alias("name"))
    points = spark.range(n).select(F.col("id").alias("point_ord"), F.lit("f").alias("file"), F.col("id").alias("line"))
    begin = time.time()
    assert match.first_enclosing(points, spans).where("name = '0'").count() == n
    assert review.outside_handlers(points, spans).count() == 0
    reads = spans.select(F.col("file").alias("run"), F.col("span_ord").alias("read_ord"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    needs = points.select(F.col("point_ord").alias("need_id"), F.col("file").alias("run"), F.col("line").alias("lo"), (F.col("line") + 1).alias("hi"))
    got = match.latest_covering(needs, reads).agg(F.sum((F.col("read_ord") == F.least(F.lit(n - 1), 2 * F.col("lo") + 1)).cast("int"))).first()[0]
    assert got == n
    assert time.time() - begin < 60
