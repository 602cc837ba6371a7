"""Scores are summed where a document's postings are; what leaves a part is its best of each query."""

import random

from marlstone.operators import search
from marlstone.operators.search import best, bm25


def test_best_equals_sorting_all_sums(spark, monkeypatch):
    monkeypatch.setattr(search, "SCORES_AT_ONCE", 7)
    rnd = random.Random(3)
    rows = [(k, float(rnd.choice([1, 2, 2.5])), [(q,) for q in rnd.sample(["a", "b", "c", None], rnd.randint(0, 4))]) for k in [None, *range(120)] for _ in range(rnd.randint(1, 5))]
    shares = spark.createDataFrame(rows, "id int, share double, asked array<struct<query_id:string>>")
    sums = {}
    for k, s, qs in rows:
        for (q,) in qs:
            sums[q, k] = sums.get((q, k), 0.0) + s
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for n in (1, 4, 500):
            want = []
            for q in {q for q, _ in sums}:
                of = sorted((-s, k is not None, k or 0, k) for (p, k), s in sums.items() if p == q)
                want += [(q, k, -s, r + 1) for r, (s, _, _, k) in enumerate(of[:n])]
            got = [(r.query_id, r.id, r.score, r["rank"]) for r in best(shares.repartition(3, "id").sortWithinPartitions("id"), "id", n).collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert best(shares.where("false"), "id", 2).count() == 0


def _exchanges(df) -> list[str]:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning" in line]


def test_no_exchange_carries_a_row_for_each_query_and_document(spark):
    docs = spark.createDataFrame([(k, "x y " * (k % 3)) for k in range(50)], "id long, text string")
    queries = spark.createDataFrame([(q, ["x", "y"]) for q in range(20)], "query_id int, terms array<string>")
    found = bm25(docs, "id", {"text": 1.0}, queries, 2)
    # the old plan dealt the joined rows out by (query_id, id)
    assert _exchanges(found) and not any("hashpartitioning(query_id" in line and "id#" in line.split("hashpartitioning(")[1].split(")")[0].replace("query_id#", "") for line in _exchanges(found))
