"""Queries do the whole job: no row of their tables is left out."""

from marlstone.operators import code as C
from marlstone.plans import QUERIES

#: A handler of 20 lines with a sink in its fourth.
VIEW = "@app.get('/x/<path:p>')\ndef f(p):\n    n = 1\n    return open('/srv/' + p)\n" + "\n" * 16


def test_bm25_porter_ranks_every_benchmark_item(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "the running dogs", "web0"), (2, "a cat sleeps", "web1"), (3, "birds sing", "web2")], "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(3, "dog runs"), (20, "cats sleeping"), (4711, "singing bird")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert {(r.query_id, r.doc_id) for r in QUERIES["bm25_porter"](spark, d).where("rank = 1").collect()} == {(3, 1), (20, 2), (4711, 3)}


def test_every_application_has_its_seeds(spark):
    known = C.facts(spark.createDataFrame([(a, "v.py", VIEW * 70) for a in ("one", "two")], "app string, path string, text string")).cache()
    assert sorted((r.app, r["count"]) for r in C.sinks(known).groupBy("app").count().collect()) == [("one", 60), ("two", 60)]
    assert {r.line_start for r in C.sinks(known).where("app = 'two'").collect()} == {4 + 20 * k for k in range(60)}
    assert C.sinks(known, None).count() == 140
