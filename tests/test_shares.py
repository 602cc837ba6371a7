"""Where rows lie: work is dealt out, and what Spark takes for small is small."""

from pyspark.sql import functions as F

from marlstone.operators import code as C
from marlstone.operators import django as J
from marlstone.sources.work import settled


def test_files_of_one_part_are_parsed_in_many(spark):
    files = spark.range(64).coalesce(1).select(F.lit("a").alias("app"), F.concat("id", F.lit(".py")).alias("path"), F.lit("def f():\n    pass\n").alias("text"))
    for facts in (C.facts, J.view_facts):
        held = facts(files).groupBy(F.spark_partition_id()).count().count()
        assert held > 1, facts


def test_like_rows_are_not_taken_for_few(spark):
    """Written rows that pack well must not be broadcast for their files' size."""
    x = settled(spark.range(200_000).select(F.col("id") % 7, F.lit("def f():\n    return 1\n" * 8).alias("text")))
    assert x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 30_000_000


def test_files_that_applications_share_are_parsed_once_a_task(spark, tmp_path):
    """A file's rows do not depend on its application; each application has them all."""
    log = str(tmp_path / "parsed")

    def parse(app, path, text):
        with open(log, "a") as f:
            f.write(f"{path}\n")
        yield from ((app, path, n) for n in range(len(text)))

    files = spark.range(3000).select(F.concat(F.lit("a"), "id").alias("app"), F.when(F.col("id") % 3 == 0, "x.py").otherwise("y.py").alias("path"), F.when(F.col("id") % 2 == 0, "ab").when(F.col("id") % 5 != 0, "abcd").alias("text"))
    got = C.parsed(files, parse, "app string, path string, n int")
    want = files.select("app", "path", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("n"))
    x = got.collect()
    assert sorted(map(tuple, x)) == sorted(map(tuple, want.collect()))
    assert len(open(log).readlines()) <= 6 * got.rdd.getNumPartitions()


def test_long_files_are_parsed_in_parts_and_not_kept(spark):
    n = C.FACTS_AT_ONCE + 100
    files = spark.createDataFrame([(a, "x.py", "def f():\n    g()\n" * n) for a in ("p", "q")], "app string, path string, text string")
    assert {(r.app, r.kind): r["count"] for r in C.facts(files).where("kind in ('function', 'call')").groupBy("app", "kind").count().collect()} == {(a, k): n for a in ("p", "q") for k in ("function", "call")}


def test_joins_over_code_facts_broadcast_nothing(spark):
    """Both sides grow with the applications, and the driver builds what is broadcast."""
    import __spark_entry__ as E

    for name in ("missing_auth", "symbol_lookup"):
        x = E.queries()[name](spark, "/root/testdata/sf0.001")
        x.collect()
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "Join" in plan, name


def test_parts_are_dealt_out_and_their_source_is_read_once(spark):
    import __spark_entry__ as E

    x = E.queries()["code_line_numbers"](spark, "/root/testdata/sf0.001")
    assert x.rdd.getNumPartitions() > 1
    assert str(x._jdf.queryExecution().optimizedPlan()).count("source_marks(") == 1


def test_lengths_of_a_stemmed_search_need_no_stems(spark):
    import __spark_entry__ as E

    x = E.queries()["bm25_porter"](spark, "/root/testdata/sf0.001")
    plan = str(x._jdf.queryExecution().optimizedPlan())
    lengths = [line for line in plan.splitlines() if "avg(length" in line]
    assert lengths
    for line in lengths:
        below = plan[plan.index(line) + len(line):].split("Relation", 1)[0]
        assert "stems(" not in below
