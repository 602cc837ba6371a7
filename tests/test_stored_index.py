"""The stored index finds what the search over texts finds, and reads less."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from marlstone.operators import stored_index as I
from marlstone.operators.search import bm25
from marlstone.sources.work import shared_folder

W = {"text": 1.0, "title": 2.5}


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(60)], k=rnd.randint(0, 40))), rnd.choice(words)) for k in range(300)]
    rows += [(400, None, "w3"), (401, "", None), (402, "w59 " * 30, "w59"), (None, "w1 w2", "w1")]
    return spark.createDataFrame(rows, "id long, text string, title string")


@pytest.fixture(scope="module")
def queries(spark):
    rows = [(1, ["w0", "w59"]), (2, ["w1", "w1", "w2", "none"]), (3, ["w40", "w41", "w42", "w0"]), (4, []), (5, None), (6, ["absent", None]), (7, [f"w{k}" for k in range(60)])]
    return spark.createDataFrame(rows, "query_id int, terms array<string>")


def rows(df, key="key"):
    return sorted((r.query_id, r["rank"], r[key], round(r.score, 8)) for r in df.collect())


def test_appends_equal_one_search_over_all_texts(spark, corpus, queries):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    assert I.search(spark, path, queries, 3).count() == 0
    I.append(corpus.where("id % 3 = 0"), "id", W, path, 16)
    I.append(corpus.where("false"), "id", W, path, 16)
    I.append(corpus.where("text is null or text = ''"), "id", W, path, 16)
    I.append(corpus, "id", W, path, 16)
    I.append(corpus, "id", W, path, 16)  # nothing is new
    assert I.segments(spark, path).count() == 3 and I.segments(spark, path).agg(F.sum("corpus")).head()[0] == corpus.where("id is not null").count()
    for k in (1, 3, 50):
        assert rows(I.search(spark, path, queries, k)) == rows(bm25(corpus.where("id is not null"), "id", W, queries, k), "id")
    # a list of ids: frequencies stay those of the index
    ids = corpus.where("id % 7 = 1").select("id")
    every = bm25(corpus.where("id is not null"), "id", W, queries, 1000).join(ids, "id").collect()
    want = [(q, n + 1, r["id"], round(r.score, 8)) for q in {r.query_id for r in every} for n, r in enumerate(sorted((r for r in every if r.query_id == q), key=lambda r: r["rank"])[:4])]
    assert rows(I.search(spark, path, queries, 4, ids)) == sorted(want)


def test_a_failed_append_leaves_the_index(spark, corpus, queries):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    I.append(corpus.where("id < 200"), "id", W, path)
    before = rows(I.search(spark, path, queries, 5))
    # as a driver that dies before the commit leaves it
    stray = spark.createDataFrame([(900, 5)], "key long, length long")
    stray.write.parquet(f"{path}/documents/segment=slost")
    broken = corpus.withColumn("text", F.when(F.col("id") == 250, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        I.append(broken, "id", W, path)
    assert rows(I.search(spark, path, queries, 5)) == before
    I.append(corpus, "id", W, path)
    assert rows(I.search(spark, path, queries, 5)) == rows(bm25(corpus.where("id is not null"), "id", W, queries, 5), "id")


def test_chunks_below_the_floor_are_not_read(spark, corpus, queries):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    I.append(corpus, "id", W, path, 4)
    blocks, asked = I._wanted(spark, path, queries)
    live = {(r.query_id, r.live): r["count"] for r in I.live_chunks(blocks, asked, I._floors(blocks, asked, 3, None)).groupBy("query_id", "live").count().collect()}
    assert live[1, False] > live[1, True] and live[3, False] > 0


def test_a_search_reads_no_text(spark, corpus, queries):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    I.append(corpus, "id", W, path)
    files = I.search(spark, path, queries, 3).inputFiles()
    assert files and all("/blocks/" in f or "/segments/" in f or "/documents/" in f for f in files)


def test_a_search_deals_no_scores_out_by_query_and_document(spark, corpus, queries):
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    I.append(corpus, "id", W, path, 16)
    for allowed in (None, corpus.where("id % 2 = 0").select("id")):
        found = I.search(spark, path, queries, 3, allowed)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and not any("Aggregate [query_id" in line and "key#" in line.split("]")[0] for line in plan.splitlines())
