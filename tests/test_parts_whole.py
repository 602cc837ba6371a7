"""What reads a part as a stream finds a key's rows together, whatever Spark makes of the joins below once it knows their sizes."""

import hashlib
import random
import uuid

import pytest

from marlstone.operators import ordered as O
from marlstone.operators import stored_index as I
from marlstone.operators.search import bm25
from marlstone.sources.work import shared_folder


LATE = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "100k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def late_broadcasts(spark):
    """Joins are planned by shuffles; a side of less than 100 KB is broadcast once it is there, and the other is then read as its tasks wrote it, in several parts."""
    for name, value in LATE.items():
        spark.conf.set(name, value)
    yield
    for name in LATE:
        spark.conf.unset(name)


@pytest.mark.parametrize("share", [None, 1, 2])
def test_a_stored_search_sums_whole_documents(spark, late_broadcasts, share):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(rnd.choices([f"w{j}" for j in range(90)], k=60))) for k in range(400)], "id long, text string")
    queries = spark.createDataFrame([(q, [f"w{j}" for j in range(q, 90, 3)]) for q in range(3)], "query_id int, terms array<string>")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    I.append(docs, "id", {"text": 1.0}, path, 8)
    allowed = None if share is None else docs.where(f"id % {share} = 0").select("id")
    every = bm25(docs, "id", {"text": 1.0}, queries, 400).collect()
    want = []
    for q in range(3):
        of = sorted((r for r in every if r.query_id == q and (share is None or r.id % share == 0)), key=lambda r: r["rank"])
        want += [(q, n + 1, r.id, round(r.score, 8)) for n, r in enumerate(of[:5])]
    got = sorted((r.query_id, r["rank"], r.key, round(r.score, 8)) for r in I.search(spark, path, queries, 5, allowed).collect())
    assert got == want


def test_a_group_is_one_group_after_a_join_by_it(spark, late_broadcasts):
    rows = spark.range(0, 20000, 1, 8).selectExpr("id % 40 AS g", "id", "concat('text of ', id) AS t")
    named = spark.range(40).selectExpr("id AS g").distinct()
    got = {r.g: r.sha256 for r in O.digests(rows.join(named, "g"), ["g"], ["id"], "t").collect()}
    assert O.digests(rows.join(named, "g"), ["g"], ["id"], "t").count() == 40
    assert got == {g: hashlib.sha256("".join(f"text of {i}" for i in range(g, 20000, 40)).encode()).hexdigest() for g in range(40)}
