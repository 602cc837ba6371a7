"""Pairs that share many cells are made once, and what spans them loses none."""

import random

import numpy as np

from marlstone.llm import count_tree


def test_pairs_across_components_are_made_once(spark, monkeypatch):
    rng, made = random.Random(11), []
    base = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(base + [f"d{rng.randrange(10**9)}" for _ in range(36)])) for i in range(24)]  # just not alike: 397 of 469
    docs += [(100, docs[0][1] + " more"), (101, docs[5][1] + " more")]  # alike to one each
    ordered = count_tree._ordered
    monkeypatch.setattr(count_tree, "_ordered", lambda pairs: made.append((pairs.select("a", "b").count(), pairs.select("a", "b").distinct().count())) or ordered(pairs))
    got = {r["doc_id"]: r["component_id"] for r in count_tree.similar(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: {100: 0, 101: 5}.get(i, i) for i, _ in docs}
    rows, pairs = made[-1]
    assert rows == pairs > 0


def test_spans_connect_what_pairs_connect():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(2, 30))
        spans, found, root = count_tree.Spans(n), [], list(range(n))
        for k in range(n):
            others = np.flatnonzero(rng.random(n) < 0.05)
            if len(others):
                found += spans.join(k, others)
                for o in others:
                    root = [min(root[k], root[o]) if r in (root[k], root[o]) else r for r in root]
        assert len(found) == n - len(set(root))
        by = list(range(n))
        for p, q in found:
            by = [min(by[p], by[q]) if r in (by[p], by[q]) else r for r in by]
        assert by == root
