"""The Jaccard join over R-trees against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from marlstone.llm.count_tree import Bands, cells, similar

SCHEMA = "doc_id long, text string, component_id string, cell string"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def plainly(docs, percent):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [(i, len(s), None if i is None else find(i)) for i, s in sets]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))


def corpus(rng):
    word = lambda: f"w{rng.randrange(4000)}"
    docs = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([5, 8, 9, 10, 12, 30, 120, 400, 900]))]
        for _ in range(rng.choice([2, 5, 40])):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 25)):
                text[rng.randrange(len(text))] = word()
            text += [word() for _ in range(rng.randrange(0, 1 + len(base) // 12))]
            docs.append(rng.choice(" \n").join(text) if family % 2 else " ".join(text).upper())
    docs += [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    docs += ["same few words here"] * 40 + ["a", "a", "A b", "", None, "   ", "a b c"]
    docs += [" ".join(str(i) for i in range(9)), " ".join(str(i) for i in range(10))]  # six shingles in seven: just alike
    rng.shuffle(docs)
    rows = list(enumerate(docs))
    return rows + [(None, docs[0]), (3, rows[3][1]), (5000, " ".join(f"x{i}" for i in range(60_000))), (5001, " ".join(f"x{i}" for i in range(63_000)))]


@pytest.mark.parametrize(("percent", "leaf"), [(85, 512), (85, 3), (70, 8)])
def test_join_equals_all_pairs(spark, percent, leaf):
    docs = corpus(random.Random(percent + leaf))
    table = spark.createDataFrame([(i, t, "own", "own") for i, t in docs], SCHEMA)
    got = similar(spark, table, percent, leaf).collect()
    assert order(got) == order(plainly(docs, percent))


def test_every_allowed_pair_meets_in_a_cell():
    rng = np.random.default_rng(3)
    for percent in (70, 85, 95):
        bands = Bands(percent)
        for _ in range(300):
            n = int(rng.integers(5, 400))
            a = rng.integers(1, 1 << 62, n).astype(np.uint64)
            gone = int(rng.integers(0, 1 + n * (100 - percent) // 60))
            b = np.concatenate((a[gone:], rng.integers(1, 1 << 62, int(rng.integers(0, gone + 2))).astype(np.uint64)))
            a, b = np.unique(a), np.unique(b)
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * both < percent * either or both == either:
                continue
            keys = []
            for s in (a, b):
                mine = {bands.of(len(s)), bands.of(bands.largest_partner(len(s)))}
                keys.append(np.concatenate([cells(s, x, *bands.limits(x)) for x in mine if bands.limits(x)[0]]))
            assert len(np.intersect1d(*keys))


def test_empty_table(spark):
    assert similar(spark, spark.createDataFrame([], SCHEMA)).collect() == []
