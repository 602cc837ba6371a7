"""Importance resampling against a plain restatement."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from marlstone.llm.resample import resample

DOCS = "doc_id long, text string, rank string, copies string"


def plainly(docs, target, percent, least, longest):
    low = {c: c + 32 for c in range(65, 91)}

    def split(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))

    def codes(text):
        w = split(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in codes(x)), Counter(b for x in target for b in codes(x))
    n_s, n_t = s.total(), t.total()
    out = []
    for doc, text in docs:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in codes(text)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(split(text))])
    drawn = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def same(got, want):
    order = lambda rows: sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))
    assert order(map(tuple, got)) == order(want)


@pytest.mark.parametrize(("percent", "least", "longest"), [(10, 20, 1), (50, 2, 1), (100, 0, 3), (0, 1, 2)])
def test_resample_equals_a_plain_one(spark, percent, least, longest):
    words = ["alpha", "BETA", "gamma7", "ß", "naïve", "zeta", "Ünder", "x1", "日本", "omega"]
    docs = [(i, " ".join(words[(i * k) % 10] for k in range(i % 31)) + ("." if i % 4 else "")) for i in range(150)]
    docs += [(900 + i, "gamma7 zeta " * 15) for i in range(60)]  # one text holds a third of the rows
    docs += [(5000, None), (5001, ""), (5002, "... --"), (None, "alpha " * 25), (5003, "omega x1 " * 30_000), (900, "gamma7 zeta " * 15)]
    target = ["alpha omega naïve", None, "", "alpha x1 x1"]
    table = spark.createDataFrame([(*d, "own", "own") for d in docs], DOCS)
    got = resample(spark, table, spark.createDataFrame([(x,) for x in target], "text string"), percent, least, longest).collect()
    same(got, plainly(docs, target, percent, least, longest))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample(spark, spark.createDataFrame([], DOCS), none).collect() == []
    docs = [(i, "one two three " * 10) for i in range(20)]
    got = resample(spark, spark.createDataFrame([(*d, "", "") for d in docs], DOCS), none).collect()
    same(got, plainly(docs, [], 10, 20, 1))
