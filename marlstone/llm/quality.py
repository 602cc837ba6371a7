"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

A text's words are its runs of letters and digits and its runs of other marks, case kept; words and pairs of
neighbours, and whether a word repeats one of the two before it, are hashed to 2**BITS weights. A feature's value is its share of the text's n-grams, so a score
is a sparse dot product that does not grow with the length. Training takes at most TRAIN_ROWS labelled
rows (those with the smallest hash of their id; a documented bound that keeps the training in one task, in a
fixed order, so that a repeated run learns the same weights);
all else is one pass over whole texts.

Defined results: a null or empty text has no features and gets the bias's score; labels that are null, or
not 0 or 1, are not learnt from; without labels every score is 0.5; rows are independent, so repeated rows,
repeated or null ids (held_out false) and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import _text as T

BITS = 18
TRAIN_ROWS = 6000
EPOCHS = 8
SCALE = 10.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-3, 1e-3
FOLDS, HELD_OUT = 5, 0
ACCEPT = 0.3

_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x30:0x3A] = _KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0x80:] = 1


def features(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a block of texts and their offsets by row."""
    w = T.runs(data, rows, _KIND)
    h = T.word_hashes(w)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(w.first))
    found, of = [h], [row]
    for gap in (1, 2):
        inside = np.flatnonzero(row[gap:] == row[:-gap])
        if gap == 1 and len(inside):
            found.append(T.grams(h, 2)[inside])
            of.append(row[inside])
        # the n-gram of back references: whether a word is the one before it, or the one before that, whatever word it is
        found.append(T.mix((h[inside] == h[inside + gap]).astype(np.uint64) + np.uint64(10 * gap)))
        of.append(row[inside])
    every, of = np.concatenate(found) & np.uint64((1 << BITS) - 1), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return every[order].astype(np.int64), np.searchsorted(of[order], np.arange(len(rows)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias from (indices, values, label) rows: proximal updates, one row at a time."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(7)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            i, x, y = rows[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            g2 = g * g
            z[i] += g - (np.sqrt(n[i] + g2) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g2
    w = weights(np.arange(len(z)))
    return w[:-1].astype(np.float32), float(w[-1])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for i, j, data, offsets in T.blocks(batch.column(0)):
            idx, first = features(data, offsets)
            for k, y in zip(range(j - i), batch.column(1).slice(i, j - i).to_pylist(), strict=True):
                at, count = np.unique(idx[first[k] : first[k + 1]], return_counts=True)
                x = count * (SCALE / max(1, count.sum()))
                rows.append((np.append(at, 1 << BITS), np.append(x, 1.0), y))
    w, b = ftrl(rows)
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b], pa.float64())], ["w", "b"])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Learn from labels (doc_id, quality) outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & ~held_out("doc_id"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "y").limit(TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")
    model = rows.repartition(1).sortWithinPartitions("text", "y").mapInArrow(_train, "w binary, b double").collect()
    if not model:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(model[0]["w"], np.float32), model[0]["b"]


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float], name: str = "score") -> DataFrame:
    """docs' columns and, under a name that docs must not have, the score."""
    shared = spark.sparkContext.broadcast(model)
    at, names = docs.columns.index("text"), [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            for i, j, data, rows in T.blocks(batch.column(at)):
                idx, first = features(data, rows)
                total = np.concatenate(([0.0], np.cumsum(w[idx], dtype=np.float64)))
                x = b + SCALE * (total[first[1:]] - total[first[:-1]]) / np.maximum(1, np.diff(first))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))], names)

    schema = docs.schema
    return docs.mapInArrow(run, type(schema)([*schema.fields]).add(name, "double"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(spark, docs, train(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
