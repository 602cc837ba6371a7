"""Line dedup by content-defined chunks of lines.

A rolling hash runs over the hashes of a text's lines that have words, two lines wide, so each joint of two
neighbouring lines has a value that depends on them alone and that no insertion elsewhere shifts. All places of a value in the
corpus give it a mark (their number and which documents they are in). Boundaries are where the mark changes or the value has one place only;
a chunk is the run of lines between two boundaries. A passage that stands in several documents has the same mark from its first joint to its
last one, whatever stands beside it, so it is one chunk at each of its places. A line of LONG_LINE words or more is a chunk by itself too, as it is a passage
written without line ends.

A chunk is hashed, met and compared byte by byte as a whole. Its first place (smallest document id, then position) stays
whole: a line goes only where it lies in a repeated chunk and in no chunk that has its first place here. So each chunk
that goes stands whole in the result, at its first place.

Marks and first places are aggregated before the shuffle; chunks meet the first place's text in joins that AQE can
split, so a chunk that a third of all documents share does not land in one task.

Defined results: a null text stays null, an empty one is one empty line; a document that consists of repeated
chunks only becomes an empty text; rows with the same id and text count as one document and keep the same
lines; null ids come first; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from marlstone.llm import _text as T
from marlstone.llm._work import Work

LONG_LINE = 50
_LONG = np.uint64(0xA0761D6478BD642F)
_KEY = ["_id", "_key"]


class Lines(NamedTuple):
    start: np.ndarray  # of each line, in bytes of the block
    end: np.ndarray  # without the line end
    words: np.ndarray
    first: np.ndarray  # row i's lines are first[i]:first[i + 1]


class Units(NamedTuple):
    """What is compared: joints (a line and the next one with words) and long lines."""

    line: np.ndarray  # number in the block of the unit's first line
    last: np.ndarray  # and of its last one
    idx: np.ndarray  # the unit's number in its row: twice the first line's among those with words, plus one for a long line
    row: np.ndarray


def lines(data: np.ndarray, rows: np.ndarray) -> Lines:
    n = len(rows) - 1
    newline = np.flatnonzero(data == 10)
    # a line starts at each row's start and after each line end; a row's last line may be empty
    start = np.concatenate((rows[:-1], newline + 1))
    row = np.concatenate((np.arange(n), np.searchsorted(rows, newline, "right") - 1))
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    last = np.ones(len(start), bool)
    last[:-1] = row[1:] != row[:-1]
    end = np.empty_like(start)
    end[~last] = start[1:][~last[:-1]] - 1 if len(start) > 1 else 0
    end[last] = rows[1:]
    w = T.words(data, rows, lower=False)
    return Lines(start, end, np.searchsorted(w.start, end) - np.searchsorted(w.start, start), np.searchsorted(row, np.arange(n + 1)))


def units(x: Lines) -> Units:
    row = np.repeat(np.arange(len(x.first) - 1), np.diff(x.first))
    worded, long = np.flatnonzero(x.words > 0), np.flatnonzero(x.words >= LONG_LINE)
    joint = np.flatnonzero(row[worded[1:]] == row[worded[:-1]])
    line, last = np.concatenate((worded[joint], long)), np.concatenate((worded[joint + 1], long))
    number = np.searchsorted(worded, line) - np.searchsorted(worded, x.first[row[line]])
    return Units(line, last, number * 2 + (line == last), row[line])


def hashes(data: np.ndarray, x: Lines, u: Units) -> np.ndarray:
    h = T.span_hashes(data, x.start, x.end)
    both = T.mix(h[u.line] * np.uint64(0x9FB21C651E98DF25) + h[u.last])
    return np.where(u.line == u.last, T.mix(h[u.line] ^ _LONG), both)


def _worded(x: Lines, r: int) -> np.ndarray:
    """The lines of a row that have words."""
    return np.flatnonzero(x.words[x.first[r] : x.first[r + 1]] > 0) + x.first[r]


def _ends(a: int, b: int) -> tuple[int, int]:
    """The lines with words, by number among those, from which and before which a chunk of the units a to b goes."""
    return a // 2, b // 2 + (1 if b % 2 else 2)


def _bytes(data: np.ndarray, x: Lines, worded: np.ndarray, a: int, b: int) -> bytes:
    """A chunk's bytes, without the blank lines inside."""
    i, j = _ends(a, b)
    return b"\n".join(data[x.start[k] : x.end[k]].tobytes() for k in worded[i:j].tolist())


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, data, rows in T.blocks(batch.column("text")):
            x = lines(data, rows)
            u = units(x)
            row = pa.array(u.row + i)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(row), batch.column("_key").take(row), pa.array(u.idx.astype(np.int32)), pa.array(hashes(data, x, u).view(np.int64))],
                [*_KEY, "idx", "h"],
            )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each document, from (_id, _key, units of several places): hash, first and last unit."""
    for batch in batches:
        found = batch.column("units")
        flat, size = found.flatten(), np.diff(found.offsets.to_numpy())
        idx, h, mark = (flat.field(k).to_numpy() for k in range(3))
        row = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((idx, idx & 1, row))
        row, idx, h, mark = row[order], idx[order], h[order].view(np.uint64), mark[order]
        once = np.ones(len(idx), bool)  # a repeated row has each of its units twice
        once[1:] = (row[1:] != row[:-1]) | (idx[1:] != idx[:-1])
        row, idx, h, mark = row[once], idx[once], h[once], mark[once]
        new = np.ones(len(idx), bool)
        new[1:] = (row[1:] != row[:-1]) | (idx[1:] - idx[:-1] != 2) | (mark[1:] != mark[:-1]) | (idx[1:] & 1 == 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(idx))[: len(begin)]
        place = np.arange(len(idx)) - np.repeat(begin, end - begin)
        parts = T.mix(h ^ T.mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        whole = np.add.reduceat(parts, begin) if len(begin) else parts
        of = pa.array(row[begin])
        cols = [pa.array(T.mix(whole + (end - begin).astype(np.uint64)).view(np.int64)), batch.column("_id").take(of), batch.column("_key").take(of), pa.array(idx[begin]), pa.array(idx[end - 1] if len(begin) else idx)]
        yield pa.RecordBatch.from_arrays(cols, ["h", *_KEY, "a", "b"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted chunks, with their places: from (_id, _key, text, wanted)."""
    for batch in batches:
        wanted = batch.column("wanted")
        for i, j, data, rows in T.blocks(batch.column("text")):
            x = lines(data, rows)
            h, at, of, out = [], [], [], []
            for r in range(j - i):
                worded = _worded(x, r)
                for y in wanted[i + r].as_py():
                    h.append(y["h"])
                    at.append(y["a"])
                    of.append(i + r)
                    out.append(_bytes(data, x, worded, y["a"], y["b"]))
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), batch.column("_id").take(of), batch.column("_key").take(of), pa.array(at, pa.int32()), pa.array(out, pa.binary())], ["h", "c_id", "c_key", "c_a", "chunk"]
            )


def _gone(data: np.ndarray, x: Lines, r: int, found: list[dict]) -> list[int]:
    """The lines of a row that go. A chunk without bytes has its first place here and stays."""
    worded, out = _worded(x, r), set()
    for y in found:
        if y["chunk"] is not None and _bytes(data, x, worded, y["a"], y["b"]) == y["chunk"]:
            i, j = _ends(y["a"], y["b"])
            out.update(range(worded[i], worded[j - 1] + 1))
    for y in found:
        if y["chunk"] is None:
            i, j = _ends(y["a"], y["b"])
            out.difference_update(range(worded[i], worded[j - 1] + 1))
    return sorted(out)


def _rewriter(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeats, texts = batch.column("_repeats"), batch.column("text")
            for i, j, data, rows in T.blocks(texts):
                x = lines(data, rows)
                new, all_lines, gone_lines, gone_words = [], [], [], []
                for r in range(j - i):
                    a, b = int(x.first[r]), int(x.first[r + 1])
                    gone = _gone(data, x, r, found) if (found := repeats[i + r].as_py()) else []
                    if not texts[i + r].is_valid:
                        new.append(None)
                    elif gone:
                        out = set(gone)
                        new.append(b"\n".join(data[x.start[k] : x.end[k]].tobytes() for k in range(a, b) if k not in out).decode("utf-8", "replace"))
                    else:
                        new.append(data[rows[r] : rows[r + 1]].tobytes().decode("utf-8", "replace"))
                    all_lines.append(b - a)
                    gone_lines.append(len(gone))
                    gone_words.append(int(x.words[gone].sum()))
                part = batch.slice(i, j - i)
                cols = [pa.array(new, pa.string()) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(all_lines, pa.int64()), pa.array(gone_lines, pa.int64()), pa.array(gone_words, pa.int64())], [*names, "_lines", "_gone_lines", "_gone_words"])

    return run


def rewrite(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and any others) without the repeated chunks, then three more columns: lines, lines and words taken out.

    Inside, the columns have names of their own, so docs may have any; the last three are to be renamed or dropped by position.
    """
    work = Work(spark, "lines")
    names = ["doc_id" if c == "doc_id" else "text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    plain = docs.toDF(*names)
    keyed = plain.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("_key", F.xxhash64("doc_id", "text"))
    text = keyed.select(*_KEY, "text")
    rows = work.save(text.mapInArrow(_hashes, "_id long, _key long, idx int, h long"))
    marks = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*_KEY)).alias("where")).where("n > 1")
    marks = work.save(marks.select("h", F.xxhash64("n", "where").alias("mark")))
    units = rows.join(marks, "h").groupBy(*_KEY).agg(F.collect_list(F.struct("idx", "h", "mark")).alias("units"))
    chunks = work.save(units.mapInArrow(_chunks, "h long, _id long, _key long, a int, b int"))
    twice = chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_KEY, "a", "b")).alias("c")).where("n > 1").select("h", "c.*")
    wanted = twice.groupBy(*_KEY).agg(F.collect_list(F.struct("h", "a", "b")).alias("wanted"))
    firsts = text.join(wanted, _KEY).mapInArrow(_texts, "h long, c_id long, c_key long, c_a int, chunk binary")
    firsts = work.save(firsts.dropDuplicates(["h"]))
    here = F.expr("_id = c_id and _key = c_key and a = c_a")
    again = chunks.join(firsts, "h").select(*_KEY, "a", "b", F.when(~here, F.col("chunk")).alias("chunk"))
    again = work.save(again.groupBy(*_KEY).agg(F.collect_list(F.struct("a", "b", "chunk")).alias("_repeats")))
    work.drop(rows, marks, chunks, firsts)
    schema = K.StructType([*plain.schema.fields]).add("_lines", "long").add("_gone_lines", "long").add("_gone_words", "long")
    out = keyed.join(again, _KEY, "left").select(*names, "_repeats").mapInArrow(_rewriter(names), schema)
    return out.toDF(*docs.columns, "_lines", "_gone_lines", "_gone_words")


def line_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, removed_lines, removed_words, text) for each row of docs (doc_id, text)."""
    out = rewrite(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_gone_lines").alias("removed_lines"), F.col("_gone_words").alias("removed_words"), "text")
