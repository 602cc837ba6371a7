"""Benchmark decontamination by greedy string tiling.

Benchmark items are a stated query set: they are taken in blocks of about BLOCK_BYTES of text (dealt by hash; an item is never
cut), each block's words are broadcast, and all documents run against it in a map without a shuffle. Runs of MIN_MATCH
words that a document shares with an item are the seeds, met by a sorted merge of their hashes. Every tile is made of seeds, so an item of which the
seeds' places cover less than THRESHOLD cannot be contained, and is not tiled: a run of words that all documents and items share costs a count. For the others, running
Karp-Rabin finds the longest common runs of words not yet covered, marks them, and goes on with shorter
ones down to MIN_MATCH words. Hashes of runs of any length come from those of powers of two, and the longest common length
from a binary search, so repetitive texts take no longer than others. Tiles may stand in any order, so reordered passages count. An item is
contained where its tiles cover THRESHOLD of its words or more.

Words are runs of letters and digits, A-Z lower-cased, so other marks and line ends do not matter. An item of fewer
than MIN_MATCH words must occur whole.

Defined results: null and empty texts and items have no words and match nothing; each row of documents is
matched on its own, so repeated rows repeat their matches; rows of the benchmark that are equal are matched
once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import _text as T

MIN_MATCH = 5
THRESHOLD = 0.6
#: Places of seeds in items that are looked at in one go.
PLACES = 1 << 20
BLOCK_BYTES = 4 << 20
_SCHEMA = "doc_id long, item_id long, n_words long, covered_words long, n_tiles long, coverage double"


_INDEXES: dict[str, Index] = {}


class Runs:
    """Hashes of a word sequence's runs of any length, each from two runs of a power of two."""

    def __init__(self, words: np.ndarray):
        self.levels, self.marked = [words], np.zeros(len(words), bool)

    def __len__(self) -> int:
        return len(self.marked)

    def free(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs of `size` words of which none is marked. Marked stretches are at least as long."""
        at = np.arange(len(self) - size + 1)
        at = at[~(self.marked[at] | self.marked[at + size - 1])]
        k = size.bit_length() - 1
        while len(self.levels) <= k:
            low, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(T.mix(low[:-step] * np.uint64(0x9FB21C651E98DF25) + low[step:]))
        low, rest = self.levels[k], size - (1 << k)
        return at, low[at] if not rest else T.mix(low[at] * np.uint64(0xA0761D6478BD642F) + low[at + rest])


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, words) of the greedy tiling of two word sequences: longest first, ties by their places."""
    least = max(1, min(least, len(item)))
    a, b, out = Runs(item), Runs(doc), []
    high = min(len(item), len(doc))
    while high >= least:
        low, found = least - 1, None  # a run of `low` words is common, and none longer than `high`
        size, grow = least, True
        while low < high:
            (i, g), (j, h) = a.free(size), b.free(size)
            common = np.intersect1d(g, h)
            if len(common):
                low, found = size, (size, i, g, j, h, common)
            else:
                high, grow = size - 1, False
            size = min(high, 2 * low) if grow else (low + high + 1) // 2
        if found is None:
            return out
        size, i, g, j, h, common = found
        there = np.isin(h, common)
        j, h = j[there], h[there]
        order = np.argsort(h, kind="stable")
        j, h = j[order].tolist(), h[order]
        here = np.isin(g, common)
        begin = dict(zip(common.tolist(), np.searchsorted(h, common).tolist(), strict=True))
        end = dict(zip(common.tolist(), np.searchsorted(h, common, "right").tolist(), strict=True))
        for x, key in zip(i[here].tolist(), g[here].tolist(), strict=True):
            if a.marked[x] or a.marked[x + size - 1]:
                continue
            k = begin[key]
            while k < end[key] and (b.marked[j[k]] or b.marked[j[k] + size - 1]):
                k += 1  # what is marked stays so
            begin[key] = k
            if k < end[key]:
                a.marked[x : x + size] = b.marked[j[k] : j[k] + size] = True
                out.append((x, j[k], size))
        high = size - 1
    return out


class Index:
    """The items of a block by their seeds: sorted hashes beside the items' numbers."""

    def __init__(self, items: list[tuple[int | None, str]]):
        texts = [text.encode() for _, text in items]
        rows = np.cumsum([0, *map(len, texts)])
        w = T.words(np.frombuffer(b"".join(texts), np.uint8), rows, T.ALNUM)
        h = T.word_hashes(w)
        self.items = [(item_id, h[a:b]) for (item_id, _), a, b in zip(items, w.first[:-1], w.first[1:], strict=True)]
        counts = np.diff(w.first)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint64]] = {}
        for size in sorted({min(MIN_MATCH, int(n)) for n in counts if n}):
            of = np.flatnonzero((counts >= size) if size == MIN_MATCH else (counts == size))
            g = T.grams(h, size)
            at = np.concatenate([np.arange(w.first[k], w.first[k + 1] - size + 1) for k in of])
            item = np.repeat(of, counts[of] - size + 1)
            order = np.lexsort((at, g[at]))
            keys = g[at][order]
            bits = max(20, 4 + len(keys).bit_length())
            maybe = np.zeros(1 << bits, bool)
            maybe[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.seeds[size] = keys, item[order], (at - w.first[item])[order], maybe, np.uint64(64 - bits)

    def candidates(self, h: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """(row, item) whose shared seeds cover the threshold of the item's words; rows in order within a size of seeds."""
        sizes = np.array([len(item) for _, item in self.items], np.int64)
        for size, (keys, items, places, maybe, shift) in self.seeds.items():
            g = T.grams(h, size)
            at = np.flatnonzero(maybe[(g >> shift).astype(np.int64)])
            at = at[np.searchsorted(keys, g[at]) < np.searchsorted(keys, g[at], "right")]
            row = np.searchsorted(first, at, "right") - 1
            inside = at + size <= first[row + 1]
            at, row = at[inside], row[inside]
            # each seed of a row once, then the places in items that have it
            one = np.unique(np.stack((row.astype(np.uint64), g[at])), axis=1)
            lo, hi = np.searchsorted(keys, one[1]), np.searchsorted(keys, one[1], "right")
            row, n = one[0].astype(np.int64), hi - lo
            # a row has each place of the block at most once, so a group of rows is bounded by PLACES and the block's size
            upto, begin = np.concatenate(([0], np.cumsum(n))), np.flatnonzero(np.diff(row, prepend=-1))
            i = 0
            while i < len(begin):
                full = int(np.searchsorted(upto[begin], upto[begin[i]] + PLACES, "right"))
                j = max(i + 1, min(full, len(begin)))
                a, b = begin[i], begin[j] if j < len(begin) else len(row)
                m = n[a:b]
                where = np.repeat(lo[a:b] - np.cumsum(m) + m, m) + np.arange(m.sum())
                pair, place = np.repeat(row[a:b], m) * len(self.items) + items[where], places[where]
                order = np.lexsort((place, pair))
                pair, place = pair[order], place[order]
                new = np.ones(len(pair), bool)
                new[1:] = pair[1:] != pair[:-1]
                reach = np.full(len(pair), size, np.int64)
                reach[:-1] = np.where(new[1:], size, np.minimum(size, place[1:] - place[:-1]))
                start = np.flatnonzero(new)
                bound = np.add.reduceat(reach, start) if len(start) else reach
                for p in pair[start[bound >= threshold * sizes[pair[start] % len(self.items)]]].tolist():
                    yield divmod(p, len(self.items))
                i = j

    def contained(self, data: np.ndarray, rows: np.ndarray, threshold: float) -> Iterator[tuple[int, int | None, int, int, int, float]]:
        """(row, item id, its words, those covered, tiles, coverage) for a block of texts."""
        w = T.words(data, rows, T.ALNUM)
        h = T.word_hashes(w)
        for r, k in self.candidates(h, w.first, threshold):
            item_id, item = self.items[k]
            made = tiles(item, h[w.first[r] : w.first[r + 1]])
            covered = sum(n for _, _, n in made)
            if covered >= threshold * len(item):
                yield r, item_id, len(item), covered, len(made), covered / len(item)


def _index(block: tuple[str, list[tuple[int | None, str]]]) -> Index:
    """A worker keeps the index of the block that it saw last."""
    if block[0] not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[block[0]] = Index(block[1])
    return _INDEXES[block[0]]


def _items(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about BLOCK_BYTES, whatever the size of the benchmark."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and text <> ''").distinct()
    total = known.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for k in range(blocks):
        yield [tuple(r) for r in known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each document and item whose tiles cover the threshold: (doc_id, item_id, n_words, covered_words, n_tiles, coverage)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in _items(benchmark):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared.value)
            for batch in batches:
                ids = batch.column(0)
                for i, _, data, rows in T.blocks(batch.column(1)):
                    found = [(ids[i + r].as_py(), *rest) for r, *rest in index.contained(data, rows, threshold)]
                    cols = list(zip(*found, strict=True)) if found else [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 5 + [pa.float64()], strict=True)], ["doc_id", "item_id", "n_words", "covered_words", "n_tiles", "coverage"])

        part = docs.mapInArrow(run, _SCHEMA)
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], _SCHEMA)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that contain no item of the benchmark, with all their columns; a map, so nothing is shuffled."""
    at, schema = docs.columns.index("text"), docs.schema
    for items in _items(benchmark):
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, _, data, rows in T.blocks(batch.column(at)):
                    keep[[i + r for r, *_ in index.contained(data, rows, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
