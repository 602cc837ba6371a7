"""Jaccard join of documents' word n-grams over an R-tree of group counts.

A document is the set of its distinct K_WORDS-word shingles; documents with equal sets form a class whose
smallest id stands for it. Shingles are hashed into groups, and a set's counts by group are a point. Two sets
share no more than the sum of the minima of their coordinates, and sets of the wanted similarity share at least
percent / (100 + percent) of both sizes; a tree node keeps the maximum of each coordinate, so the same sum bounds
all pairs of two nodes. Surviving pairs are confirmed on the full sets.

One tree over all documents would meet most pairs of like size, as counts of random groups are all alike. So
the points are dealt into cells first, each with a tree of its own, such that no pair is lost: sets of the wanted similarity
differ in at most D shingles. Shingles are dealt into parts by their hash; where a set fills more than D of them,
one of these has no difference, so the pair meets under that part's digest. D depends on the size, so sizes
go in bands, and a set stands in its own band and, where a partner may be larger, in the next. The few sets that fill
D parts or fewer stand under each of their shingles besides. Cells of one document go, and of cells with equal members one stays.

A cell's points are packed into leaves of LEAF in the order of a range sort (size, then coordinates). Links
are sought in steps, so that a group of copies never becomes all its pairs: in a leaf, each point with its best
earlier one; then, in cells that still hold several components, each point outside the commonest component with its best
partner in another; then all pairs across components that the bound allows. The last step leaves nothing out.

Alike sets share most of their cells, so cells are met only once. What they show besides the best partners is which points
may link across components at all, as a few links that span them: those of a linked group are one more tree, with FINE coordinates. A pair
stands in one group, so the steps that follow make it once and not in each of its cells. None is lost: components
only grow, so a pair across them stood across them, and was allowed, when its cell was met.

Defined results: a null or empty text has no shingles and links with nothing; a row whose id is null is
returned with a null component; rows with the same id count as one document for links and each yields a
row; extra columns are ignored; an empty table gives an empty result. Sets are sets of 64-bit hashes, classes have
equal 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import _text as T
from marlstone.llm._work import Work
from marlstone.llm.components import components

K_WORDS = 4
#: Coordinates of a point.
GROUPS = 128
#: Coordinates of the points that may still link when the cells have been met: counts of long texts are told apart by more groups only.
FINE = 1024
#: The largest count that a coordinate holds.
MOST = 65535
#: Points of a leaf.
LEAF = 512
_ODD = np.uint64(0x9FB21C651E98DF25)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


class Bands:
    """Bands of set sizes: a partner of a set is in the set's band or the next to it."""

    def __init__(self, percent: int):
        self.percent, self.starts, self._limits = percent, [1], {}

    def largest_partner(self, n: int) -> int:
        return n * 100 // self.percent

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            # two steps of the ratio: fewer sets stand in two bands
            self.starts.append(max(self.starts[-1] + 1, self.largest_partner(self.largest_partner(self.starts[-1])) + 1))
        return int(np.searchsorted(self.starts, n, "right")) - 1

    def limits(self, band: int) -> tuple[int, int]:
        """(differences, parts): in how many shingles sets of the band and their smaller partners may differ, and parts to deal them into.

        There are so many parts that the smallest sets fill more of them than there are differences, with a margin of four standard deviations.
        """
        while len(self.starts) <= band + 1:
            self.of(self.starts[-1])
        if band not in self._limits:
            least, most = self.starts[band] * self.percent // 100, self.starts[band + 1] - 1
            differ = 2 * most * (100 - self.percent) // (100 + self.percent)
            parts = differ + 3
            while differ and parts < 8 * most:
                load = least / parts
                spread = (parts * (exp(-load) - (1 + load) * exp(-2 * load))) ** 0.5
                if parts * (1 - exp(-load)) - 4 * spread > differ:
                    break
                parts += 1 + parts // 50
            self._limits[band] = differ, parts
        return self._limits[band]


def _number(x: int) -> int:
    return int(T.mix(np.array([x & _MASK], np.uint64))[0])


def cells(shingles: np.ndarray, band: int, differ: int, parts: int) -> np.ndarray:
    """Keys of the filled parts of a set; where they are too few to outnumber the differences, of each shingle besides."""
    seed = np.uint64(_number(band + 1))
    at = (T.mix(shingles ^ seed) % np.uint64(parts)).astype(np.int64)
    digest = T.mix(np.arange(parts, dtype=np.uint64) * _STEP + seed)
    np.add.at(digest, at, T.mix(shingles * _ODD))
    keys = T.mix(digest[np.unique(at)])
    return keys if len(keys) > differ else np.concatenate((keys, T.mix(shingles ^ np.uint64(_number(~band)))))


def point(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Counts by group, in two bytes each; what exceeds them is known from the set's size."""
    counts = np.bincount((T.mix(shingles + _STEP) % np.uint64(groups)).astype(np.int64), minlength=groups)
    return np.minimum(counts, MOST).astype(np.uint16)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    values = np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sets(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for i, j, data, rows in T.blocks(column):
        yield i, j, T.shingle_sets(T.words(data, rows), K_WORDS)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, sets in _sets(batch.column(1)):
            digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
            h = np.frombuffer(digests, np.int64).reshape(len(sets), 2)
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), n, *(pa.array(np.ascontiguousarray(h[:, k])) for k in range(2))], ["doc_id", "n", "h1", "h2"])


def _cell_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for i, _, sets in _sets(batch.column(1)):
                keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for r, s in enumerate(sets):
                    if not len(s):
                        continue
                    for b in sorted({bands.of(len(s)), bands.of(bands.largest_partner(len(s)))}):
                        differ, parts = bands.limits(b)
                        if differ:  # else only equal sets are alike
                            keys.append(cells(s, b, differ, parts))
                            of.append(np.full(len(keys[-1]), i + r))
                cell, row = np.concatenate(keys), pa.array(np.concatenate(of))
                for a in range(0, len(cell), 1 << 18):
                    part = row.slice(a, 1 << 18)
                    yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + (1 << 18)].view(np.int64)), batch.column(0).take(part)], ["cell", "doc_id"])

    return run


_POINT = "doc_id long, n long, point binary"


def _points(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets in _sets(batch.column(1)):
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([point(s, groups).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], ["doc_id", "n", "point"])

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, sets in _sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(sets)], ["doc_id", "shingles"])


class Members:
    """A column of leaves as flat arrays; leaf i's points are first[i]:first[i + 1]."""

    def __init__(self, column: pa.Array):
        flat = column.flatten()
        self.first = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
        number = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
        self.ids, self.sizes = number("doc_id"), number("n")
        self.own = None if flat.field("component").null_count else number("component")
        counts = T.buffers(flat.field("point"))[0].view(np.uint16)
        self.points = counts.reshape(len(flat), len(counts) // max(1, len(flat)))
        self.excess = self.sizes - self.points.sum(axis=1, dtype=np.int64)


def _bounds(x: Members, k: int, y: Members, a: int, b: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of point k of x and the points a:b of y: whether the bound allows a link, and the share of both sizes that they may have in common."""
    common = np.minimum(x.points[k], y.points[a:b]).sum(axis=1, dtype=np.int64) + np.minimum(x.excess[k], y.excess[a:b])
    both = x.sizes[k] + y.sizes[a:b]
    return common * (100 + percent) >= both * percent, common / both


_FOUND = ["a", "b", "share"]


def _found(a: list[int], b: list[int], share: list[float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(share, pa.float64())], _FOUND)


def _best_earlier(percent: int):
    """Within leaves: each point with the best one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, out = Members(batch.column("members")), ([], [], [])
            for a, b in zip(x.first[:-1].tolist(), x.first[1:].tolist(), strict=True):
                for k in range(a + 1, b):
                    allowed, share = _bounds(x, k, x, a, k, percent)
                    if allowed.any():
                        best = int(np.argmax(np.where(allowed, share, -1)))
                        for column, v in zip(out, (x.ids[k], x.ids[a + best], share[best]), strict=True):
                            column.append(v)
            yield _found(*out)

    return run


class Spans:
    """Links that span what is touched: of so many points, as few pairs as connect them like all pairs told."""

    def __init__(self, points: int):
        self.root = np.arange(points)

    def join(self, k: int, others: np.ndarray) -> list[tuple[int, int]]:
        """The pairs of points that connect point k to others for the first time."""
        roots = np.unique(self.root[np.append(others, k)])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]
        return [(int(roots[0]), int(r)) for r in roots[1:]]


def _across(percent: int, every: bool, spans: bool):
    """Of two leaves: pairs in different components, all or the best of each point; with spans, pairs without a share that connect all points of any pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, out = Members(batch.column("members")), Members(batch.column("more")), ([], [], [])
            for i in range(batch.num_rows):
                (at, end), (a, b) = x.first[i : i + 2].tolist(), y.first[i : i + 2].tolist()
                ids, touched = np.concatenate((x.ids[at:end], y.ids[a:b])), Spans(end - at + b - a)
                for k in range(at, end):
                    allowed, share = _bounds(x, k, y, a, b, percent)
                    allowed &= y.own[a:b] != x.own[k]
                    hits = np.flatnonzero(allowed)
                    if spans and len(hits):
                        for p, q in touched.join(k - at, hits + (end - at)):
                            for column, v in zip(out, (ids[p], ids[q], None), strict=True):
                                column.append(v)
                    if not every and len(hits):
                        hits = hits[[int(np.argmax(share[hits]))]]
                    out[0].extend([x.ids[k]] * len(hits))
                    out[1].extend(y.ids[a + hits])
                    out[2].extend(share[hits])
            yield _found(*out)

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("n"))
    return both.where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b").distinct()


def _leaves(live: DataFrame, points: DataFrame, work: Work, leaf: int) -> DataFrame:
    """(cell, main, leaf, least, top, members): packed points of each cell, those of the commonest component apart."""
    order = ["cell", "main", "n", "point"]
    packed = live.join(points, "doc_id").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    # the upper bits of pos number the partition, so no leaf reaches over two
    packed = work.save(packed.withColumn("leaf", F.expr(f"pos div {leaf}")))
    members = F.array_sort(F.collect_list(F.struct("pos", "doc_id", "n", "component", "point")))
    leaves = packed.groupBy("cell", "main", "leaf").agg(members.alias("members"), F.min("n").alias("least"))
    out = work.save(leaves.mapInArrow(_tops, "cell long, main boolean, leaf long, least long, top array<int>, members array<struct<pos: long, doc_id: long, n: long, component: long, point: binary>>"))
    work.drop(packed)
    return out


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the maximum of each coordinate."""
    for batch in batches:
        members = batch.column("members")
        x, tops = Members(members), []
        for a, b in zip(x.first[:-1], x.first[1:], strict=True):
            tops.append(x.points[a:b].max(axis=0).astype(np.int32))
            tops[-1][0] += x.excess[a:b].max()  # a bound still, as the excess of both nodes counts there
        offsets = pa.array(np.arange(len(tops) + 1, dtype=np.int32) * x.points.shape[1])
        top = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*tops, np.zeros(0, np.int32)]).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cell", "main", "leaf", "least")), top, members], ["cell", "main", "leaf", "least", "top", "members"])


def _may_link(percent: int) -> Column:
    common = F.aggregate(F.zip_with("x.top", "y.top", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda s, v: s + v)
    return common * (100 + percent) >= (F.col("x.least") + F.col("y.least")) * percent


def similar(spark: SparkSession, docs: DataFrame, percent: int = 85, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    Links documents with 100 * |A and B| >= percent * |A or B|; component_id is the smallest doc_id reachable over links.
    """
    work = Work(spark, "tree")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = work.save(docs.mapInArrow(_classes, "doc_id long, n long, h1 long, h2 long"))
    classes = work.save(sig.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")))
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()

    rows = work.save(docs.join(reps, "doc_id", "left_semi").mapInArrow(_cell_rows(percent), "cell long, doc_id long"))
    # sums of 31 bits tell members apart even where an id comes twice
    marks = [F.sum(F.xxhash64("doc_id", F.lit(k)).bitwiseAND(F.lit(2**31 - 1))).alias(f"m{k}") for k in range(3)]
    shared = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), *marks).where("lo < hi")
    chosen = work.save(shared.groupBy("size", "m0", "m1", "m2").agg(F.min("cell").alias("cell")).select("cell", "size"))
    live = work.save(rows.join(chosen, "cell"))
    work.drop(rows, chosen)

    ids = live.select("doc_id").distinct()
    points = work.save(docs.join(ids, "doc_id", "left_semi").mapInArrow(_points(GROUPS), _POINT))
    sets = None

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Looked at on full sets, which are made for documents that stand in a pair."""
        nonlocal sets
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        ids = work.save(ids if sets is None else ids.join(sets.select("doc_id"), "doc_id", "left_anti"))
        more = work.save(docs.join(ids, "doc_id", "left_semi").mapInArrow(_shingles, "doc_id long, shingles array<long>"))
        sets = more if sets is None else sets.unionByName(more)
        return work.save(_confirmed(pairs, sets, percent))

    # each set in its largest cell only: enough to connect nearly all that is alike
    first = live.groupBy("doc_id").agg(F.max_by("cell", F.struct("size", "cell")).alias("cell")).withColumn("main", F.lit(True)).withColumn("component", F.lit(None).cast("long"))
    leaves = _leaves(first, points, work, leaf)
    heads = leaves.select("cell", F.struct("leaf", F.get("members", F.lit(0))["doc_id"].alias("doc_id")).alias("head"))
    roots = heads.groupBy("cell").agg(F.min("head").alias("root"), F.count(F.lit(1)).alias("k")).where("k > 1")
    stars = heads.join(roots, "cell").select(F.col("head.doc_id").alias("a"), F.col("root.doc_id").alias("b"))
    best = leaves.select("members").mapInArrow(_best_earlier(percent), "a long, b long, share double")
    tried = work.save(_ordered(best.select("a", "b").unionByName(stars)))
    work.drop(leaves)
    links = confirmed(tried)
    found = components(links, work)

    for spans, every in ((True, False), (False, False), (False, True)):
        labelled = work.save(live.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("cell", "doc_id", F.coalesce("component", "doc_id").alias("component")))
        share = labelled.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("cell")
        mixed = work.save(share.agg(F.max_by("component", F.struct("c", "component")).alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1").select("cell", "most"))
        if mixed.isEmpty():
            break
        leaves = _leaves(labelled.join(mixed, "cell").select("cell", "doc_id", "component", (F.col("component") == F.col("most")).alias("main")), points, work, leaf)
        nodes = leaves.select("cell", "main", "leaf", "least", "top")
        x, y = nodes.where("NOT main").alias("x"), nodes.alias("y")
        met = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("y.main") | (F.col("x.leaf") <= F.col("y.leaf"))) & _may_link(percent))
        met = met.select("x.cell", F.col("x.leaf").alias("leaf"), F.col("y.main").alias("main2"), F.col("y.leaf").alias("leaf2"))
        one = leaves.where("NOT main").select("cell", "leaf", "members")
        two = leaves.select("cell", F.col("main").alias("main2"), F.col("leaf").alias("leaf2"), F.col("members").alias("more"))
        both = met.join(one, ["cell", "leaf"]).join(two, ["cell", "main2", "leaf2"]).select("members", "more")
        made = work.save(both.mapInArrow(_across(percent, every, spans), "a long, b long, share double"))
        work.drop(labelled, mixed, leaves)
        more = made.where("share is not null")
        if not every:
            more = more.groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("b"))
        more = work.save(_ordered(more).join(tried, ["a", "b"], "left_anti"))
        links = work.save(links.unionByName(confirmed(more)))
        tried = tried.unionByName(more)
        if spans:
            group = components(made.where("share is null").select("a", "b"), work)
            least = group.select(F.col("component").alias("cell"), F.col("component").alias("doc_id")).distinct()
            live = work.save(group.select(F.col("component").alias("cell"), F.col("id").alias("doc_id")).unionByName(least))
            points = work.save(docs.join(live.select("doc_id"), "doc_id", "left_semi").mapInArrow(_points(FINE), _POINT))
        work.drop(made)
        found = components(links, work)

    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    out = sig.join(work.save(named), ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
