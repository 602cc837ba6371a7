"""Near-duplicate documents by a chosen-path set similarity join.

Every document is a set of five-word shingles. Documents with equal sets form a class; the smallest id
stands for it. Representatives descend TREES independent trees: at a node the document's minwise token
under the node's permutation chooses the child, so similar sets keep meeting. A node's members are first
linked to two pivots (a star, verified on full sets). Only where the links found so far leave a node in
several components are its members compared with each other by packed two-bit minwise sketches, and nodes too
large for that branch again. Members that have a look-alike in another component go on: their pairs across
components that share one of their rarest shingles (which every link does) are confirmed on full sets,
as every link is. So a group of copies never becomes all its pairs.

Recall: two sets of similarity J share one tree's root child with probability J, and each further level
keeps them with 1 - (1 - J)**BRANCH. At J = 0.85 the loss of all twelve trees is 1.3e-10 at the first level (4.1e-9 at J = 0.8)
and six levels down 9e-8 (7.5e-6), were the trees independent there; they draw their lower levels from the same
TOKENS - TREES minwise tokens, so it may be some times more. The sketch filter loses about 1e-7 of the pairs at exactly J = 0.85.
Sets are sets of 64-bit hashes of words' hashes, classes have equal 128-bit digests of whole sets.

Defined results: a null or empty text has no shingles and links with nothing; a row whose id is null is
returned with a null component and is kept; rows with the same id count as one document for links and
each yields a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm import _text as T
from marlstone.llm._work import Work
from marlstone.llm.components import components

K_WORDS = 5
TREES = 12
TOKENS = 32  # minwise tokens that choose paths: the first TREES at the roots, the others below
PERMUTATIONS = 128
BRANCH = 2
SMALL_NODE = 4096
DEPTH = 6
_SKETCH = [f"s{i}" for i in range(4)]

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def max_mismatches(threshold: float) -> int:
    """Of PERMUTATIONS two-bit values: six standard deviations above the mean at the threshold."""
    p = 0.75 * (1 - threshold)
    return int(PERMUTATIONS * p + 6 * (PERMUTATIONS * p * (1 - p)) ** 0.5)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each permutation over a set."""
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        v = shingles[i : i + 2048, None] ^ _XOR
        v *= _MUL
        np.minimum(out, v.min(axis=0), out=out)
    return out


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    values = np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd = np.uint64(0xC2B2AE3D27D4EB4F)
    digest = lambda s: hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    for batch in batches:
        for i, j, data, rows in T.blocks(batch.column(1)):
            sets = T.shingle_sets(T.words(data, rows), K_WORDS)
            low = np.array([minima(s) for s in sets], np.uint64).reshape(len(sets), PERMUTATIONS)
            bits = (T.mix(low * odd) >> np.uint64(62)).reshape(len(sets), 4, 32)
            sketch = (bits << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)
            classes = np.frombuffer(b"".join(map(digest, sets)), np.int64).reshape(len(sets), 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array(np.ascontiguousarray(classes[:, q])) for q in range(2)),
                    _lists(list(low[:, :TOKENS])),
                    *(pa.array(np.ascontiguousarray(sketch[:, q])) for q in range(4)),
                ],
                ["doc_id", "n", "h1", "h2", "tokens", *_SKETCH],
            )


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, rows in T.blocks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(T.shingle_sets(T.words(data, rows), K_WORDS))], ["doc_id", "shingles"])


def _alike(x: str, y: str, percent: int) -> Column:
    """Sizes and sketches allow the threshold."""
    pairs = 0x5555555555555555
    wrong = None
    for s in _SKETCH:
        d = F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))
        d = F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseAND(F.lit(pairs)))
        wrong = d if wrong is None else wrong + d
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (small * 100 >= large * percent) & (wrong <= max_mismatches(percent / 100))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return both.where((F.col("i") * 100).cast("long") >= (F.col("n") - F.col("i")).cast("long") * percent).select("a", "b")


def _across(members: DataFrame, sets: DataFrame, work: Work, percent: int) -> DataFrame:
    """All pairs (a, b) of members in different components that sketches and rare shingles allow.

    Two sets of the wanted similarity share one of the n - ceil(n * percent / 100) + 1 shingles of each that are
    rarest among the members, and a set's shingles that no other member has bound what any two can share, so no
    such pair is lost. Under a shingle only members outside its
    commonest component look for partners: those inside it are connected already.
    """
    token = members.select("doc_id", "n").join(sets, "doc_id").select("doc_id", "n", F.explode("shingles").alias("token"))
    often = work.save(token.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1"))
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("f", F.lit(1)), "token")
    shared = F.count("f").over(Window.partitionBy("doc_id"))
    rare = token.join(often, "token", "left").withColumn("k", F.row_number().over(order)).withColumn("shared", shared)
    rare = rare.where(f"f > 1 and k <= n - (n * {percent} + 99) div 100 + 1")
    rare = work.save(rare.select("token", "doc_id", "shared", "f", "k"))
    prefix = rare.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "token"))), lambda t: t["token"]).alias("prefix"))
    rare = work.save(rare.drop("f").join(prefix, "doc_id").join(members, "doc_id"))
    share = rare.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("token")
    main = work.save(share.agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "main"))
    x, y = rare.join(main, "token").where("component <> main").alias("x"), rare.alias("y")
    # at the first shingle that two sets share, no more than the rest of either can follow; each pair is made there only
    most = F.least("x.shared", "y.shared", 1 + F.col("x.n") - F.col("x.k"), 1 + F.col("y.n") - F.col("y.k"))
    enough = most * 100 >= (F.col("x.n") + F.col("y.n") - most) * percent
    first = F.get(F.array_intersect("x.prefix", "y.prefix"), F.lit(0)) == F.col("x.token")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & enough & _alike("x", "y", percent) & first
    return x.join(y, on).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85, small_node: int = SMALL_NODE, max_depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Nodes of at most small_node members, and all at max_depth, are compared exhaustively.

    Links documents with 100 * |A and B| >= percent * |A or B|; component_id is the smallest doc_id
    reachable over links, kept marks it.
    """
    work = Work(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = work.save(docs.mapInArrow(_signatures, f"doc_id long, n long, h1 long, h2 long, tokens array<long>, {', '.join(f'{s} long' for s in _SKETCH)}"))
    classes = work.save(sig.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    reps = work.save(sig.join(classes.select("h1", "h2", "n", F.col("rep").alias("doc_id")), ["doc_id", "h1", "h2", "n"], "left_semi").select("doc_id", "n", "tokens", *_SKETCH))

    plain = reps.select("doc_id", "n", *_SKETCH)
    rows = reps.select("doc_id", "n", *_SKETCH, F.posexplode(F.slice("tokens", 1, TREES)).alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "doc_id", "n", *_SKETCH)
    counts = work.save(rows.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("p1"), F.max("doc_id").alias("p2")).where("p1 < p2"))
    live = work.save(rows.join(counts, "node"))
    work.drop(counts)

    def sets_of(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        return work.save(docs.join(work.save(ids), "doc_id", "left_semi").mapInArrow(_shingles, "doc_id long, shingles array<long>"))

    star = live.select(F.explode(F.array(F.struct(F.col("p1").alias("a"), F.col("doc_id").alias("b")), F.struct(F.col("doc_id").alias("a"), F.col("p2").alias("b")))).alias("e")).select("e.a", "e.b").where("a < b").distinct()
    star = work.save(
        star.join(plain.select(F.col("doc_id").alias("a"), F.struct("n", *_SKETCH).alias("x")), "a")
        .join(plain.select(F.col("doc_id").alias("b"), F.struct("n", *_SKETCH).alias("y")), "b")
        .where(_alike("x", "y", percent))
        .select("a", "b")
    )
    sets = sets_of(star)
    links = work.save(_verify(star, sets, percent))
    found = components(links, work)

    def with_component(level: DataFrame) -> DataFrame:
        return level.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    level = work.save(with_component(live.select("node", "doc_id", "n", *_SKETCH)))
    work.drop(live)
    touching = []
    for depth in range(max_depth + 1):
        mixed = work.save(level.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("node", "m"))
        small = level.join(mixed.where(F.lit(depth == max_depth) | (F.col("m") <= small_node)).select("node"), "node", "left_semi")
        x, y = small.alias("x"), small.alias("y")
        on = (F.col("x.node") == F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & _alike("x", "y", percent)
        touching.append(work.save(x.join(y, on, "left_semi").select("doc_id", "n", *_SKETCH, "component").distinct()))
        large = mixed.where(f"m > {small_node}").select("node")
        if depth == max_depth or large.isEmpty():
            break
        tokens = reps.select("doc_id", "tokens")
        child = F.transform(F.array(*(F.lit(k) for k in range(BRANCH))), lambda k: TREES + F.pmod(F.xxhash64("node", k), F.lit(TOKENS - TREES)).cast("int"))
        down = level.join(large, "node", "left_semi").join(tokens, "doc_id").withColumn("at", F.explode(child))
        deeper = work.save(down.select(F.xxhash64("node", "at", F.get("tokens", F.col("at"))).alias("node"), "doc_id", "n", *_SKETCH, "component"))
        work.drop(level, mixed)
        level = deeper
    open_docs = touching[0]
    for more in touching[1:]:
        open_docs = open_docs.union(more)
    open_docs = work.save(open_docs.distinct())
    if not open_docs.isEmpty():
        missing = work.save(open_docs.select("doc_id").join(sets.select("doc_id"), "doc_id", "left_anti"))
        sets = sets.unionByName(work.save(docs.join(missing, "doc_id", "left_semi").mapInArrow(_shingles, "doc_id long, shingles array<long>")))
        rest = work.save(_across(open_docs, sets, work, percent).join(star, ["a", "b"], "left_anti"))
        links = work.save(links.union(_verify(rest, sets, percent)))
        found = components(links, work)

    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", "n", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n", "h1", "h2").join(work.save(named), ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
