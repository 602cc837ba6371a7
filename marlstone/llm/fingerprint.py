"""Document fingerprints: one-permutation MinHash with optimal densification and packed b-bit values.

The distinct five-word shingles of a text are hashed once; the high bits choose one of BINS bins, which keeps
its smallest hash. An empty bin takes the value of a bin found by its own sequence of hashed probes, which
every text shares (optimal densification). The low BITS bits of the bins are packed into hex; likeness
counts equal bins and removes the share that agrees by chance. Its standard error is
sqrt(J * (1 - J) / BINS), about 0.02 at most, plus what chance agreement adds.

Defined results: a null or empty text has the empty string as its fingerprint and is like only another such
text (likeness 1, else 0); a text with fewer than five words is one shingle. Documents follow each other by
id, then text, so repeated ids are neighbours; null ids come first. With one document the next document is
that document itself. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import _text as T

K_WORDS = 5
BINS = 512
BITS = 4
RANGE_BYTES = 32 << 20  # of text in a range of documents, on average
_PROBES: list[np.ndarray] = []


def _probe(k: int) -> np.ndarray:
    """The bin that each bin looks at in its k-th probe."""
    while len(_PROBES) <= k:
        at = np.arange(BINS, dtype=np.uint64) + np.uint64((len(_PROBES) + 1) << 32)
        _PROBES.append((T.mix(at) >> np.uint64(40)).astype(np.int64) % BINS)
    return _PROBES[k]


def bins(shingles: list[np.ndarray]) -> np.ndarray:
    """(texts, BINS) densified minima; a text without shingles has zeros."""
    shift = np.uint64(64 - (BINS - 1).bit_length())
    out = np.full((len(shingles), BINS), np.iinfo(np.uint64).max, np.uint64)
    for row, s in zip(out, shingles, strict=True):
        at = (s >> shift).astype(np.int64)  # s is sorted, so each bin's first is its smallest
        new = np.flatnonzero(np.diff(at, prepend=-1))
        row[at[new]] = s[new]
    empty = out == np.iinfo(np.uint64).max
    none = empty.all(axis=1)
    source, todo = ~empty, empty & ~none[:, None]
    values, k = out.copy(), 0
    r, c = np.nonzero(todo)
    while len(r):
        p = _probe(k)[c]
        hit = source[r, p]
        values[r[hit], c[hit]] = out[r[hit], p[hit]]
        r, c = r[~hit], c[~hit]
        k += 1
    values[none] = 0
    return values


def pack(values: np.ndarray, some: np.ndarray) -> list[str]:
    """Hex of the bins' low bits; the empty string for a text without shingles."""
    # with the bin mixed in, unequal values agree by chance in each bin on its own, also where bins hold copies
    low = (T.mix(values ^ T.mix(np.arange(BINS, dtype=np.uint64))) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    joined = low[:, 0::2] << 4 | low[:, 1::2]
    return [x.tobytes().hex() if s else "" for x, s in zip(joined, some, strict=True)]


def fingerprints(texts: pa.Array) -> list[str]:
    """Fingerprints of whole texts."""
    out: list[str] = []
    for _, _, data, rows in T.blocks(texts):
        sets = T.shingle_sets(T.words(data, rows), K_WORDS)
        out += pack(bins(sets), np.array([len(s) > 0 for s in sets]))
    return out


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprints, between 0 and 1."""
    if not a or not b:
        return float(a == b)
    x = np.frombuffer(bytes.fromhex(a), np.uint8) ^ np.frombuffer(bytes.fromhex(b), np.uint8)
    equal = (np.count_nonzero(x >> 4 == 0) + np.count_nonzero(x & 15 == 0)) / BINS
    chance = 0.5**BITS
    return float(min(1.0, max(0.0, (equal - chance) / (1 - chance))))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _digest(some: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Rows for (id, text, next text)."""
    ids, texts, nexts = map(list, zip(*some, strict=True))
    changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
    own, edit = fingerprints(pa.array(texts, pa.large_string())), fingerprints(pa.array(changed, pa.large_string()))
    after = [*own[1:], *fingerprints(pa.array(nexts[-1:], pa.large_string()))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(list(map(len, texts)), pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
            pa.array(own),
            pa.array(edit),
            pa.array([likeness(a, b) for a, b in zip(own, edit, strict=True)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, extra, doc_id, text) sorted by part, doc_id, text, extra; each part ends with copies of the next one's first rows."""
    held, size, before = [], 0, None  # before: the row whose next text is not known yet
    for batch in batches:
        for part, extra, doc_id, text in zip(*(batch.column(k) for k in range(4)), strict=True):
            part, extra, row = part.as_py(), extra.as_py(), (doc_id.as_py(), text.as_py() or "")
            if before is not None and before[0] == part:
                held.append((*before[1], row[1]))
                size += len(row[1])
            if size > 1 << 20:
                yield _digest(held)
                held, size = [], 0
            before = None if extra else (part, row)
    if held:
        yield _digest(held)


def _ranged(docs: DataFrame, borders: list[int]) -> DataFrame:
    """docs with the number of borders up to its id as part; null ids are in the first one."""
    if not borders:
        return docs.withColumn("part", F.lit(0))
    if max(map(abs, borders)) < 1 << 53:  # exact as doubles, so a binary search serves any number of borders
        x = docs.withColumn("_at", F.coalesce("doc_id", F.lit(borders[0] - 1)).cast("double"))
        split = Bucketizer(splits=[float("-inf"), *map(float, borders), float("inf")], inputCol="_at", outputCol="_part")
        return split.transform(x).withColumn("part", F.col("_part").cast("int")).drop("_at", "_part")
    below = F.size(F.filter(F.array(*map(F.lit, borders)), lambda x: x <= F.col("doc_id")))
    return docs.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(below))


def compare_with_edits(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of each document (doc_id, text) and of its edit with the following document's text.

    Documents are dealt into ranges of ids whose borders are ids of documents; the first document of each
    range goes to the range before it too (that of the first range to the last), so each range is
    walked in one task and no global order is needed. The number of ranges grows with the texts, one for RANGE_BYTES, so
    tasks do not; rows go to the task of their range's number, so ranges do not meet in one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.min("doc_id"), F.count(F.lit(1)), F.count("doc_id"), F.sum(F.octet_length("text"))).head()
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size[3] or 0) // RANGE_BYTES))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts)).head()[0]
    borders = sorted({x for x in cuts or [] if x > size[0]})
    first = F.col("doc_id").isin(*borders) if borders else F.lit(False)
    #: The first row of all follows the last one.
    top = docs.where("doc_id is null" if size[2] < size[1] else F.col("doc_id") == size[0]).groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    own = _ranged(docs, borders).select("part", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    start = own.where(first).groupBy("doc_id").agg(F.min("part").alias("part"), F.min("text").alias("text"))
    extra = start.select((F.col("part") - 1).alias("part"), "doc_id", "text").unionByName(top.select(F.lit(len(borders)).alias("part"), "doc_id", "text"))
    rows = own.select("part", F.lit(False).alias("extra"), "doc_id", "text").unionByName(extra.select("part", F.lit(True).alias("extra"), "doc_id", "text"))
    rows = rows.repartitionById(len(borders) + 1, "part").sortWithinPartitions("part", "extra", "doc_id", "text")
    return rows.mapInArrow(_walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
