"""Lexical search: line search, and weighted BM25 over an inverted index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from marlstone.sources.tables import lines
from marlstone.sources.work import dealt

K1, NORM, FLOOR = 1.2, 0.75, 1e-6
#: So many scores (documents times queries) are summed at a time.
SCORES_AT_ONCE = 1 << 21


def search_lines(docs: DataFrame, key: str, pattern: str, regex: bool, most: int, width: int = 2000) -> DataFrame:
    """The first matching lines in order of document and line, each cut to a width."""
    hit = F.col("line").rlike(pattern) if regex else F.contains("line", F.lit(pattern))
    found = docs.where(F.col("text").rlike(pattern) if regex else F.contains("text", F.lit(pattern)))  # documents without a hit need no lines
    return lines(found.select(key, "text")).where(hit).select(key, "n", F.substring("line", 1, width).alias("line")).orderBy(key, "n").limit(most)


def _weighted(w: float) -> Callable[[Column], Column]:
    return lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w"))


def tokens(weights: dict[str, float]) -> Column:
    """array<struct<term, w>> of the tokens of all columns."""
    return F.concat(*(F.transform(F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), ""), _weighted(w)) for c, w in weights.items()))


def bm25(docs: DataFrame, key: str, weights: dict[str, float], queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rank): the k best documents of each query (query_id, terms array).

    Only the queries' terms are read out of the index, so the shuffle carries their postings alone, and once: a document is scored for all
    queries where its postings are, and each part passes on its k best of a query (`best`).
    """
    return bm25_tokens(docs.select(key, tokens(weights).alias("ts")), key, queries, k)


def asking(wanted: DataFrame) -> DataFrame:
    """(term, asked): the queries (query_id) of each term, in structs, as a list keeps no nulls."""
    return wanted.groupBy("term").agg(F.collect_list(F.struct("query_id")).alias("asked"))


def best(shares: DataFrame, key: str, k: int) -> DataFrame:
    """(query_id, key, score, rank): the k best sums of the shares (key, share, asked) of each query, ties at nine digits by key.

    Rows come with a key's together and the keys of a part in order, so a part is a stream: of it are held one document's rows, an Arrow
    batch and the k best so far of each query. A later key of equal score is behind those before, so a score must exceed the k-th.
    """
    asks = shares.schema["asked"].dataType.elementType["query_id"].dataType
    out = StructType([StructField("query_id", asks), shares.schema[key], StructField("score", DoubleType()), StructField("_nine", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(out)
        codes: dict = {}
        kept = {"q": np.empty(0, np.int64), "nine": np.empty(0), "score": np.empty(0), "key": np.empty(0, object)}
        floor = np.empty(0)

        def take(x: pa.Table, starts: np.ndarray) -> None:
            """Documents as rows from each start on."""
            nonlocal kept, floor
            asked = x.column("asked").combine_chunks()
            found = asked.flatten().field(0).dictionary_encode(null_encoding="encode")
            code = np.array([codes.setdefault(v, len(codes)) for v in found.dictionary.to_pylist()], np.int64)
            n = len(codes)
            floor = np.append(floor, np.full(n - len(floor), -np.inf))
            times = asked.value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, x.num_rows))), times)
            q, share = code[found.indices.to_numpy()], np.repeat(x.column("share").to_numpy(), times)
            step = max(1, SCORES_AT_ONCE // max(1, n))
            for a in range(0, len(starts), step):
                lo, hi = np.searchsorted(doc, (a, a + step))
                cell = (doc[lo:hi] - a) * n + q[lo:hi]
                score, there = np.bincount(cell, share[lo:hi]), np.bincount(cell) > 0
                nine = np.floor(score * 1e9 + 0.5)
                new = np.flatnonzero(there & (nine > np.resize(floor, len(nine)) if n else there))
                if not len(new):
                    continue
                keys = np.empty(len(new), object)
                keys[:] = x.column(key).take(pa.array(starts[a + new // n])).to_pylist()
                both = {c: np.concatenate((kept[c], v)) for c, v in {"q": new % n, "nine": nine[new], "score": score[new], "key": keys}.items()}
                order = np.lexsort((-both["nine"], both["q"]))  # stable, and rows stand in order of keys
                of = both["q"][order]
                place = np.arange(len(of)) - np.searchsorted(of, of)
                kept = {c: v[order[place < k]] for c, v in both.items()}
                last = order[place == k - 1]
                floor[both["q"][last]] = both["nine"][last]

        rest = None
        for batch in batches:
            x = pa.Table.from_batches([batch])
            x = x if rest is None else pa.concat_tables([rest, x]).combine_chunks()
            same = x.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.append(0, np.flatnonzero(np.diff(same)) + 1)
            if len(starts) > 1:
                take(x.slice(0, starts[-1]), starts[:-1])
            rest = x.slice(starts[-1])
        if rest is not None:
            take(rest, np.zeros(1, np.int64))
        names = list(codes)
        columns = ([names[q] for q in kept["q"]], kept["key"].tolist(), kept["score"], kept["nine"])
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types, strict=True)], types.names)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_nine"), key))
    found = shares.select(key, "share", "asked").mapInArrow(run, out)
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("_nine")


def bm25_tokens(docs: DataFrame, key: str, queries: DataFrame, k: int) -> DataFrame:
    """The same over tokens made before: docs (key, ts array<struct<term, w>>; length, the size of ts, where that is known without making them).

    The terms of the queries are broadcast, so postings stay where their document is.
    """
    wanted = queries.select("query_id", F.explode("terms").alias("term")).distinct()
    # exploding an array of one keeps the tokens from being made again for each use
    length = F.col("length") if "length" in docs.columns else F.size("ts")
    tokens = docs.select(key, F.explode(F.array("ts")).alias("ts")).select(key, F.size("ts").alias("length"), "ts")
    stats = docs.select(length.alias("length")).agg(F.count(F.lit(1)).alias("corpus"), F.avg("length").alias("mean"))
    hits = tokens.select(key, "length", F.explode("ts").alias("t")).select(key, "length", "t.*").join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
    tf = dealt(hits, key).groupBy(key, "length", "term").agg(F.sum("w").alias("tf"))
    df = tf.groupBy("term").agg(F.count("tf").alias("n"))  # counting tf, so that the exchange below it is the same and is reused
    idf = F.log((F.col("corpus") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    terms = df.join(asking(wanted), "term").crossJoin(F.broadcast(stats)).withColumn("idf", F.when(idf <= 0, FLOOR).otherwise(idf))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - NORM + NORM * F.col("length") / F.col("mean")))
    shares = tf.join(F.broadcast(terms), "term").select(key, "term", part.alias("share"), "asked")
    # Spark leaves this exchange out, as the rows are dealt by key already; equal texts add their shares in one order
    return best(dealt(shares, key).sortWithinPartitions(key, "term"), key, k)
