"""A search index that is written once, appended to, and read by later searches without any text.

Documents are dealt into chunks by the hash of their key. A block holds the postings of one term in one chunk, in order of the key,
with the block's largest frequency and shortest document. Blocks are sorted by term in files by bucket, so a search reads those of its
terms only. An append writes a segment of its own and commits it by one row in the table of segments, which is written last: a failed
append leaves the index as it was, and one that is run again takes the documents that are not in yet.

A search bounds each chunk's best score by the sum of its blocks' bounds. A query's floor is the k-th best share of its rarest term
that k documents have; chunks bounded below it cannot hold one of the k best, and their postings are not read for that query.

Defined results: documents with a null key are not indexed; of rows with one key, those of the first append stay, and within an
append they must be unique; null texts have no terms and length 0, but count; an index without segments finds nothing; queries with null or
no terms find nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.search import FLOOR, K1, NORM, best, tokens
from marlstone.sources.work import dealt, gathered

BUCKETS = 64
CHUNK_DOCS = 128
_SEGMENTS = "segment string, corpus long, total long"
#: Sums of the same shares in another order differ by less.
_SLACK = 1e-6


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(segment, corpus, total): the committed segments, their documents and their tokens."""
    if not _exists(spark, f"{path}/segments"):
        return spark.createDataFrame([], _SEGMENTS)
    return spark.read.schema(_SEGMENTS).parquet(f"{path}/segments")


def _stored(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    """A part of all committed segments; their number is that of the appends."""
    names = [r.segment for r in segments(spark, path).select("segment").collect()]
    if not names:
        return None
    read = spark.read.option("basePath", f"{path}/{part}")
    if part == "blocks":  # a segment of empty texts has none
        key = _stored(spark, path, "documents").schema["key"].dataType.simpleString()
        read = read.schema(f"term string, chunk long, n long, max_tf double, min_length long, postings array<struct<key:{key},tf:double,length:bigint>>, segment string, bucket int")
    return read.parquet(*(f"{path}/{part}/segment={n}" for n in names))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def append(docs: DataFrame, key: str, weights: dict[str, float], path: str, chunk_docs: int = CHUNK_DOCS) -> None:
    """Write the documents that the index at path does not have yet as one more segment."""
    spark, name = docs.sparkSession, f"s{uuid.uuid4().hex}"
    new = docs.where(F.col(key).isNotNull())
    known = _stored(spark, path, "documents")
    if known is not None:
        new = new.join(known.select(F.col("key").alias(key)), key, "left_anti")
    new = new.select(F.col(key).alias("key"), *weights)
    new.select("key", F.size(tokens(weights)).cast("long").alias("length")).write.parquet(f"{path}/documents/segment={name}")
    own = spark.read.parquet(f"{path}/documents/segment={name}")
    corpus, total = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).head()
    if not corpus:
        return
    # documents are dealt out by chunk, so that neither frequencies nor blocks need another exchange
    chunk = F.pmod(F.xxhash64("key"), F.lit(-(-corpus // chunk_docs)))
    ts = dealt(new.withColumn("chunk", chunk), "chunk").select("chunk", "key", tokens(weights).alias("ts"))
    tf = ts.select("chunk", "key", F.size("ts").cast("long").alias("length"), F.explode("ts").alias("t")).groupBy("chunk", "key", "length", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"))
    blocks = tf.groupBy("term", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.array_sort(F.collect_list(F.struct("key", "tf", "length"))).alias("postings")
    )
    blocks = blocks.withColumn("bucket", _bucket(F.col("term"))).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term", "chunk")
    blocks.write.partitionBy("bucket").parquet(f"{path}/blocks/segment={name}")
    spark.createDataFrame([(name, corpus, total)], _SEGMENTS).coalesce(1).write.mode("append").parquet(f"{path}/segments")


def _share(tf: Column, length: Column) -> Column:
    """What a term adds to the score of a document."""
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - NORM + NORM * length / F.col("mean")))


def _wanted(spark: SparkSession, path: str, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of the queries' terms, and (query_id, term, df, idf, mean)."""
    asked = queries.select("query_id", F.explode("terms").alias("term")).where("term is not null").distinct().withColumn("bucket", _bucket(F.col("term")))
    blocks = _stored(spark, path, "blocks").join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    stats = segments(spark, path).agg(F.sum("corpus").alias("corpus"), (F.sum("total") / F.sum("corpus")).alias("mean"))
    idf = F.log((F.col("corpus") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = blocks.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(stats))
    terms = terms.select("term", "df", F.when(idf <= 0, FLOOR).otherwise(idf).alias("idf"), "mean")
    return blocks, asked.join(terms, "term").select("query_id", "term", "df", "idf", "mean")


def _postings(blocks: DataFrame, allowed: DataFrame | None, *more: str) -> DataFrame:
    out = blocks.select(*more, F.explode("postings").alias("p")).select(*more, "p.*")
    return out if allowed is None else out.join(allowed.select(F.col(allowed.columns[0]).alias("key")).distinct(), "key", "left_semi")


def _floors(blocks: DataFrame, asked: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    """(query_id, floor): no document below it is among the query's k best."""
    rare = asked.where(F.col("df") >= k).groupBy("query_id").agg(F.min_by(F.struct("term", "idf", "mean"), F.struct("df", "term")).alias("t")).select("query_id", "t.*")
    found = _postings(blocks.join(rare.select("term", "idf", "mean").distinct(), "term"), allowed, "term", "idf", "mean")
    share = found.select("term", _share(F.col("tf"), F.col("length")).alias("floor"))
    kth = share.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("floor")))).where(F.col("r") <= k)
    return rare.join(kth.where(F.col("r") == k).select("term", "floor"), "term").select("query_id", "floor")


def live_chunks(blocks: DataFrame, asked: DataFrame, floors: DataFrame) -> DataFrame:
    """(query_id, segment, chunk, live): whether a chunk may hold one of the best; only the blocks' bounds are read."""
    top = blocks.select("term", "segment", "chunk", "max_tf", "min_length").join(asked, "term")
    bound = top.groupBy("query_id", "segment", "chunk").agg(F.sum(_share(F.col("max_tf"), F.col("min_length"))).alias("bound"))
    return bound.join(floors, "query_id", "left").select("query_id", "segment", "chunk", (F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - _SLACK).alias("live"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k best documents of each query (query_id, terms array) by BM25 over the whole index.

    Of `allowed`, if given, the first column lists the keys that may be found; frequencies and lengths stay those of the index.
    """
    if _stored(spark, path, "documents") is None:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, key long, score double, rank int")
    blocks, asked = _wanted(spark, path, queries)
    live = live_chunks(blocks, asked, _floors(blocks, asked, k, allowed)).where("live").drop("live")
    # a chunk's blocks are dealt out as they are: its documents are scored for all queries where they are, and a part passes on its best alone
    live = live.groupBy("segment", "chunk").agg(F.collect_set(F.struct("query_id")).alias("live"))
    terms = asked.groupBy("term", "idf", "mean").agg(F.collect_set(F.struct("query_id")).alias("asked"))
    x = blocks.join(F.broadcast(terms), "term")
    if allowed is None:
        # dealt out before the join, and the other side never broadcast: Spark leaves an exchange after the join out, and may then part a chunk's blocks
        x, live = dealt(x, "segment", "chunk"), live.hint("shuffle_hash")
    x = x.join(live, ["segment", "chunk"]).withColumn("asked", F.array_intersect("asked", "live")).where(F.size("asked") > 0)
    shares = _postings(x, allowed, "term", "idf", "mean", "asked").select("key", "term", _share(F.col("tf"), F.col("length")).alias("share"), "asked")
    shares = shares if allowed is None else gathered(shares, "key", fixed=True)
    return best(shares.sortWithinPartitions("key", "term"), "key", k)
