"""Importance resampling of documents towards a target distribution, on hashed word features.

Identical texts are collapsed by grouping the full text: features and weight are made once for each
distinct text, and its feature counts are multiplied by the number of its copies. A feature is a run of
one to LONGEST words; its bucket is the CRC-32 of its bytes modulo BUCKETS. A bucket's gain is the log
ratio of its smoothed frequency in the target and in the corpus, in thousandths, and a text's weight is
the floored mean of the gains of its features. The weight is joined back to the documents by the text's
digest, and only then the noise of each document is added: the highest sums of weight and Gumbel noise
are a draw without replacement in proportion to the weights.

All of it is built-in expressions. What passes through one task or through a broadcast is of fixed size: BUCKETS gains and the
counts of score bins, whose number the range of the scores bounds. Ranks come from counts of scores, so no
task sorts all documents.

Defined results: a null or empty text has no features and weight 0; a null doc_id is hashed as an empty string and sorts first;
rows with the same doc_id and text each yield a row and share their score (their ranks follow one another in any order); with
no benchmark features only the smoothing is left; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm._work import Work

BUCKETS = 10_000
LONGEST = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Scores of one bin of the rank offsets.
BIN = 1000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def buckets(words: Column, longest: int = LONGEST) -> Column:
    """The bucket of every run of 1 to longest words, repeats kept."""
    code = lambda run: (F.crc32(run.cast("binary")) % BUCKETS).cast("int")
    if longest == 1:
        return F.transform(words, code)

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: code(F.array_join(F.slice(words, i, n), " ")))

    return F.concat(*(runs(n) for n in range(1, longest + 1)))


def gain(t: Column, s: Column, in_target: Column, in_corpus: Column) -> Column:
    """floor(1000 ln of the smoothed frequency ratio), computed in doubles."""
    d = lambda c: c.cast("double")
    ratio = (d(t) + 1) * (d(in_corpus) + BUCKETS) / ((d(s) + 1) * (d(in_target) + BUCKETS))
    return F.floor(F.log(ratio) * 1000).cast("long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document in thousandths, from the digest of its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def _tally(features: DataFrame) -> DataFrame:
    """(bucket, n) of rows with buckets and copies."""
    return features.select("copies", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias("n"))


def resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = LONGEST, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), all long, for each row of docs (doc_id, text); target has a column text.

    rank is 1, 2, 3 ... over the drawn documents: of the N with at least min_words words the floor(percent * N / 100) highest
    scores, ties to the smaller doc_id; null for the others.
    """
    work = Work(spark, "resample")
    texts = docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    split = texts.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "copies", words(F.col("text")).alias("words"))
    classes = work.save(split.select("digest", "copies", F.size("words").cast("long").alias("n_words"), buckets(F.col("words"), longest).alias("buckets")))
    wanted = target.select(F.lit(1).alias("copies"), words(F.col("text")).alias("words")).select("copies", buckets(F.col("words"), longest).alias("buckets"))

    s = _tally(classes).withColumnRenamed("n", "s")
    t = _tally(wanted).withColumnRenamed("n", "t")
    counts = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    counts = work.save(counts)
    row = counts.agg(F.array_sort(F.collect_list(F.struct("bucket", "t", "s"))).alias("all"), F.sum("t").alias("in_target"), F.sum("s").alias("in_corpus"))
    gains = row.select(F.transform("all", lambda x: gain(x["t"], x["s"], F.col("in_target"), F.col("in_corpus"))).alias("gains"))

    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.get("gains", b))
    n = F.size("buckets").cast("long")
    weighed = classes.withColumn("gains", gains.scalar()).select("digest", "n_words", n.alias("n_features"), total.alias("total"))
    floored = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (total - pmod(total, n_features)) div n_features END")
    weights = work.save(weighed.select("digest", "n_words", "n_features", floored.alias("weight")))

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    scored = keyed.join(weights, "digest").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = work.save(scored.select("doc_id", "n_words", "n_features", "weight", "score"))

    quota = scored.where(F.col("n_words") >= min_words).agg(F.expr(f"(count(1) * {percent}) div 100")).scalar()
    offsets = work.save(_above(scored.where(F.col("n_words") >= min_words)))
    rows = scored.join(offsets, "score", "left").withColumn("open", (F.col("n_words") >= min_words) & (F.col("above") < quota))
    rows = work.save(rows.select("doc_id", "n_features", "weight", "score", "above", "open"))
    place = (F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))).cast("long")
    drawn = rows.where("open").withColumn("place", place).withColumn("rank", F.when(F.col("place") <= quota, F.col("place")))
    rest = rows.where("NOT open").withColumn("rank", F.lit(None).cast("long"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*out).unionByName(rest.select(*out))


def _above(scored: DataFrame) -> DataFrame:
    """(score, above): how many rows have a higher score, from counts by score and by bin of BIN scores."""
    by_score = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("bin", F.floor(F.col("score") / BIN))
    by_bin = scored.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count(F.lit(1)).alias("m"))
    before = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bin.select("bin", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    return by_score.join(starts, "bin").select("score", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("above"))
