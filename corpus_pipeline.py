"""A training corpus from raw documents, in five stages that work on all that the stage before kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Stages handle what
their operators' docstrings define: nulls, empty and very long texts, repeated rows, extra columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import quality
from marlstone.llm._work import Work
from marlstone.llm.bpe import encode_decode
from marlstone.llm.decontaminate import drop_contaminated
from marlstone.llm.linededup import rewrite
from marlstone.llm.near_dedup import near_duplicates

#: Similarity, in percent, from which documents are copies of each other.
NEAR_PERCENT = 80


def _free(docs: DataFrame, n: int) -> list[str]:
    """Column names that docs does not have."""
    prefix = "_x"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return [f"{prefix}{i}" for i in range(n)]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels outside the held-out fold."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (name,) = _free(docs, 1)
    return quality.score(spark, docs, model, name).where(F.col(name) >= quality.ACCEPT).drop(name)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of lines that an earlier document has go from the texts, and documents of which nothing is left go; n_chars follows."""
    out = rewrite(spark, docs)
    out = out.toDF(*docs.columns, *(x := _free(docs, 3)))
    out = out.where((F.col(x[1]) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]") | F.col("text").isNull()).drop(*x)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    found = near_duplicates(spark, docs, NEAR_PERCENT)
    gone = found.where("not kept").select(F.col("doc_id").alias(name := _free(docs, 1)[0]))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    import public_tokenizers

    return encode_decode(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The stages learn, hash and search in ways SQL has no words for; tests hold them against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written and read again."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
