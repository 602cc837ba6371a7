"""Tables that cut lineage: written to the folder that driver and executors share, then read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a temporary folder only where that is unset and Spark is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="marlstone-work-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def dealt(df: DataFrame, *key: Column | str) -> DataFrame:
    """The rows by hash of a key in as many parts as a shuffle has: a small file is one part, however much is made of each of its rows."""
    return df.repartition(max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *key)


def gathered(df: DataFrame, *key: str, fixed: bool = False) -> DataFrame:
    """The rows with those of a key in one part, for what reads a part as a stream; Spark may put small parts together, or their number is fixed as in `dealt`.

    By a hash of the key, and not by the key itself: where a join below is dealt by the same key, Spark leaves out the second exchange, and may
    still broadcast the join's other side once its size is known; it then reads this side as its tasks wrote it, which parts a key's rows.
    """
    by = F.xxhash64(*key)
    return dealt(df, by) if fixed else df.repartition(by)


def settled(df: DataFrame) -> DataFrame:
    """The rows as a written table: joins that read it several times neither compute nor plan it again.

    Written plain: what Spark broadcasts is decided by the files' size, and packed files of like rows are a small part of the rows.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the input, met by sorted shares at any size: what Spark broadcasts is built in the driver,
    and of many small sides it holds several at once."""
    return df.hint("merge")
