"""Tables that cut lineage: written to the folder that driver and executors share, then read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marlstone.sources.work import shared_folder


class Work:
    """Written tables of one run. Lost executors cost nothing that is not written here already."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        # the tables are held, so that no other object gets the number of one that is known here
        self._saved: dict[int, tuple[DataFrame, str]] = {}

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._saved[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for table in tables:
            if known := self._saved.pop(id(table), None):
                p = jvm.org.apache.hadoop.fs.Path(known[1])
                p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
