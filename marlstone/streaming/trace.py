"""The event log as a stream: appended JSON lines, running reliability, and hypothesis state under patches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "ts timestamp, run string, event_id string, tool string, status string, duration_ms double, result_sha256 string"


def read(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_a_trigger).json(folder)


def append(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Events appended as JSON lines by day; the checkpoint makes it exactly once."""
    by_day = events.withColumn("day", F.to_date("ts"))
    return by_day.writeStream.format("json").partitionBy("day").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


def reliability(events: DataFrame, lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Calls and mean duration by tool and window; state is dropped once the watermark has passed."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "tool").agg(n("ok"), n("error"), n("denied"), F.avg("duration_ms").alias("mean_ms"))


def once(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Events without repeats of an id within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["run", "event_id"])


def _patch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, note, version = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(batches)).sort_values("version")
    for s, n, v in zip(rows["status"], rows["note"], rows["version"], strict=True):
        status, note, version = s if pd.notna(s) else status, n if pd.notna(n) else note, max(version, int(v))
    state.update((status, note, version))
    yield pd.DataFrame({"hypothesis": [key[0]], "status": [status], "note": [note], "version": [version]})


def hypotheses(patches: DataFrame) -> DataFrame:
    """The state of each hypothesis after each batch of patches (hypothesis, status, note, version); a null keeps a field."""
    out = "hypothesis string, status string, note string, version long"
    return patches.groupBy("hypothesis").applyInPandasWithState(_patch, out, "status string, note string, version long", "update", GroupStateTimeout.NoTimeout)
