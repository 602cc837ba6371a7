"""Aggregates, set operations and exports of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reliability(events: DataFrame) -> DataFrame:
    """By tool (tool, status, ms): calls that ended well, badly or were denied, and their mean duration."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return events.groupBy("tool").agg(n("ok"), n("error"), n("denied"), F.round(F.avg("ms"), 4).alias("mean_ms"))


def odd_ones(rows: DataFrame, group: str, flag: str, least: int, share: float) -> DataFrame:
    """Rows without a flag that most of their group has; groups are counted before they meet their rows."""
    ruled = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col(flag).cast("int")).alias("_share")).where((F.col("_n") >= least) & (F.col("_share") >= share))
    return rows.where(~F.col(flag)).join(ruled.select(group), group, "left_semi")


def union_ordered(parts: list[DataFrame]) -> DataFrame:
    """All rows, with the number of the part they come from."""
    return reduce(DataFrame.unionByName, [p.select(F.lit(i).alias("part"), "*") for i, p in enumerate(parts)])


def sarif_result(rule: str, severity: str, message: str, place: str) -> Column:
    """One finding as a result object of a SARIF file."""
    level = F.when(F.col(severity).isin("critical", "high"), "error").when(F.col(severity) == "medium", "warning").otherwise("note")
    return F.to_json(F.struct(F.col(rule).alias("ruleId"), level.alias("level"), F.struct(F.col(message).alias("text")).alias("message"), F.substring(F.sha2(place, 256), 1, 16).alias("fingerprint")))


def sarif(findings: DataFrame, tool: str, version: str) -> DataFrame:
    """A whole SARIF document in one row (column json).

    findings: rule, severity, message, evidence array<struct<file, lo, hi>>; the first evidence is the place, up
    to four more are related. A report is one document by nature, so its results meet in one task: it is for findings, not for corpora.
    """
    place = lambda e: F.struct(F.struct(F.struct(e["file"].alias("uri")).alias("artifactLocation"), F.struct(e["lo"].alias("startLine"), e["hi"].alias("endLine")).alias("region")).alias("physicalLocation"))
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    first = F.get("evidence", F.lit(0))
    result = F.struct(
        F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place(first)).alias("locations"),
        F.transform(F.slice("evidence", 2, 4), place).alias("relatedLocations"),
        F.struct(F.substring(F.sha2(F.concat_ws(":", F.col("rule"), first["file"], first["lo"].cast("string")), 256), 1, 16).alias("place/v1")).alias("partialFingerprints"),
    )
    rows = findings.agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.sort_array(F.collect_list(result)).alias("results"))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.transform("rules", lambda r: F.struct(r.alias("id"))).alias("rules"))
    return rows.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"))).alias("runs"))).alias("json"))


def bullet_report(rows: DataFrame, group: str, order: str, line: Column) -> DataFrame:
    """(group, report): a group's lines in order."""
    x = rows.select(group, F.struct(F.col(order), line.alias("l")).alias("x")).groupBy(group).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return x.select(group, F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("report"))
