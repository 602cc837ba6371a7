"""From candidates to findings: routing, withdrawal, acceptance and the merging of passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators.intervals import least_holding


def near_protected(candidates: DataFrame, protected: DataFrame, distance: int = 3) -> DataFrame:
    """candidates (candidate_id, file, family, line) with whether a protected sink of their family is so near."""
    # each sink is said of every line in its reach, once, so that many sinks at one place are one row
    reach = F.explode(F.sequence(F.col("line") - distance, F.col("line") + distance)).alias("line")
    hit = protected.select("file", "family", "line").distinct().select("file", "family", reach).distinct()
    return candidates.join(hit.withColumn("protected", F.lit(True)), ["file", "family", "line"], "left").withColumn("protected", F.coalesce("protected", F.lit(False)))


def outside_handlers(candidates: DataFrame, handlers: DataFrame) -> DataFrame:
    """candidates (file, line) that lie in no seeded handler (file, lo, hi)."""
    inside = least_holding(candidates, handlers, ["file"], "line", "lo", "hi", F.lit(1)).select("file", "line")
    return candidates.join(inside, ["file", "line"], "left_anti")


def route(x: DataFrame) -> DataFrame:
    """What becomes of each candidate; the order of the branches is the rule.

    x: strong, protected, precedent (an owner has decided so before), verdict (null: none came), control_ok, low. Candidates settled by
    the first three branches need no verdict, so a costly source of verdicts joins only the others.
    """
    outcome = (
        F.when(F.col("strong"), "accepted")
        .when(F.col("protected"), "rejected_protected")
        .when(F.col("precedent"), "rejected_precedent")
        .when(F.col("verdict") == "confirmed", F.when(F.col("low"), "kept_low").otherwise("kept"))
        .when((F.col("verdict") == "refuted") & F.col("control_ok"), "withdrawn")
        .otherwise("unconfirmed")
    )
    return x.withColumn("outcome", outcome)


def needs_verdict(x: DataFrame) -> DataFrame:
    return x.where("not (coalesce(strong, false) or coalesce(protected, false) or coalesce(precedent, false))")


def lines_named(reason: Column) -> Column:
    """Line numbers that a text names: `line 5`, `lines 7`."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(reason, F.lit(r"\blines?\s+(\d+)")), lambda n: n.cast("int"))))


def settle(verdicts: DataFrame) -> DataFrame:
    """(verdict, control_lines, reason, lo, hi): a refutation counts only if all its lines, or those its reason names, were shown."""
    named = F.when(F.size(F.coalesce("control_lines", F.array().cast("array<int>"))) > 0, F.col("control_lines")).otherwise(lines_named(F.col("reason")))
    good = (F.size(named) > 0) & F.forall(named, lambda n: n.between(F.col("lo"), F.col("hi")))
    return verdicts.withColumn("control_lines", named).withColumn("verdict", F.when((F.col("verdict") == "refuted") & ~good, "uncertain").otherwise(F.col("verdict")))


def merge_passes(findings: DataFrame) -> DataFrame:
    """Findings of several passes (pass, ord, cwe, file, line): the first of each place stays, later ones are noted."""
    k = F.row_number().over(Window.partitionBy("cwe", "file", "line").orderBy("pass", "ord"))
    return findings.withColumn("duplicate", k > 1).withColumn("finding_id", F.concat(F.lit("P"), F.col("pass").cast("string"), F.lit("-"), F.col("ord").cast("string")))


def decision_errors(x: DataFrame) -> DataFrame:
    """Check rules of a finding as a list of what is wrong with it."""
    rules = {
        "cwe": ~F.col("cwe").rlike(r"^CWE-\d+$"),
        "lines": ~((F.col("line_start") >= 1) & (F.col("line_end") >= F.col("line_start"))),
        "severity": ~F.col("severity").isin("critical", "high", "medium", "low", "info"),
        "evidence": F.size("evidence") == 0,
    }
    return x.withColumn("errors", F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items())), lambda e: e.isNotNull()))
