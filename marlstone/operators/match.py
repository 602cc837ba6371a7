"""Findings against labelled cases: overlap joins, first matches, outcomes and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.text import f1, ratio, wilson
from marlstone.operators.intervals import greatest_covering, least_holding, least_overlapping

SLACK = 2


def overlap(lo: str, hi: str, a: str, b: str, slack: int = 0) -> Column:
    return (F.col(lo) <= F.col(b) + slack) & (F.col(hi) >= F.col(a) - slack)


def outcomes(findings: DataFrame, cases: DataFrame, slack: int = SLACK) -> DataFrame:
    """What becomes of each finding.

    findings: app, finding_ord, family (null: out of scope), file, ranges array<struct<lo, hi>>.
    cases: app, case_ord, family, vulnerable, file, lo, hi (a row a place).
    Returns app, finding_ord, family, case_ord, outcome. A finding belongs to its first overlapping
    case in case order, whether or not an earlier finding has it; that case's first finding is tp or
    fp_safe, later ones are duplicates. Without a case it is fp_unmatched.
    """
    spans = findings.select("app", "finding_ord", "family", "file", F.explode("ranges").alias("r")).select("app", "finding_ord", "family", "file", "r.lo", "r.hi")
    c = cases.select("app", "family", "file", F.col("lo").alias("a"), F.col("hi").alias("b"), "case_ord", "vulnerable")
    # the slack widens the findings' spans, so that overlapping is all that is asked
    spans = spans.select("app", "finding_ord", "family", "file", (F.col("lo") - slack).alias("lo"), (F.col("hi") + slack).alias("hi"))
    place = ["app", "family", "file"]
    met = least_overlapping(spans, c, place, "lo", "hi", "a", "b", F.struct("case_ord", "vulnerable"))
    first = spans.join(met, [*place, "lo", "hi"]).groupBy("app", "finding_ord").agg(F.min("least").alias("c"))
    rank = F.row_number().over(Window.partitionBy("app", "c.case_ord").orderBy("finding_ord"))
    first = first.select("app", "finding_ord", F.col("c.case_ord").alias("case_ord"), F.col("c.vulnerable").alias("vulnerable"), rank.alias("k"))
    out = findings.select("app", "finding_ord", "family").join(first, ["app", "finding_ord"], "left")
    kind = F.when(F.col("family").isNull(), "out_of_scope").when(F.col("case_ord").isNull(), "fp_unmatched").when(F.col("k") > 1, "duplicate").when(F.col("vulnerable"), "tp").otherwise("fp_safe")
    return out.select("app", "finding_ord", "family", "case_ord", kind.alias("outcome"))


def missed(result: DataFrame, cases: DataFrame) -> DataFrame:
    """Vulnerable cases that no finding belongs to: (app, case_ord, family)."""
    hit = result.where(F.col("outcome") == "tp").select("app", "case_ord").distinct()
    return cases.where("vulnerable").select("app", "case_ord", "family").distinct().join(hit, ["app", "case_ord"], "left_anti")


def metrics(result: DataFrame, cases: DataFrame) -> DataFrame:
    """Counts and rates by family, and over all as family `micro`; every family of the cases has a row."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    every = cases.select("app", "case_ord", "family", "vulnerable").distinct()
    events = (
        result.select("family", F.col("outcome").alias("kind"))
        .unionByName(missed(result, cases).select("family", F.lit("fn").alias("kind")))
        .unionByName(every.select("family", F.when(F.col("vulnerable"), "vulnerable").otherwise("safe").alias("kind")))
        .where(F.col("family").isNotNull())
    )
    rows = events.rollup("family").agg(n("tp").alias("tp"), n("fn").alias("fn"), n("fp_safe").alias("fp_safe"), n("fp_unmatched").alias("fp_unmatched"), n("safe").alias("safe_cases")).withColumn("family", F.coalesce("family", F.lit("micro")))
    fp = F.col("fp_safe") + F.col("fp_unmatched")
    rows = rows.withColumn("precision", ratio(F.col("tp"), F.col("tp") + fp)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    p, r = wilson(F.col("tp"), F.col("tp") + fp), wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return rows.select("*", f1(F.col("precision"), F.col("recall")).alias("f1"), p[0].alias("precision_low"), p[1].alias("precision_high"), r[0].alias("recall_low"), r[1].alias("recall_high"), ratio(F.col("fp_safe"), F.col("safe_cases")).alias("lookalike_rate"))


def finding_labels(result: DataFrame) -> DataFrame:
    """Training labels: 1 for a hit, 0 for false ones, null where nothing is known."""
    return result.withColumn("label", F.when(F.col("outcome") == "tp", 1).when(F.col("outcome").isin("fp_safe", "fp_unmatched"), 0))


def pairs(hits: DataFrame) -> DataFrame:
    """Before and after a fix: (id, family, vulnerable, hits) to detected, still flagged, success, complete."""
    side = lambda v: F.max(F.when(F.col("vulnerable") == v, F.col("hits")))
    x = hits.groupBy("id", "family").agg(side(True).alias("before"), side(False).alias("after"))
    whole = F.col("before").isNotNull() & F.col("after").isNotNull()
    return x.select("id", "family", whole.alias("complete"), (F.col("before") > 0).alias("detected"), (F.col("after") > 0).alias("still"), (whole & (F.col("before") > 0) & (F.col("after") == 0)).alias("success"))


def first_enclosing(points: DataFrame, spans: DataFrame, file: str = "file") -> DataFrame:
    """points (file, point_ord, line) with the first span (file, span_ord, lo, hi, name) that holds them, else `file:line`."""
    s = spans.select(file, "span_ord", "lo", "hi", "name")
    near = least_holding(points, s, [file], "line", "lo", "hi", F.struct("lo", "span_ord", "name")).select(file, "line", F.col("least.name").alias("name"))
    return points.join(near, [file, "line"], "left").withColumn("name", F.coalesce("name", F.concat_ws(":", F.col(file).cast("string"), F.col("line").cast("string"))))


def latest_covering(needs: DataFrame, reads: DataFrame) -> DataFrame:
    """Each need (need_id, run, lo, hi) with the latest read (run, read_ord, a, b) that covers its span, or null."""
    over = greatest_covering(needs, reads, ["run"], "lo", "hi", "a", "b", F.col("read_ord"))
    return needs.join(over.withColumnRenamed("greatest", "read_ord"), ["run", "lo", "hi"], "left")


def evidence_faults(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Why a piece of evidence (evidence_id, run, event_id, file, lo, hi) does not hold; null where it does.

    events: run, event_id, tool, status, file, a, b, matches array<int>.
    """
    e = events.select("run", "event_id", "tool", "status", F.col("file").alias("e_file"), "a", "b", "matches")
    x = evidence.join(e, ["run", "event_id"], "left")
    fault = (
        F.when(F.col("tool").isNull(), "unknown event")
        .when(F.col("status") != "ok", "event failed")
        .when(F.col("e_file") != F.col("file"), "other file")
        .when((F.col("tool") == "read") & ~((F.col("a") <= F.col("lo")) & (F.col("b") >= F.col("hi"))), "lines not read")
        .when((F.col("tool") == "search") & ~F.exists("matches", lambda m: m.between(F.col("lo"), F.col("hi"))), "no match in range")
        .when((F.col("tool") == "scan") & ~overlap("lo", "hi", "a", "b"), "no finding there")
    )
    return x.select("evidence_id", fault.alias("fault"))


def violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key is missing on the right."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def siblings(members: DataFrame, group: str, key: str, guarded: str, most: int = 2) -> DataFrame:
    """(key, sibling, rank): for unguarded members the first guarded ones of their group.

    A group's first guarded members are taken before the join, so no group becomes its pairs.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(key))
    best = members.where(guarded).select(group, F.col(key).alias("sibling"), rank.alias("rank")).where(F.col("rank") <= most)
    return members.where(f"not {guarded}").select(key, group).join(best, group).select(key, group, "sibling", "rank")


def closure(edges: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """(id, depth) reachable from start (id) in so many steps over edges (child, parent), keys frozen at each round."""
    known = start.select("id", F.lit(0).alias("depth"))
    for k in range(1, rounds + 1):
        step = edges.join(known.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id")).distinct()
        known = known.unionByName(step.join(known, "id", "left_anti").select("id", F.lit(k).alias("depth")))
    return known
