"""Queries over findings and cases. Findings are lines of documents that a pattern hits; cases are stretches of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import match as M
from marlstone.plans import query
from marlstone.plans.text import SQL_LINES
from marlstone.sources.tables import lines, table

_FC = rf"""
WITH {SQL_LINES},
cases AS (
  SELECT source AS app, doc_id * 2 + side AS case_ord, lang AS family, quality = side AS vulnerable, doc_id AS file, side * 3 + 1 AS lo, side * 3 + 2 AS hi
  FROM labels JOIN documents USING (doc_id), (SELECT unnest([0, 1]) AS side) WHERE quality IS NOT NULL),
findings AS (
  SELECT source AS app, doc_id * 10000000 + n AS finding_ord, CASE WHEN n % 11 = 10 THEN NULL ELSE lang END AS family, doc_id AS file, n AS lo, n + 1 AS hi
  FROM lines JOIN documents USING (doc_id) WHERE regexp_matches(line, 'ou')),
near AS (
  SELECT f.app, f.finding_ord, min(c.case_ord) AS case_ord FROM findings f JOIN cases c ON f.app = c.app AND f.family = c.family AND f.file = c.file
  AND f.lo <= c.hi + 2 AND f.hi >= c.lo - 2 GROUP BY ALL),
ranked AS (
  SELECT n.*, c.vulnerable, row_number() OVER (PARTITION BY n.app, n.case_ord ORDER BY n.finding_ord) AS k
  FROM near n JOIN (SELECT DISTINCT app, case_ord, vulnerable FROM cases) c USING (app, case_ord)),
result AS (
  SELECT f.app, f.finding_ord, f.family, r.case_ord, CASE WHEN f.family IS NULL THEN 'out_of_scope' WHEN r.case_ord IS NULL THEN 'fp_unmatched' WHEN r.k > 1 THEN 'duplicate'
  WHEN r.vulnerable THEN 'tp' ELSE 'fp_safe' END AS outcome FROM findings f LEFT JOIN ranked r USING (app, finding_ord))"""

_METRICS = (
    _FC
    + """,
missed AS (SELECT DISTINCT app, case_ord, family FROM cases c WHERE vulnerable AND NOT EXISTS (SELECT 1 FROM result r WHERE r.outcome = 'tp' AND r.app = c.app AND r.case_ord = c.case_ord)),
events AS (SELECT family, outcome AS kind FROM result WHERE family IS NOT NULL UNION ALL SELECT family, 'fn' FROM missed
  UNION ALL SELECT family, CASE WHEN vulnerable THEN 'vulnerable' ELSE 'safe' END FROM (SELECT DISTINCT app, case_ord, family, vulnerable FROM cases)),
counts AS (SELECT coalesce(family, 'micro') AS family, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fn') AS fn, count(*) FILTER (kind = 'fp_safe') AS fp_safe,
  count(*) FILTER (kind = 'fp_unmatched') AS fp_unmatched, count(*) FILTER (kind = 'safe') AS safe_cases FROM events GROUP BY ROLLUP (family)),
rates AS (SELECT *, tp + fp_safe + fp_unmatched AS np, tp + fn AS nr, CASE WHEN tp + fp_safe + fp_unmatched > 0 THEN tp::DOUBLE / (tp + fp_safe + fp_unmatched) END AS precision,
  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall FROM counts)
"""
)


def cases(spark: SparkSession, d: str) -> DataFrame:
    sides = table(spark, d, "labels").where("quality is not null").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    return sides.select(F.col("source").alias("app"), (F.col("doc_id") * 2 + F.col("side")).alias("case_ord"), F.col("lang").alias("family"), (F.col("quality") == F.col("side")).alias("vulnerable"), F.col("doc_id").alias("file"), (F.col("side") * 3 + 1).alias("lo"), (F.col("side") * 3 + 2).alias("hi"))


def findings(spark: SparkSession, d: str) -> DataFrame:
    hit = lines(table(spark, d, "documents").select("doc_id", "source", "lang", "text")).where("line rlike 'ou'")
    family = F.when(F.col("n") % 11 != 10, F.col("lang"))
    return hit.select(F.col("source").alias("app"), (F.col("doc_id") * 10_000_000 + F.col("n")).alias("finding_ord"), family.alias("family"), F.col("doc_id").alias("file"), F.array(F.struct(F.col("n").alias("lo"), (F.col("n") + 1).alias("hi"))).alias("ranges"))


@query("overlap_match_outcome", _FC + " SELECT * FROM result")
def overlap_match_outcome(spark: SparkSession, d: str) -> DataFrame:
    return M.outcomes(findings(spark, d), cases(spark, d))


@query("missed_cases", _METRICS + " SELECT * FROM missed")
def missed_cases(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return M.missed(M.outcomes(findings(spark, d), c), c)


@query(
    "metrics_rollup",
    _METRICS
    + """SELECT family, tp, fn, fp_safe, fp_unmatched, safe_cases, precision, recall,
  CASE WHEN precision IS NOT NULL AND recall IS NOT NULL THEN CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END END AS f1,
  CASE WHEN np > 0 THEN greatest(0.0, (precision + 3.8416 / (2 * np)) / (1 + 3.8416 / np) - 1.96 * sqrt(precision * (1 - precision) / np + 3.8416 / (4.0 * np * np)) / (1 + 3.8416 / np)) END AS precision_low,
  CASE WHEN np > 0 THEN least(1.0, (precision + 3.8416 / (2 * np)) / (1 + 3.8416 / np) + 1.96 * sqrt(precision * (1 - precision) / np + 3.8416 / (4.0 * np * np)) / (1 + 3.8416 / np)) END AS precision_high,
  CASE WHEN nr > 0 THEN greatest(0.0, (recall + 3.8416 / (2 * nr)) / (1 + 3.8416 / nr) - 1.96 * sqrt(recall * (1 - recall) / nr + 3.8416 / (4.0 * nr * nr)) / (1 + 3.8416 / nr)) END AS recall_low,
  CASE WHEN nr > 0 THEN least(1.0, (recall + 3.8416 / (2 * nr)) / (1 + 3.8416 / nr) + 1.96 * sqrt(recall * (1 - recall) / nr + 3.8416 / (4.0 * nr * nr)) / (1 + 3.8416 / nr)) END AS recall_high,
  CASE WHEN safe_cases > 0 THEN fp_safe::DOUBLE / safe_cases END AS lookalike_rate FROM rates""",
)
def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d)
    return M.metrics(M.outcomes(findings(spark, d), c), c)


@query("finding_labels", _FC + " SELECT outcome, CASE WHEN outcome = 'tp' THEN 1 WHEN outcome IN ('fp_safe', 'fp_unmatched') THEN 0 END AS label, count(*) AS n FROM result GROUP BY ALL")
def finding_labels(spark: SparkSession, d: str) -> DataFrame:
    return M.finding_labels(M.outcomes(findings(spark, d), cases(spark, d))).groupBy("outcome", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pair_success",
    """WITH sides AS (SELECT conv_id AS id, turn % 2 = 0 AS vulnerable, sum(length(text) // 400)::BIGINT AS hits FROM conversations GROUP BY ALL),
    x AS (SELECT id, max(hits) FILTER (vulnerable) AS b, max(hits) FILTER (NOT vulnerable) AS a FROM sides GROUP BY id)
    SELECT id, 'all' AS family, b IS NOT NULL AND a IS NOT NULL AS complete, b > 0 AS detected, a > 0 AS still, (b IS NOT NULL AND a IS NOT NULL) AND b > 0 AND a = 0 AS success FROM x""",
)
def pair_success(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's user turns stand for the version before a fix, the answers for the one after it."""
    t = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id"), (F.col("turn") % 2 == 0).alias("vulnerable")).agg(F.sum(F.expr("length(text) div 400")).alias("hits"))
    return M.pairs(t.withColumn("family", F.lit("all")))


@query(
    "pair_rates",
    """WITH sides AS (SELECT conv_id AS id, conv_id % 3 AS family, turn % 2 = 0 AS vulnerable, sum(length(text) // 400)::BIGINT AS hits FROM conversations GROUP BY ALL),
    x AS (SELECT id, family, max(hits) FILTER (vulnerable) AS b, max(hits) FILTER (NOT vulnerable) AS a FROM sides GROUP BY ALL)
    SELECT family, count(*) AS n, count(*) FILTER (b > 0) AS detected, count(*) FILTER (b > 0 AND a = 0) AS success, count(*) FILTER (b > 0 AND a = 0)::DOUBLE / count(*) AS rate FROM x GROUP BY family""",
)
def pair_rates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id"), (F.col("conv_id") % 3).alias("family"), (F.col("turn") % 2 == 0).alias("vulnerable")).agg(F.sum(F.expr("length(text) div 400")).alias("hits"))
    p = M.pairs(t).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if("detected").alias("detected"), F.count_if("success").alias("success"))
    return p.withColumn("rate", F.col("success").cast("double") / F.col("n"))


@query(
    "route_window_overlap",
    """SELECT l.l_orderkey, l.l_linenumber, w.l_linenumber AS window_line FROM lineitem l JOIN lineitem w ON l.l_orderkey = w.l_orderkey AND w.l_quantity > 45
    WHERE l.l_linenumber + 1 >= w.l_linenumber AND l.l_linenumber <= w.l_linenumber + 1 AND l.l_quantity < 10""",
)
def route_window_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Windows of two lines that meet spans of two lines in the same order."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    a = rows.where("l_quantity < 10").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + 1).alias("hi"))
    w = rows.where("l_quantity > 45").select("l_orderkey", F.col("l_linenumber").alias("window_line"), F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + 1).alias("b"))
    return a.join(w, "l_orderkey").where(M.overlap("lo", "hi", "a", "b")).select("l_orderkey", "l_linenumber", "window_line")


@query(
    "line_to_route",
    rf"""WITH {SQL_LINES}, points AS (SELECT doc_id, n, doc_id * 10000000 + n AS p FROM lines WHERE contains(line, ' = "')),
    spans AS (SELECT doc_id, side AS span_ord, side * 4 + 1 AS lo, side * 4 + 5 AS hi, 'part' || side AS name FROM documents, (SELECT unnest([0, 1, 2]) AS side)),
    hit AS (SELECT p, arg_min(name, lo) AS name FROM points JOIN spans USING (doc_id) WHERE n BETWEEN lo AND hi GROUP BY p)
    SELECT doc_id, n, coalesce(name, doc_id || ':' || n) AS name FROM points LEFT JOIN hit USING (p)""",
)
def line_to_route(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    points = lines(docs.where("contains(text, ' = \"')").select("doc_id", "text")).where("contains(line, ' = \"')").select("doc_id", F.col("n").alias("line"), (F.col("doc_id") * 10_000_000 + F.col("n")).alias("point_ord"))
    spans = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("span_ord")).select("doc_id", "span_ord", (F.col("span_ord") * 4 + 1).alias("lo"), (F.col("span_ord") * 4 + 5).alias("hi"), F.concat(F.lit("part"), F.col("span_ord").cast("string")).alias("name"))
    return M.first_enclosing(points, spans, "doc_id").select("doc_id", F.col("line").cast("long").alias("n"), "name")


@query(
    "latest_covering_event",
    """WITH needs AS (SELECT event_id AS need_id, user_id AS run, (floor(value)::BIGINT % 50) AS lo, (floor(value)::BIGINT % 50) + 5 AS hi FROM events WHERE event_type = 'purchase'),
    reads AS (SELECT user_id AS run, event_id AS read_ord, (floor(value)::BIGINT % 40) AS a, (floor(value)::BIGINT % 40) + 30 AS b FROM events WHERE event_type = 'view')
    SELECT need_id, (SELECT max(read_ord) FROM reads r WHERE r.run = n.run AND a <= lo AND b >= hi) AS read_ord FROM needs n""",
)
def latest_covering_event(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    v = F.expr("cast(floor(value) as bigint)")
    needs = e.where("event_type = 'purchase'").select(F.col("event_id").alias("need_id"), F.col("user_id").alias("run"), (v % 50).alias("lo"), (v % 50 + 5).alias("hi"))
    reads = e.where("event_type = 'view'").select(F.col("user_id").alias("run"), F.col("event_id").alias("read_ord"), (v % 40).alias("a"), (v % 40 + 30).alias("b"))
    return M.latest_covering(needs, reads).select("need_id", "read_ord")


@query(
    "evidence_validation",
    """WITH ev AS (SELECT event_id, user_id AS run, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' ELSE 'scan' END AS tool, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
      user_id % 7 AS file, event_id % 30 AS a, event_id % 30 + 9 AS b FROM events),
    x AS (SELECT e.event_id AS evidence_id, e.event_id + (e.event_id % 5 = 0)::INT * 100000000 AS of_event, e.user_id AS run, e.user_id % 7 + (e.event_id % 13 = 0)::INT AS file, e.event_id % 30 + e.event_id % 9 AS lo, e.event_id % 30 + e.event_id % 9 + 2 AS hi FROM events e)
    SELECT evidence_id, CASE WHEN tool IS NULL THEN 'unknown event' WHEN status <> 'ok' THEN 'event failed' WHEN ev.file <> x.file THEN 'other file' WHEN tool = 'read' AND NOT (a <= lo AND b >= hi) THEN 'lines not read'
      WHEN tool = 'search' AND NOT (a BETWEEN lo AND hi OR a + 3 BETWEEN lo AND hi) THEN 'no match in range' WHEN tool = 'scan' AND NOT (lo <= b AND hi >= a) THEN 'no finding there' END AS fault
    FROM x LEFT JOIN ev ON ev.run = x.run AND ev.event_id = x.of_event""",
)
def evidence_validation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    tool = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "search").otherwise("scan")
    a = F.col("event_id") % 30
    events = e.select(F.col("user_id").alias("run"), "event_id", tool.alias("tool"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), (F.col("user_id") % 7).alias("file"), a.alias("a"), (a + 9).alias("b"), F.array(a, a + 3).alias("matches"))
    lo = a + F.col("event_id") % 9
    flag = lambda n: (F.col("event_id") % n == 0).cast("int")
    x = e.select(F.col("event_id").alias("evidence_id"), F.col("user_id").alias("run"), (F.col("event_id") + flag(5) * 100000000).alias("event_id"), (F.col("user_id") % 7 + flag(13)).alias("file"), lo.alias("lo"), (lo + 2).alias("hi"))
    return M.evidence_faults(x, events)


@query("referential_violations", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def referential_violations(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return M.violations(orders, table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k").select("o_orderkey", F.col("k").alias("o_custkey"))


@query(
    "guarded_siblings",
    """WITH g AS (SELECT p_brand, p_partkey AS sibling, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank FROM part WHERE p_size > 40)
    SELECT p.p_partkey, p.p_brand, g.sibling, g.rank FROM part p JOIN g USING (p_brand) WHERE p.p_size <= 40 AND g.rank <= 2""",
)
def guarded_siblings(spark: SparkSession, d: str) -> DataFrame:
    return M.siblings(table(spark, d, "part").withColumn("guarded", F.col("p_size") > 40), "p_brand", "p_partkey", "guarded").withColumn("rank", F.col("rank").cast("long"))


@query(
    "ownership_closure",
    """WITH RECURSIVE e(child, parent) AS (SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
    w(id, depth) AS (SELECT 'r' || r_regionkey, 0 FROM region WHERE r_regionkey < 2 UNION ALL SELECT child, depth + 1 FROM w JOIN e ON e.parent = w.id WHERE depth < 2)
    SELECT id, min(depth) AS depth FROM w GROUP BY id""",
)
def ownership_closure(spark: SparkSession, d: str) -> DataFrame:
    """What two rounds of foreign keys reach from two regions."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda t, p, c, q, k: table(spark, d, t).select(name(p, c).alias("child"), name(q, k).alias("parent"))
    edges = edge("nation", "n", "n_nationkey", "r", "n_regionkey").unionByName(edge("customer", "c", "c_custkey", "n", "c_nationkey")).unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    return M.closure(edges, table(spark, d, "region").where("r_regionkey < 2").select(name("r", "r_regionkey").alias("id")), 2)
