"""Queries that aggregate, compare sets and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.text import clipped_sigmoid, cwe_number
from marlstone.operators import report as R
from marlstone.plans import query
from marlstone.sources.tables import table


@query(
    "trace_reliability",
    """SELECT event_type AS tool, count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 <> 0) AS ok, count(*) FILTER (event_id % 7 = 0) AS error, count(*) FILTER (event_id % 7 <> 0 AND event_id % 11 = 0) AS denied,
    round(avg(value), 4) AS mean_ms FROM events GROUP BY event_type""",
)
def trace_reliability(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_id") % 7 == 0, "error").when(F.col("event_id") % 11 == 0, "denied").otherwise("ok")
    e = table(spark, d, "events").select(F.col("event_type").alias("tool"), status.alias("status"), F.col("value").alias("ms"))
    return R.reliability(e)


@query(
    "injection_summary",
    """WITH r AS (SELECT user_id % 8 AS attack, event_type = 'view' AS clean, value > 20 AS reported, (event_id % 17 = 0)::INT AS leak FROM events)
    SELECT attack, count(*) FILTER (clean AND reported) AS clean_reported, count(*) FILTER (NOT clean AND reported) AS attacked_reported, count(*) FILTER (clean) AS clean_runs, sum(leak)::BIGINT AS leaks,
    count(*) FILTER (clean AND reported) > 0 AS measurable, count(*) FILTER (clean AND reported) * 2 > count(*) FILTER (NOT clean AND reported) AS changed FROM r GROUP BY attack""",
)
def injection_summary(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").select((F.col("user_id") % 8).alias("attack"), (F.col("event_type") == "view").alias("clean"), (F.col("value") > 20).alias("reported"), (F.col("event_id") % 17 == 0).cast("int").alias("leak"))
    clean, other = F.count_if(F.col("clean") & F.col("reported")), F.count_if(~F.col("clean") & F.col("reported"))
    return r.groupBy("attack").agg(clean.alias("clean_reported"), other.alias("attacked_reported"), F.count_if("clean").alias("clean_runs"), F.sum("leak").alias("leaks"), (clean > 0).alias("measurable"), (clean * 2 > other).alias("changed"))


@query("framework_vote", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, arg_max(lang, (n, -list_position(['en', 'de', 'fr', 'es'], lang))) AS winner FROM c GROUP BY source")
def framework_vote(spark: SparkSession, d: str) -> DataFrame:
    """The commonest language of a source; ties go to the one that stands first in a fixed order."""
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*map(F.lit, ("en", "de", "fr", "es"))), F.col("lang"))
    return c.groupBy("source").agg(F.max_by("lang", F.struct("n", (-place).alias("p"))).alias("winner"))


@query("verdict_histogram", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def verdict_histogram(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    m = F.map_values("m")
    return by.select("user_id", F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.coalesce(F.try_element_at("m", F.lit("error")), F.lit(0)).alias("errors"), F.size("m").cast("long").alias("kinds"))


@query(
    "consistency_missing",
    """WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag <> 'R' AS gated FROM lineitem), r AS (SELECT l_suppkey FROM f GROUP BY l_suppkey HAVING count(*) >= 4 AND avg(gated::INT) >= 0.68)
    SELECT l_suppkey, l_orderkey, l_linenumber FROM f WHERE NOT gated AND l_suppkey IN (SELECT l_suppkey FROM r)""",
)
def consistency_missing(spark: SparkSession, d: str) -> DataFrame:
    """Rows without what at least half of their group of four or more has."""
    f = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_returnflag") != "R").alias("gated"))
    return R.odd_ones(f, "l_suppkey", "gated", 4, 0.68).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("file_load", "SELECT doc_id, round(ln(1 + count(*) OVER (PARTITION BY source, lang)) / 3, 6) AS load FROM documents")
def file_load(spark: SparkSession, d: str) -> DataFrame:
    """The log of how many candidates a file has; counted first, so a hot file is no hot window."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    n = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return docs.join(n, ["source", "lang"]).select("doc_id", F.round(F.log1p("n") / 3, 6).alias("load"))


@query("mean_seconds", "SELECT event_type, round(avg(nullif(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END, 0)), 4) AS mean FROM events GROUP BY event_type")
def mean_seconds(spark: SparkSession, d: str) -> DataFrame:
    v = F.nullif(F.when(F.col("event_id") % 3 == 0, F.lit(0.0)).otherwise(F.col("value")), F.lit(0.0))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(v), 4).alias("mean"))


@query(
    "family_pivot",
    """SELECT source, printf('%d/%d', count(*) FILTER (lang = 'en' AND n_chars > 1500), count(*) FILTER (lang = 'en')) AS en, printf('%d/%d', count(*) FILTER (lang = 'de' AND n_chars > 1500), count(*) FILTER (lang = 'de')) AS de FROM documents GROUP BY source""",
)
def family_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").groupBy("source").pivot("lang", ["en", "de"]).agg(F.count_if(F.col("n_chars") > 1500).alias("a"), F.count(F.lit(1)).alias("n"))
    cell = lambda c: F.format_string("%d/%d", F.coalesce(f"{c}_a", F.lit(0)), F.coalesce(f"{c}_n", F.lit(0))).alias(c)
    return p.select("source", cell("en"), cell("de"))


@query(
    "cwe_by_source",
    "SELECT p_brand, array_to_string(list_transform(list_sort(list_distinct(list(p_size))), lambda x: 'CWE-' || x), ' ') AS ids FROM part GROUP BY p_brand",
)
def cwe_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids of a source in the order of their numbers."""
    x = table(spark, d, "part").select("p_brand", F.concat(F.lit("CWE-"), "p_size").alias("id")).distinct()
    g = x.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct(cwe_number("id").alias("n"), "id"))).alias("x"))
    return g.select("p_brand", F.array_join(F.transform("x", lambda r: r["id"]), " ").alias("ids"))


@query("status_merge", "SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'complete' WHEN bool_and(o_orderstatus = 'O') THEN 'blocked' ELSE 'partial' END AS status, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS covered FROM orders GROUP BY o_custkey")
def status_merge(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.every(F.col("o_orderstatus") == "F"), "complete").when(F.every(F.col("o_orderstatus") == "O"), "blocked").otherwise("partial")
    return table(spark, d, "orders").groupBy("o_custkey").agg(s.alias("status"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("covered"))


@query(
    "set_algebra",
    """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount > 0.09), u AS (SELECT k FROM a UNION SELECT k FROM b)
    SELECT k, k IN (SELECT k FROM a) AND k NOT IN (SELECT k FROM b) AS only_a, k IN (SELECT k FROM a) AND k IN (SELECT k FROM b) AS both_have FROM u""",
)
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    """Union, difference and intersection of id sets in one aggregation."""
    x = table(spark, d, "lineitem").where("l_quantity > 49 or l_discount > 0.09").groupBy(F.col("l_suppkey").alias("k")).agg(F.bool_or(F.col("l_quantity") > 49).alias("a"), F.bool_or(F.col("l_discount") > 0.09).alias("b"))
    return x.select("k", (F.col("a") & ~F.col("b")).alias("only_a"), (F.col("a") & F.col("b")).alias("both_have"))


@query("seed_union", "SELECT 0 AS part, p_partkey AS k FROM part WHERE p_size = 50 UNION ALL SELECT 1, s_suppkey FROM supplier WHERE s_acctbal < 0")
def seed_union(spark: SparkSession, d: str) -> DataFrame:
    return R.union_ordered([table(spark, d, "part").where("p_size = 50").select(F.col("p_partkey").alias("k")), table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("k"))])


@query("array_subset", "SELECT conv_id, list_has_all(['user', 'assistant'], list(role)) AS subset, count(DISTINCT role) AS n FROM conversations GROUP BY conv_id")
def array_subset(spark: SparkSession, d: str) -> DataFrame:
    roles = F.collect_set("role")
    return table(spark, d, "conversations").groupBy("conv_id").agg((F.size(F.array_except(roles, F.array(F.lit("user"), F.lit("assistant")))) == 0).alias("subset"), F.size(roles).cast("long").alias("n"))


@query("severity_order", "SELECT o_orderkey, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority) AS rank FROM orders WHERE list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority) IS NOT NULL ORDER BY rank, o_orderkey LIMIT 200")
def severity_order(spark: SparkSession, d: str) -> DataFrame:
    rank = F.nullif(F.array_position(F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM"))), F.col("o_orderpriority")), F.lit(0).cast("long"))
    return table(spark, d, "orders").select("o_orderkey", rank.cast("int").alias("rank")).where("rank is not null").orderBy("rank", "o_orderkey").limit(200)


@query(
    "sarif_export",
    """SELECT o_orderkey, json_object('ruleId', 'CWE-' || (o_orderkey % 90), 'level', CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'warning' ELSE 'note' END,
    'message', json_object('text', o_orderpriority), 'fingerprint', substr(sha256(o_orderkey || ':' || o_custkey), 1, 16))::VARCHAR AS result FROM orders""",
)
def sarif_export(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("CWE-"), F.col("o_orderkey") % 90).alias("rule"), F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("low").alias("severity"), F.col("o_orderpriority").alias("message"), F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("place"))
    return x.select("o_orderkey", R.sarif_result("rule", "severity", "message", "place").alias("result"))


@query("markdown_report", "SELECT n_name, string_agg(printf('- %s: %d', s_name, s_suppkey), chr(10) ORDER BY s_suppkey) AS report FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows, whatever the data
    return R.bullet_report(s, "n_name", "s_suppkey", F.format_string("- %s: %d", "s_name", "s_suppkey"))


@query("linear_score", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-greatest(-30, least(30, 0.02 * l_quantity - 8 * l_discount + 3 * l_tax - 0.5)))), 6) AS p FROM lineitem")
def linear_score(spark: SparkSession, d: str) -> DataFrame:
    x, w = F.array("l_quantity", "l_discount", "l_tax"), F.array(F.lit(0.02), F.lit(-8.0), F.lit(3.0))
    dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) - 0.5
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(clipped_sigmoid(dot), 6).alias("p"))


@query("summary_upsert", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS version FROM orders GROUP BY o_custkey")
def summary_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Later rows replace earlier ones of the same key."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max("o_orderkey").alias("version"))


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("scenario_product", "SELECT n_nationkey AS attack, v AS variant, s AS seed, replace('run {v} on ' || n_name, '{v}', v) AS text FROM nation, (SELECT unnest(['clean', 'injected']) AS v), (SELECT unnest([0, 1, 2]) AS s)")
def scenario_product(spark: SparkSession, d: str) -> DataFrame:
    """Each case with each variant and seed, from one row by explode."""
    x = table(spark, d, "nation").withColumn("variant", F.explode(F.array(F.lit("clean"), F.lit("injected")))).withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return x.select(F.col("n_nationkey").alias("attack"), "variant", "seed", F.replace(F.concat(F.lit("run {v} on "), "n_name"), F.lit("{v}"), F.col("variant")).alias("text"))


@query("handler_ratio", "SELECT DISTINCT source, round(avg((n_chars > 1000)::INT) OVER (PARTITION BY source), 6) AS by_file, round(avg((n_chars > 1000)::INT) OVER (), 6) AS by_app FROM documents")
def handler_ratio(spark: SparkSession, d: str) -> DataFrame:
    """A share at two levels from one pass: the second sums the first's counts."""
    x = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 1000).alias("k"), F.count(F.lit(1)).alias("n"))
    whole = F.sum("k").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
    return x.select("source", F.round(F.col("k") / F.col("n"), 6).alias("by_file"), F.round(whole, 6).alias("by_app"))
