"""Queries that build and check a catalogue: cases, references, chunks, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import catalog as K
from marlstone.plans import query
from marlstone.sources import tables as S
from marlstone.sources.tables import table


@query("family_categories", "SELECT DISTINCT a.p_brand AS family, b.p_type AS category FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1")
def family_categories(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    ids = lambda g, name, r: p.where(f"p_partkey % 2 = {r}").groupBy(F.col(g).alias(name)).agg(F.collect_set(F.concat(F.lit("CWE-"), "p_size")).alias("cwe_ids"))
    return K.family_categories(ids("p_brand", "family", 0), ids("p_type", "category", 1))


@query("core_split", "SELECT p_size IN (1, 2, 3) AS core, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 40 GROUP BY core")
def core_split(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "lineitem").where("l_quantity > 40").select(F.lit("a").alias("app"), F.col("l_partkey").alias("id"))
    primary = table(spark, d, "part").select(F.lit("a").alias("app"), F.col("p_partkey").alias("id"), F.concat(F.lit("CWE-"), "p_size").alias("cwe"))
    return K.core_split(hits, primary, ["CWE-1", "CWE-2", "CWE-3"])


@query("card_chunks", "SELECT c_custkey::VARCHAR AS id, unnest(['c_name', 'c_mktsegment']) AS section, unnest([c_name, c_mktsegment]) AS text FROM customer")
def card_chunks(spark: SparkSession, d: str) -> DataFrame:
    return K.card_chunks(table(spark, d, "customer").withColumn("id", F.col("c_custkey").cast("string")), ["c_name", "c_mktsegment"])


@query("broken_references", "SELECT event_id::VARCHAR AS id, 'x.refs' AS path, (user_id % 400)::VARCHAR AS ref FROM events WHERE user_id % 400 NOT IN (SELECT s_suppkey FROM supplier)")
def broken_references(spark: SparkSession, d: str) -> DataFrame:
    cards = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.to_json(F.struct(F.struct(F.array((F.col("user_id") % 400).cast("string")).alias("refs")).alias("x"))).alias("json"))
    return K.broken_references(K.references(cards), table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"))).select("id", "path", "ref")


@query("label_cases", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'f0' WHEN p_size % 5 = 0 THEN 'f1' END AS family, greatest(1, p_size - 8) AS lo, p_size + 8 AS hi FROM part")
def label_cases(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    first = F.when(s % 4 == 0, "CWE-0").otherwise("CWE-9")
    more = F.when(s % 5 == 0, F.array(F.lit("CWE-8"), F.lit("CWE-1")))
    x = table(spark, d, "part").select("p_partkey", first.alias("primary_cwe"), more.alias("acceptable_cwes"), s.alias("line_start"), F.lit(None).cast("int").alias("line_end"))
    return S.label_cases(x, {"CWE-0": "f0", "CWE-1": "f1"}).select("p_partkey", "family", "lo", "hi")


@query("pair_cases", "SELECT l_orderkey AS id, l_linenumber AS line, v AS vulnerable, CASE WHEN v THEN l_partkey ELSE l_suppkey END AS first FROM lineitem, (SELECT unnest([true, false]) AS v)")
def pair_cases(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.array(F.array(F.col(c), F.col(c) + 1))
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("f").alias("family"), F.col("l_linenumber").alias("path"), one("l_partkey").alias("vulnerable_ranges"), one("l_suppkey").alias("fixed_ranges"))
    return S.pair_cases(x).select("id", F.col("path").alias("line"), "vulnerable", F.col("ranges")[0][0].alias("first"))


_RULES = "SELECT 'rule' || (event_id % 5) AS rule_id, 'fam' || (event_id % 5) AS family, 'f' || (user_id % 9) AS file, (event_id % 300)::INT AS line_start, (event_id % 300 + 2)::INT AS line_end, 'WARN' AS severity, event_type AS message, 'rules' AS scanner FROM events WHERE event_type = 'click'"
_LINT = "SELECT 'B' || (event_id % 3), 'lint', 'f' || (user_id % 9), (event_id % 300)::INT, (event_id % 300 + 4)::INT, 'LOW', event_type, 'lint' FROM events WHERE event_type = 'view'"


@query("scan_union", f"SELECT rule_id, family, file, line_start, line_end, severity, message, scanner FROM ({_RULES} UNION ALL {_LINT}) ORDER BY file, line_start, scanner, rule_id LIMIT 100")
def scan_union(spark: SparkSession, d: str) -> DataFrame:
    """Results of two scanners, read from their JSON, in one order."""
    e = table(spark, d, "events")
    file, line = F.concat(F.lit("f"), F.col("user_id") % 9), (F.col("event_id") % 300).cast("int")
    rule = F.struct(F.concat(F.lit("a.b.rule"), F.col("event_id") % 5).alias("check_id"), file.alias("path"), F.struct(line.alias("line")).alias("start"), F.struct((line + 2).alias("line")).alias("end"), F.struct(F.col("event_type").alias("message"), F.lit("WARN").alias("severity")).alias("extra"))
    lint = F.struct(F.concat(F.lit("B"), F.col("event_id") % 3).alias("test_id"), file.alias("filename"), F.array(line + 4, line).alias("line_range"), line.alias("line_number"), F.lit("LOW").alias("issue_severity"), F.col("event_type").alias("issue_text"))
    doc = lambda kind, r: e.where(F.col("event_type") == kind).select(F.to_json(F.struct(F.array(r).alias("results"))).alias("json"))
    a = S.scanner_findings(doc("click", rule), "rules", {f"rule{k}": f"fam{k}" for k in range(5)})
    b = S.scanner_findings(doc("view", lint), "lint", {f"B{k}": "lint" for k in range(3)})
    return S.scan_union(a, b)


@query("wanted_ids", "SELECT DISTINCT 'CWE-' || p_size AS id, p_size <= 30 AS known FROM part WHERE p_partkey % 3 = 0 OR p_brand = 'Brand#11'")
def wanted_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("id", F.concat(F.lit("CWE-"), "p_size"))
    have, lack = K.wanted([p.where("p_partkey % 3 = 0").select("id"), p.where("p_brand = 'Brand#11'").select("id")], spark.range(31).select(F.concat(F.lit("CWE-"), F.col("id").cast("string")).alias("id")))
    return have.withColumn("known", F.lit(True)).unionByName(lack.withColumn("known", F.lit(False)))


@query(
    "manifest_faults",
    """SELECT item_id::VARCHAR AS path, CASE WHEN item_id % 3 = 0 THEN 'unlisted' WHEN item_id % 3 = 1 AND item_id % 2 = 0 THEN 'changed' WHEN item_id % 7 = 0 THEN 'missing' END AS fault FROM benchmark
    WHERE item_id % 3 = 0 AND item_id % 7 <> 0 OR item_id % 3 = 1 AND item_id % 2 = 0 AND item_id % 7 <> 0 OR item_id % 3 <> 0 AND item_id % 7 = 0""".replace(
        "WHEN item_id % 3 = 1 AND item_id % 2 = 0 THEN 'changed' WHEN item_id % 7 = 0 THEN 'missing'", "WHEN item_id % 7 = 0 THEN 'missing' ELSE 'changed'"
    ),
)
def manifest_faults(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    listed = b.where("item_id % 3 <> 0").select(F.col("item_id").cast("string").alias("path"), F.sha2(F.when((F.col("item_id") % 3 == 1) & (F.col("item_id") % 2 == 0), "other").otherwise(F.col("text")), 256).alias("sha256"))
    return K.manifest_faults(listed, b.where("item_id % 7 <> 0").select(F.col("item_id").cast("string").alias("path"), "text"))


@query("wrapped_text", "SELECT item_id, '<<N7' || chr(10) || replace(text, 'N7', '') || chr(10) || 'N7>>' AS shown FROM benchmark")
def wrapped_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", K.wrapped(F.col("text"), "N7").alias("shown"))


@query("claim_totals", "SELECT lang, count(*) AS cards, sum(len(regexp_extract_all(text, '[0-9]{4,}')))::BIGINT AS refs, count(*) FILTER (regexp_matches(text, '[0-9]{4,}')) AS sourced FROM documents GROUP BY lang")
def claim_totals(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_count("text", F.lit("[0-9]{4,}"))
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("cards"), F.sum(n).alias("refs"), F.count_if(n > 0).alias("sourced"))


@query("owner_pattern_join", "SELECT p.p_partkey, s.word FROM part p JOIN (SELECT DISTINCT 'Brand#' || (11 + s_suppkey % 30) AS word FROM supplier) s ON contains(p.p_brand, s.word)")
def owner_pattern_join(spark: SparkSession, d: str) -> DataFrame:
    """Which texts name which words: the texts' words are exploded and met by an equi join, not by a pattern on every pair."""
    words = table(spark, d, "supplier").select(F.concat(F.lit("Brand#"), (11 + F.col("s_suppkey") % 30).cast("string")).alias("word")).distinct()
    p = table(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_brand", " "))).alias("word"))
    return p.join(words, "word").select("p_partkey", "word")


@query("resume_pending", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """Keys without a finished row."""
    o = table(spark, d, "orders")
    return o.select("o_custkey").distinct().join(o.where("o_orderstatus = 'F'").select("o_custkey"), "o_custkey", "left_anti")


@query("changed_files", "SELECT page_id, url FROM pages WHERE page_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    changed = table(spark, d, "documents").where("lang = 'de'").select(F.col("doc_id").alias("page_id"))
    return table(spark, d, "pages").select("page_id", "url").join(changed, "page_id", "left_semi")


@query(
    "rates_with_nulls",
    """SELECT lang, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS r
    FROM (SELECT lang || source AS lang, count(*) FILTER (doc_id % 5 = 0) AS tp, count(*) FILTER (doc_id % 7 = 1) AS fp, count(*) FILTER (doc_id % 11 = 1) AS fn FROM documents GROUP BY ALL)""",
)
def rates_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    n = lambda m, r: F.count_if(F.col("doc_id") % m == r)
    x = table(spark, d, "documents").groupBy(F.concat("lang", "source").alias("lang")).agg(n(5, 0).alias("tp"), n(7, 1).alias("fp"), n(11, 1).alias("fn"))
    return x.select("*", X.ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("p"), X.ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("r"))
