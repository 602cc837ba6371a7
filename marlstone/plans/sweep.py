"""Queries over the candidates' way: arguments, windows, seeds, requests, evidence and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import code as C
from marlstone.operators import sweep as W
from marlstone.operators.catalog import code_lines
from marlstone.plans import query
from marlstone.plans.code import _SHOPS, _known, applications
from marlstone.plans.text import SQL_LINES
from marlstone.sources.tables import is_source, lines, read_windows, table
from marlstone.sources.work import settled


@query(
    "argument_errors",
    """SELECT p_partkey, array_to_string(list_sort(list_filter(CASE p_partkey % 4
      WHEN 0 THEN [CASE WHEN p_size % 2 = 1 THEN 'cwe: no id' END, CASE WHEN p_size - 5 NOT BETWEEN 1 AND 8 THEN 'k: out of bounds' END]
      WHEN 1 THEN [CASE WHEN p_size % 5 = 0 THEN 'path: missing' END, CASE WHEN p_size < 4 THEN 'start_line: out of bounds' END, CASE WHEN p_size % 3 = 0 THEN 'why: not known' END, CASE WHEN p_size % 7 = 0 THEN 'end_line: no number' END]
      WHEN 2 THEN [CASE WHEN length(p_brand) * p_size > 200 THEN 'pattern: out of bounds' END, CASE WHEN p_size % 2 = 1 THEN 'regex: no flag' END]
      ELSE ['tool: unknown format_disk'] END, lambda e: e IS NOT NULL)), '; ') AS errors FROM part""",
)
def argument_errors(spark: SparkSession, d: str) -> DataFrame:
    """Calls of tools made of parts, whose sizes decide which bounds they break."""
    size, key = F.col("p_size"), F.col("p_partkey") % 4
    retrieve = F.struct(F.col("p_name").alias("query"), F.when(size % 2 == 0, F.concat(F.lit("CWE-"), size)).otherwise(F.col("p_brand")).alias("cwe"), (size - 5).alias("k"))
    end = F.when(size % 7 == 0, "last")
    read = F.struct(F.when(size % 5 > 0, F.col("p_name")).alias("path"), (size - 3).alias("start_line"), F.when(size % 3 == 0, "so").alias("why"), end.alias("end_line"))
    search = F.struct(F.expr("repeat(p_brand, p_size)").alias("pattern"), F.when(size % 2 == 1, "maybe").otherwise("true").alias("regex"))
    arguments = F.when(key == 0, F.to_json(retrieve)).when(key == 1, F.to_json(read)).when(key == 2, F.to_json(search)).otherwise("[]")
    tool = F.element_at(F.array(*map(F.lit, ("retrieve_knowledge", "read_file", "search_code", "format_disk"))), (key + 1).cast("int"))
    calls = table(spark, d, "part").select("p_partkey", tool.alias("tool"), arguments.alias("arguments"))
    return W.argument_errors(calls).select("p_partkey", F.array_join("errors", "; ").alias("errors"))


_WINDOWS = f"""{SQL_LINES}, w AS (SELECT source AS app, 'd' || doc_id AS path, n AS line_start, least(n + 9, max(n) OVER (PARTITION BY doc_id)) AS line_end, lang = 'en' AS first FROM lines JOIN documents USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY app ORDER BY NOT first, path, line_start) AS ord FROM w WHERE line_start % 10 = 1)"""


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """Windows of ten lines of all documents; a source is an application, texts in English come first."""
    docs = table(spark, d, "documents")
    total = F.size(F.split(F.regexp_replace("text", r"\n$", ""), "\n", -1))
    x = docs.where("text <> ''").select(F.col("source").alias("app"), F.concat(F.lit("d"), "doc_id").alias("path"), total.alias("total"))
    x = x.withColumn("line_start", F.explode(F.sequence(F.lit(1), "total", F.lit(10)))).select("app", "path", "line_start", F.least(F.col("line_start") + 9, "total").alias("line_end"))
    first = docs.where("lang = 'en'").select(F.col("source").alias("app"), F.concat(F.lit("d"), "doc_id").alias("path"))
    return W.budgeted_windows(x, first)


@query("window_budget", f"WITH {_WINDOWS} SELECT app, path, line_start::INT AS line_start, line_end::INT AS line_end, ord::INT AS ord, ord > 80 AS skipped FROM o")
def window_budget(spark: SparkSession, d: str) -> DataFrame:
    return _ordered(spark, d)


@query(
    "window_coverage",
    f"WITH {_WINDOWS} SELECT app, count(*) AS windows, count(*) FILTER (ord > 80) AS skipped, count(DISTINCT path) FILTER (ord > 80)::INT AS skipped_files, count(DISTINCT path) FILTER (ord <= 80)::INT AS reviewed_files, min(path) FILTER (ord > 80) AS first_skipped, CASE WHEN count(*) > 80 THEN 'partial' ELSE 'complete' END AS status FROM o GROUP BY app",
)
def window_coverage(spark: SparkSession, d: str) -> DataFrame:
    x = W.coverage(_ordered(spark, d))
    return x.select("app", "windows", "skipped", F.size("skipped_files").alias("skipped_files"), F.size("reviewed_files").alias("reviewed_files"), F.get("skipped_files", F.lit(0)).alias("first_skipped"), W.run_status(F.col("skipped"), F.lit(0)).alias("status"))


@query("hidden_notes", "SELECT source AS app, 'd' || doc_id AS path, 'd' || doc_id || ': hidden Unicode characters in the source (possible Trojan Source / hidden instructions)' AS note FROM documents WHERE doc_id % 9 = 4 AND text <> '' OR regexp_matches(text, '[\\x{E0000}-\\x{E007F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{FEFF}]')")
def hidden_notes(spark: SparkSession, d: str) -> DataFrame:
    """Every ninth text has marks around its spaces and at its end."""
    t = F.when(F.col("doc_id") % 9 == 4, F.concat(F.replace("text", F.lit(" "), F.lit("\u200b \u202e")), F.lit("\u2060"))).otherwise(F.col("text"))
    x = lines(table(spark, d, "documents").where("text <> ''").select(F.col("source").alias("app"), F.concat(F.lit("d"), "doc_id").alias("path"), t.alias("text")))
    return W.hidden_notes(x.select("app", "path", F.col("line").alias("text")))


@query(
    "window_candidates",
    """SELECT l_orderkey AS event_id, l_linenumber AS line_number, CASE WHEN o_orderkey IS NULL OR l_quantity NOT BETWEEN o_custkey % 20 AND o_custkey % 20 + 20 THEN 'out_of_window' WHEN l_linenumber % 3 = 2 THEN 'other_family' ELSE 'kept' END AS fate
    FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey""",
)
def window_candidates(spark: SparkSession, d: str) -> DataFrame:
    family = F.element_at(F.array(*map(F.lit, ("sql_injection", "path_traversal", "markup"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("line_number"), family.alias("family"), F.col("l_quantity").cast("int").alias("line"))
    lo = F.col("o_custkey") % 20
    shown = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("event_id"), lo.alias("lo"), (lo + 20).alias("hi"))
    return W.in_window(found, shown, ["sql_injection", "path_traversal"]).select("event_id", "line_number", "fate")


@query(
    "symbol_requests",
    """WITH s AS (SELECT 'p' || p_size AS name, 'f' || (p_partkey % 7) AS path, min(p_partkey) AS line_start FROM part GROUP BY ALL),
    r AS (SELECT DISTINCT l_orderkey AS candidate, l_linenumber AS turn, 'f' || (l_orderkey % 9) AS path, 'p' || (l_partkey % 55) AS name FROM lineitem),
    x AS (SELECT *, row_number() OVER (PARTITION BY candidate, name ORDER BY turn) > 1 OR name NOT IN (SELECT name FROM s) AS stops FROM r),
    y AS (SELECT *, bool_or(stops) OVER (PARTITION BY candidate ORDER BY turn, name) AS ended, row_number() OVER (PARTITION BY candidate ORDER BY turn, name) AS k FROM x)
    SELECT candidate, turn, name, coalesce(s.path, f.path) AS file, coalesce(s.line_start, f.line_start) AS line_start, coalesce(s.line_start, f.line_start) + 80 AS line_end
    FROM y LEFT JOIN s USING (name, path) JOIN (SELECT name, min(path) AS path, arg_min(line_start, path) AS line_start FROM s GROUP BY name) f USING (name) WHERE k <= 2 AND NOT ended""",
)
def symbol_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests made of lines of orders for functions made of parts."""
    line = F.col("p_partkey")
    symbols = table(spark, d, "part").select(F.lit("a").alias("app"), F.concat(F.lit("p"), "p_size").alias("name"), F.concat(F.lit("f"), line % 7).alias("path"), line.alias("line_start"), (line + 100).alias("line_end"))
    need = F.concat(F.lit(" m.p"), F.col("l_partkey") % 55, F.lit("(x)"))
    asked = table(spark, d, "lineitem").select(F.lit("a").alias("app"), F.col("l_orderkey").alias("candidate"), F.col("l_linenumber").alias("turn"), F.concat(F.lit("f"), F.col("l_orderkey") % 9).alias("path"), need.alias("need"))
    return W.answered_requests(asked, symbols).drop("app")


@query(
    "observed_text",
    rf"""WITH {SQL_LINES} SELECT doc_id AS evidence_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE coalesce((SELECT string_agg(line, chr(10) ORDER BY n) FROM lines l WHERE l.doc_id = documents.doc_id AND n BETWEEN 2 AND doc_id % 4 + 2 AND (documents.doc_id % 3 = 0 OR documents.doc_id % 2 = 0)), '') END AS observed FROM documents""",
)
def observed_text(spark: SparkSession, d: str) -> DataFrame:
    """A few lines of each document as evidence, of a read, a search (every other one cites another file) or a scan."""
    docs, k = table(spark, d, "documents").select("doc_id", "text"), F.col("doc_id")
    tool = F.element_at(F.array(*map(F.lit, ("read_file", "search_code", "scan"))), (k % 3 + 1).cast("int"))
    events = docs.select(k.alias("event_id"), tool.alias("tool"))
    shown = lines(docs).select(k.alias("event_id"), F.lit("f0").alias("path"), "n", F.col("line").alias("text"))
    cited = docs.select(k.alias("evidence_id"), k.alias("event_id"), F.concat(F.lit("f"), k % 2).alias("file"), F.lit(2).alias("line_start"), (k % 4 + 2).alias("line_end"))
    return W.observed_text(cited, events, shown).select("evidence_id", "observed")


@query(
    "top_helpers",
    "SELECT handler, string_agg(name, ',' ORDER BY k) AS helpers FROM (SELECT l_orderkey AS handler, 'h' || l_partkey AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity::INT % 4 DESC, 'h' || l_partkey) AS k FROM lineitem) WHERE k <= 3 GROUP BY handler",
)
def top_helpers(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("handler"), F.concat(F.lit("h"), "l_partkey").alias("name"), (F.col("l_quantity").cast("int") % 4).alias("rank"))
    return W.top_helpers(x).withColumn("helpers", F.array_join("helpers", ","))


@query(
    "authz_seeds",
    f"""{_SHOPS} SELECT app, 'shop/views.py' AS path, line::INT AS line, line_start::INT AS line_start, line_end::INT AS line_end, CASE WHEN broken THEN 'Broken object-level authorization in ' ELSE 'Missing authentication on ' END || function AS title, 'authorization_idor' AS family
    FROM shop CROSS JOIN (VALUES ('show_basket', 4, 1, 5, true), ('drop_basket', 10, 7, 13, true), ('change_item', 17, 15, 19, true), ('change_item', 15, 15, 19, false), ('clear_shelf', 26, 26, 28, false)) r(function, line, line_start, line_end, broken)
    WHERE CASE WHEN function = 'clear_shelf' THEN true WHEN broken THEN owned AND NOT (function = 'drop_basket' AND checked) ELSE NOT owned END""",
)
def authz_seeds(spark: SparkSession, d: str) -> DataFrame:
    known = _known(spark, d)
    owned = settled(C.owned_models(known))
    handlers = C.routes(known, owned)
    used = C.accesses(handlers, owned)
    return W.seeds(C.idor_candidates(known, handlers, used), C.missing_auth(known, handlers, used=used), applications(spark, d), handlers)


@query(
    "project_idioms",
    f"""{_SHOPS} SELECT app, 10::BIGINT AS handlers, CASE WHEN owned THEN 4 ELSE 0 END::BIGINT AS with_id, 1 + checked::BIGINT AS scoped, 'must_own' AS helpers, CASE WHEN checked THEN 'drop_basket (shop/views.py:7), ' ELSE '' END || 'pay (shop/views.py:30)' AS examples FROM shop""",
)
def project_idioms(spark: SparkSession, d: str) -> DataFrame:
    known = _known(spark, d)
    owned = settled(C.owned_models(known))
    handlers = C.routes(known, owned)
    x = W.idioms(handlers, C.accesses(handlers, owned), C.helper_strength(known, columns=C.owner_columns_of(known, owned)))
    return x.withColumn("helpers", F.array_join("helpers", ", ")).withColumn("examples", F.array_join("examples", ", "))


@query(
    "assembled_findings",
    rf"""WITH {SQL_LINES}, c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
    SELECT source AS app, printf('F%03d', k) AS finding_id, printf('H%03d', k) AS hypothesis_id, 'T' || c.doc_id AS title, ['CWE-89', 'CWE-22', NULL][c.doc_id % 3 + 1] AS cwe_id, 'candidate' AS analysis_status, substr(text, 1, 500) AS source_to_sink, 'd' || c.doc_id AS file, 2 AS line_start, coalesce(line, '') AS excerpt
    FROM c LEFT JOIN lines l ON l.doc_id = c.doc_id AND l.n = 2""",
)
def assembled_findings(spark: SparkSession, d: str) -> DataFrame:
    """A candidate on the second line of each document."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    family = F.element_at(F.array(*map(F.lit, ("sql_injection", "path_traversal", "markup"))), (k % 3 + 1).cast("int"))
    kept = docs.select(F.col("source").alias("app"), k.alias("candidate"), k.alias("event_id"), family.alias("family"), F.concat(F.lit("d"), k).alias("path"), F.lit(2).alias("line"), F.concat(F.lit("T"), k).alias("title"), F.col("text").alias("reason"))
    shown = lines(docs.select("doc_id", "text")).select(k.alias("event_id"), "n", F.col("line").alias("text"))
    x = W.assembled(kept, shown, {"sql_injection": "CWE-89", "path_traversal": "CWE-22"})
    return x.select("*", "evidence.file", "evidence.line_start", "evidence.excerpt").drop("evidence")


@query(
    "read_ranges",
    r"""WITH x AS (SELECT doc_id, doc_id % 5 AS a, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 * 90 - 88 END AS b, sha256(text) AS h, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(text, '\n$', ''), chr(10)) END AS ls FROM documents),
    y AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'no_file' WHEN b < a + 1 THEN 'bad_range' WHEN a + 1 > len(ls) THEN 'beyond_end' ELSE 'ok' END AS status, least(coalesce(b, a + 120), a + 120, len(ls)) AS e FROM x)
    SELECT doc_id AS request_id, status, CASE WHEN status <> 'no_file' THEN len(ls)::INT END AS total_lines, CASE WHEN status <> 'no_file' THEN h END AS sha256, CASE WHEN status = 'ok' THEN e END AS line_end,
    CASE WHEN status = 'ok' THEN len(list_filter(ls[a + 1:e], lambda s: length(s) > 400))::INT END AS long_lines,
    CASE WHEN status = 'ok' THEN array_to_string(list_transform(ls[a + 1:e], lambda s: CASE WHEN length(s) > 400 THEN substr(s, 1, 400) || ' …[line truncated]' ELSE s END), chr(10)) END AS shown FROM y""",
)
def read_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A window of each document, to a line or without an end; every seventh is not there."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    asked = docs.select(k.alias("request_id"), k.alias("path"), (k % 5 + 1).cast("int").alias("start"), F.when(k % 3 > 0, k % 3 * 90 - 88).cast("int").alias("end"))
    return read_windows(asked, docs.where("doc_id % 7 > 0").select(k.alias("path"), "text")).drop("path")


@query(
    "source_paths",
    "SELECT page_id, page_id % 6 IN (0, 5) AS own FROM pages",
)
def source_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = F.array(*map(F.lit, ("app/views.py", "app/tests/views.py", "vendor/x/a.py", "app/test_views.py", "app/views.txt", "testing/a_test.py")))
    return table(spark, d, "pages").select("page_id", is_source(F.element_at(paths, (F.col("page_id") % 6 + 1).cast("int"))).alias("own"))


@query(
    "controls_seen",
    "SELECT p_partkey AS candidate, p_size BETWEEN 1 AND 6 AND (p_partkey % 4 = 0 OR p_size IN (2, 4)) AS control_ok FROM part",
)
def controls_seen(spark: SparkSession, d: str) -> DataFrame:
    """A control of each part, at the line of its size; every fourth file's tokens cannot be told."""
    p, path = table(spark, d, "part"), F.concat(F.lit("f"), "p_partkey")
    source = F.when(F.col("p_partkey") % 4 == 0, F.lit("x = (\n# a\n\n\n\n")).otherwise(F.concat(F.lit("# "), "p_name", F.lit("\nif a:\n    # b\n    c()\n\n'd'\n")))
    verdicts = p.select(F.col("p_partkey").alias("candidate"), path.alias("path"), F.when(F.col("p_partkey") % 2 == 0, path).alias("control_file"), F.col("p_size").alias("control_line"))
    shown = p.select(F.col("p_partkey").alias("candidate"), path.alias("path"), F.explode(F.array(F.struct(F.lit(1).alias("lo"), F.lit(4).alias("hi")), F.struct(F.lit(3).alias("lo"), F.lit(6).alias("hi")))).alias("w")).select("candidate", "path", "w.lo", "w.hi")
    return W.controls_seen(verdicts, shown, p.select(path.alias("path"), code_lines(source).alias("code_lines"))).select("candidate", "control_ok")
