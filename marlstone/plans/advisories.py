"""Queries over advisories, sources and runs: what is selected, what counts, how runs compare."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import advisories as A
from marlstone.operators import catalog as K
from marlstone.operators import documents as D
from marlstone.plans import query
from marlstone.sources import tables as S
from marlstone.sources.tables import table
from marlstone.sources.work import dealt, shared_folder


@query(
    "advisory_selection",
    """SELECT 'A' || o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'sql_injection' ELSE 'authorization_idor' END AS family, CASE o_orderkey % 4 WHEN 0 THEN 'CWE-89' ELSE 'CWE-284,CWE-639' END AS cwes,
    strftime(o_orderdate, '%Y-%m-%d') AS published, 'Own' || (o_custkey % 50) AS owner, 'proj' AS repo, substr(sha256(o_orderkey::VARCHAR), 1, 40) AS sha, sha256('A' || o_orderkey) AS hash,
    ('0x' || substr(sha256('own' || (o_custkey % 50) || '/proj'), 1, 1))::INT % 2 = 0 AS dev
    FROM orders WHERE year(o_orderdate) = 1996 AND o_orderstatus <> 'P' AND o_orderkey % 2 = 0 AND o_orderkey % 3 <> 1""",
)
def advisory_selection(spark: SparkSession, d: str) -> DataFrame:
    """Orders as advisories: some withdrawn, of two families, of two commits or of one in two spellings."""
    k = F.col("o_orderkey")
    sha = F.sha2(k.cast("string"), 256)
    url = lambda x: F.concat(F.lit("https://github.com/Own"), F.col("o_custkey") % 50, F.lit("/proj.git/commit/"), x)
    ids = lambda *x: F.array(*map(F.lit, x))
    cwes = F.when(k % 4 == 0, ids("CWE-89", "CWE-79")).when(k % 4 == 1, ids("CWE-22", "CWE-89")).when(k % 4 == 2, ids("CWE-639", "CWE-284"))
    other = F.when(k % 3 == 0, url(F.substring(sha, 1, 10))).when(k % 3 == 1, url(F.substring(F.reverse(sha), 1, 40))).otherwise("https://example.org/notes")
    advisory = F.struct(
        F.concat(F.lit("A"), k).alias("id"), F.when(F.col("o_orderstatus") == "P", "yes").alias("withdrawn"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("published"),
        F.struct(cwes.alias("cwe_ids")).alias("database_specific"), F.array(F.struct(other.alias("url")), F.struct(url(F.substring(sha, 1, 40)).alias("url"))).alias("references"),
    )
    return A.selected(table(spark, d, "orders").select(F.to_json(advisory).alias("json")), "1996").withColumn("cwes", F.array_join("cwes", ","))


_CHANGED = """changed AS (SELECT l_orderkey AS id, ['src/m' || l_partkey || '.py', 'pkg/tests/x' || l_partkey || '.py', 'pkg/_version.py', 'notes/a.md', 'lib/conftest.py', 'a/b' || l_suppkey || '.py', 'c.py', 'tested/e.py'][l_partkey % 8 + 1] AS path FROM lineitem),
x AS (SELECT id, path, path LIKE 'src/%' OR path LIKE 'a/b%' OR path = 'c.py' OR path = 'tested/e.py' AS source FROM changed)"""


@query("counted_files", f"WITH {_CHANGED} SELECT id, path, source AND count(*) FILTER (source) OVER (PARTITION BY id) <= 3 AS counts FROM x")
def counted_files(spark: SparkSession, d: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    paths = F.array(F.concat(F.lit("src/m"), part, F.lit(".py")), F.concat(F.lit("pkg/tests/x"), part, F.lit(".py")), *map(F.lit, ("pkg/_version.py", "notes/a.md", "lib/conftest.py")), F.concat(F.lit("a/b"), supp, F.lit(".py")), *map(F.lit, ("c.py", "tested/e.py")))
    changed = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.element_at(paths, (part % 8 + 1).cast("int")).alias("path"))
    return A.counted_files(changed, 3)


@query(
    "imports_only",
    r"""SELECT doc_id, list_bool_and(list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*(import\s|from\s+\S+\s+import\s|$|\)|[\p{L}\p{M}\p{N}_, ]+,?\s*$)'))) AS imports_only FROM documents""",
)
def imports_only(spark: SparkSession, d: str) -> DataFrame:
    """Texts as the one side of a hunk; a line of bare words looks like a continued import."""
    return table(spark, d, "documents").select("doc_id", A.imports_only(F.split("text", "\n", -1), F.array(F.lit("from a import b"), F.lit("    c,"))).alias("imports_only"))


@query(
    "hint_files",
    r"""SELECT page_id, list_bool_or(list_transform(string_split(p, '/'), lambda x: regexp_matches(x, '(?i)(^readme|\.md$|\.rst$|^hints?|^solutions?|^walkthrough|^writeup|^docs?$)'))) AND NOT starts_with(upper(string_split(p, '/')[-1]), 'LICENSE') AS hint
    FROM (SELECT page_id, url || ['/README', '/docs/x.py', '/docs/License.md', '/Hint_1/a.py', '/my_solutions.py', '/a.rst.py', '/b.RST'][page_id % 7 + 1] AS p FROM pages)""",
)
def hint_files(spark: SparkSession, d: str) -> DataFrame:
    ends = F.array(*map(F.lit, ("/README", "/docs/x.py", "/docs/License.md", "/Hint_1/a.py", "/my_solutions.py", "/a.rst.py", "/b.RST")))
    return table(spark, d, "pages").select("page_id", A.gives_hint(F.concat("url", F.element_at(ends, (F.col("page_id") % 7 + 1).cast("int")))).alias("hint"))


@query("slug_titles", "SELECT p_partkey, 'A' || p_size || ':2025' AS code, p_name || ' of ' || p_brand || '-x' AS title FROM part")
def slug_titles(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("pages/A"), "p_size", F.lit("_2025-"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_of_"), "p_brand", F.lit("-x.html"))
    return table(spark, d, "part").select("p_partkey", F.inline(F.array(A.slug_title(path))))


_SIDES = "s AS (SELECT source AS app, lang, count(*) FILTER (doc_id % 3 = 0) AS tp, count(*) FILTER (doc_id % 3 = 1) AS fp, count(*) FILTER (doc_id % 3 = 2) AS fn FROM documents GROUP BY ALL)"


@query(
    "ablation_join",
    f"""WITH {_SIDES} SELECT a.app, a.tp AS tp, a.fp AS fp, b.tp AS filtered_tp, b.fp AS filtered_fp, c.tp AS verifier_tp, c.fn AS verifier_fn
    FROM s a JOIN s b ON a.app = b.app AND a.lang = 'en' AND b.lang = 'de' JOIN s c ON a.app = c.app AND c.lang = 'fr'""",
)
def ablation_join(spark: SparkSession, d: str) -> DataFrame:
    n = lambda r, name: F.count_if(F.col("doc_id") % 3 == r).alias(name)
    s = table(spark, d, "documents").groupBy(F.col("source").alias("app"), "lang").agg(n(0, "tp"), n(1, "fp"), n(2, "fn"))
    x = A.ablation(*(s.where(F.col("lang") == k) for k in ("en", "de", "fr")))
    return x.select("app", "unfiltered.tp", "unfiltered.fp", F.col("filtered.tp").alias("filtered_tp"), F.col("filtered.fp").alias("filtered_fp"), F.col("verifier.tp").alias("verifier_tp"), F.col("verifier.fn").alias("verifier_fn"))


@query(
    "model_speeds",
    """SELECT l_orderkey, l_linenumber, l_partkey % 300 < 0.9 * 5 * l_quantity AS truncated, CASE WHEN l_suppkey > 0 THEN round((l_partkey % 300) / (l_suppkey * 1000000 / 1e9), 1) END AS prompt_rate,
    CASE WHEN l_orderkey % 64 > 0 THEN round(l_linenumber / ((l_orderkey % 64) * 1000000 / 1e9), 1) END AS rate FROM lineitem""",
)
def model_speeds(spark: SparkSession, d: str) -> DataFrame:
    ms = lambda c: c * 1000000
    runs = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (5 * F.col("l_quantity")).alias("expected"), (F.col("l_partkey") % 300).alias("prompt_tokens"), ms(F.col("l_suppkey")).alias("prompt_ns"), F.col("l_linenumber").alias("tokens"), ms(F.col("l_orderkey") % 64).alias("ns")
    )
    return A.speeds(runs).select("l_orderkey", "l_linenumber", "truncated", "prompt_rate", "rate")


@query(
    "structured_validity",
    """SELECT event_type AS model, count(*) AS runs, count(*) FILTER (event_id % 7 <> 0) AS valid, coalesce(array_to_string(list_sort(list(printf('%09d validation: user %d', event_id, user_id)) FILTER (event_id % 7 = 0))[1:5], '; '), '') AS errors FROM events GROUP BY event_type""",
)
def structured_validity(spark: SparkSession, d: str) -> DataFrame:
    error = F.when(F.col("event_id") % 7 == 0, F.format_string("%09d validation: user %d", "event_id", "user_id"))
    runs = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("seed"), error.alias("error"))
    return A.structured_validity(runs).withColumn("errors", F.array_join("errors", "; "))


@query(
    "code_line_numbers",
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE '1,5,6,8' END AS code, CASE WHEN p_size % 5 = 0 THEN p_name || ' (' ELSE 'def f():  # [comment removed]' || chr(10) || '    \"\"\"[docstring removed]\"\"\"' || chr(10) || chr(10) || '    # [comment removed]' || chr(10) || '    x = \"\"\"# ' || p_brand || chr(10) || '    kept\"\"\" + y' || chr(10) || chr(10) || '    return x' END AS shown FROM part",
)
def code_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Source made of parts' names: comments and texts that stand alone are taken out, strings in use are not."""
    source = F.concat(F.lit("def f():  # "), "p_name", F.lit('\n    """'), "p_type", F.lit("\n    more\"\"\"\n    # "), "p_brand", F.lit('\n    x = """# '), "p_brand", F.lit('\n    kept""" + y\n\n    return x'))
    x = dealt(table(spark, d, "part"), "p_partkey").select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit(" ("))).otherwise(source).alias("text"))
    return x.select("p_partkey", F.array_join(K.code_lines("text"), ",").alias("code"), K.without_talk("text").alias("shown"))


@query(
    "source_chunks",
    """WITH x AS (SELECT item_id, trim(text) AS text FROM benchmark), y AS (
      SELECT item_id, item_id || '#000.0' AS id, 'Guide ' || item_id AS title, text FROM x UNION ALL
      SELECT item_id, item_id || '#001.0', 'Guide ' || item_id || ' — More', text || ' On security.' FROM x)
    SELECT item_id, id, title, text, sha256(text) AS sha256 FROM y WHERE length(text) >= 80 AND (contains(lower(title || ' ' || text), 'security') OR contains(lower(title || ' ' || text), '7') OR contains(lower(title || ' ' || text), 'er'))""",
)
def source_chunks(spark: SparkSession, d: str) -> DataFrame:
    """From a Markdown source to its chunks: sections, short ones out, packing, terms, ids."""
    text = F.concat(F.lit("# Guide "), "item_id", F.lit("\n"), "text", F.lit("\n\n## More\n\n"), "text", F.lit(" On security.\n\n### Links\nup\n"))
    x = D.sections_markdown(table(spark, d, "benchmark").select("item_id", text.alias("text")), "item_id")
    return K.source_chunks(x, "item_id", 1500, ["7", "er", "security"])


@query(
    "word_lists",
    """SELECT 'app' || s_suppkey AS app, k AS key, i::INT AS ord, w AS word FROM (SELECT s_suppkey, 'sources' AS k, unnest(range(50)) AS i, 'w' || unnest(range(50)) AS w FROM supplier WHERE s_nationkey % 3 <> 0
    UNION ALL SELECT s_suppkey, 'sanitizers', 0, s_name FROM supplier WHERE s_nationkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'sanitizers', 1, s_nationkey::VARCHAR FROM supplier WHERE s_nationkey % 3 <> 0)""",
)
def word_lists(spark: SparkSession, d: str) -> DataFrame:
    """Settings of each supplier's application; those of every third nation do not parse."""
    words = "".join(f"- w{i}\n" for i in range(60))
    good = F.concat(F.lit(f"sources:\n{words}sanitizers: ["), "s_name", F.lit(", "), "s_nationkey", F.lit("]\nother:\n- x\nsql_sinks: none\n"))
    x = table(spark, d, "supplier").select(F.concat(F.lit("app"), "s_suppkey").alias("app"), F.when(F.col("s_nationkey") % 3 == 0, "sources: [a").otherwise(good).alias("text"))
    return S.word_lists(x)


@query("written_chunks", "SELECT item_id, nullif(text, '') AS text, sha256(text) AS sha256, CASE WHEN item_id % 2 = 0 THEN 'cc0' END AS license FROM benchmark")
def written_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines and read back with their schema."""
    path = f"{shared_folder(spark)}/written-chunks-{uuid.uuid4().hex}"
    x = table(spark, d, "benchmark").select("item_id", "text", F.sha2("text", 256).alias("sha256"), F.when(F.col("item_id") % 2 == 0, "cc0").alias("license"))
    S.write_jsonl(x, path)
    return S.jsonl(spark, path, "item_id bigint, text string, sha256 string, license string")
