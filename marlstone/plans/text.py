"""Queries over lines and texts: scans, windows, predicates and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import stored_index
from marlstone.operators.ordered import digests
from marlstone.operators.search import bm25, search_lines
from marlstone.plans import query
from marlstone.sources.tables import list_files, table
from marlstone.sources.work import shared_folder

#: documents to (doc_id, n, line) in the other dialect.
SQL_LINES = r"""
lines AS (
  SELECT doc_id, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM documents WHERE text <> '')
)"""


@query("search_lines_literal", rf"WITH {SQL_LINES} SELECT doc_id, n, substr(line, 1, 2000) AS line FROM lines WHERE contains(line, 'token = ') ORDER BY doc_id, n LIMIT 100")
def search_lines_literal(spark: SparkSession, d: str) -> DataFrame:
    return search_lines(table(spark, d, "documents"), "doc_id", "token = ", False, 100)


@query("search_lines_regex", rf"WITH {SQL_LINES} SELECT doc_id, n, substr(line, 1, 2000) AS line FROM lines WHERE regexp_matches(line, '[0-9]{{12,}}|License') ORDER BY doc_id, n LIMIT 200")
def search_lines_regex(spark: SparkSession, d: str) -> DataFrame:
    return search_lines(table(spark, d, "documents"), "doc_id", "[0-9]{12,}|License", True, 200)


@query(
    "read_window",
    r"""SELECT doc_id, len(ls) AS total_lines, sha256(text) AS sha256, CASE WHEN len(ls) < 3 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN len(ls) >= 3 THEN array_to_string(list_transform(list_slice(ls, 3, 5), lambda x: substr(x, 1, 400)), chr(10)) END AS shown
    FROM (SELECT doc_id, text, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM documents)""",
)
def read_window(spark: SparkSession, d: str) -> DataFrame:
    """Lines 3 to 5 of each document, 400 characters of each at most; a start beyond the end is an error."""
    ls = F.split(F.regexp_replace("text", r"\n$", ""), "\n", -1)
    docs = table(spark, d, "documents").select("doc_id", "text", ls.alias("ls"))
    shown = F.array_join(F.transform(F.slice("ls", 3, 3), lambda x: F.substring(x, 1, 400)), "\n")
    return docs.select(
        "doc_id", F.size("ls").cast("long").alias("total_lines"), X.sha256("text").alias("sha256"), F.when(F.size("ls") < 3, "error").otherwise("ok").alias("status"), F.when(F.size("ls") >= 3, shown).alias("shown")
    )


@query("numbered_lines", rf"WITH {SQL_LINES} SELECT doc_id, n, printf('%5d| %s', n, line) AS shown FROM lines")
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    from marlstone.sources.tables import lines

    return lines(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.col("n").cast("long").alias("n"), X.numbered(F.col("n"), F.col("line")).alias("shown"))


@query(
    "list_files_skip",
    """WITH kept AS (SELECT url FROM pages WHERE NOT list_has_any(string_split(url, '/'), ['vendor', 'dist', 'tag']) ORDER BY url LIMIT 51)
    SELECT url, (SELECT count(*) FROM kept) > 50 AS truncated FROM kept ORDER BY url LIMIT 50""",
)
def list_files_skip(spark: SparkSession, d: str) -> DataFrame:
    return list_files(table(spark, d, "pages").select("url"), "url", 50, ("vendor", "dist", "tag"))


@query(
    "relevance_filter",
    """SELECT doc_id, length(text) AS n FROM documents WHERE length(trim(text)) >= 80
    AND (contains(lower(text), 'license') OR contains(lower(text), 'token') OR contains(lower(text), 'reserved'))""",
)
def relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    """Texts of 80 characters or more that hold a listed term in any case."""
    hit = F.exists(F.array(*map(F.lit, ("license", "token", "reserved"))), lambda t: F.contains(F.lower("text"), t))
    return table(spark, d, "documents").where((F.length(F.trim("text")) >= 80) & hit).select("doc_id", F.length("text").cast("long").alias("n"))


@query("whitespace_norm", r"SELECT page_id, trim(regexp_replace(html, '[ \t\n\r\f\v]+', ' ', 'g')) AS tidy FROM pages")
def whitespace_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.tidy("html").alias("tidy"))


@query("query_tokens", "SELECT item_id, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: length(t) > 3)[1:1], ' ') AS first_long, len(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: length(t) > 1))) AS n FROM benchmark")
def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = X.query_tokens("text")
    return table(spark, d, "benchmark").select("item_id", F.coalesce(F.get(F.filter(t, lambda x: F.length(x) > 3), F.lit(0)), F.lit("")).alias("first_long"), F.size(t).cast("long").alias("n"))


@query("hash_split", "SELECT source, ('0x' || substr(sha256(lower(source)), 1, 1))::INT % 2 = 0 AS dev, count(*) AS n FROM documents GROUP BY ALL")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("dev", X.dev_half(F.col("source")))


@query("hash_order", "SELECT doc_id, sha256(doc_id::VARCHAR) AS h FROM documents ORDER BY h LIMIT 100")
def hash_order(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred in a pseudo-random order that stays."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h")).orderBy("h").limit(100)


@query("markdown_neutralize", "SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '`', ''''), '![', '!\\['), '](', '\\]('), '|', '\\|') AS safe FROM pages".replace("\\\\", "\\"))
def markdown_neutralize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.neutral("html").alias("safe"))


@query(
    "hidden_unicode",
    r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '[\x{E0000}-\x{E007F}]+|[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]|[^\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{E0000}-\x{E007F}]+'),
  lambda p: CASE WHEN regexp_matches(p, '^[\x{E0000}-\x{E007F}]') THEN '[' || length(p) || ' hidden unicode tag characters removed]' WHEN regexp_matches(p, '^[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]') THEN printf('[U+%04X]', unicode(p)) ELSE p END), '') AS shown
FROM (SELECT doc_id, substr(text, 1, 20) || chr(8203) || substr(text, 21) || chr(8238) || chr(917569) || chr(917570) AS t FROM documents)""",
)
def hidden_unicode(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.substring("text", 1, 20), F.lit("\u200b"), F.expr("substring(text, 21)"), F.lit("\u202e\U000e0041\U000e0042"))
    return table(spark, d, "documents").select("doc_id", X.reveal(t).alias("shown"))


@query("canary_leak", "SELECT source, count(*) FILTER (contains(text, 'token = \"')) AS leaks, count(*) AS n FROM documents GROUP BY source")
def canary_leak(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(F.contains("text", F.lit('token = "'))).alias("leaks"), F.count(F.lit(1)).alias("n"))


@query("manifest_hash", "SELECT source, sha256(string_agg(doc_id::VARCHAR || ':' || sha256(text) || chr(10), '' ORDER BY doc_id)) AS combined FROM documents GROUP BY source")
def manifest_hash(spark: SparkSession, d: str) -> DataFrame:
    """One digest a source over the sorted `id:digest` lines."""
    line = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256), F.lit("\n"))
    rows = table(spark, d, "documents").select("source", "doc_id", line.alias("line"))  # texts become digests before the shuffle
    return digests(rows, ["source"], ["doc_id"], "line").withColumnRenamed("sha256", "combined")


@query("cwe_normalize", "SELECT p_partkey, CASE p_size % 3 WHEN 2 THEN 'other' ELSE 'CWE-' || p_size END AS cwe, CASE p_size % 3 WHEN 2 THEN NULL ELSE p_size END AS number FROM part")
def cwe_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" cwe_"), "p_size")).when(F.col("p_size") % 3 == 1, F.col("p_size").cast("string")).otherwise("other")
    cwe = X.cwe_id(raw)
    return table(spark, d, "part").select("p_partkey", cwe.alias("cwe"), F.when(cwe.startswith("CWE-"), X.cwe_number(cwe)).alias("number"))


@query("line_of_offset", "SELECT doc_id, length(substr(text, 1, n_chars::INT // 2)) - length(replace(substr(text, 1, n_chars::INT // 2), chr(10), '')) + 1 AS line FROM documents")
def line_of_offset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.line_of(F.col("text"), F.expr("cast(n_chars div 2 + 1 as int)")).cast("long").alias("line"))


@query(
    "excerpt_seen",
    r"""SELECT doc_id, list_bool_and(list_transform(list_filter(list_transform(string_split_regex(substr(text, length(text) // 4 + 1, length(text) // 2) || '...' || substr(text, length(text) * 3 // 4 + 1, 20), '\n|\.\.\.'),
    lambda p: trim(regexp_replace(p, '[ \t\n\r\f\v]+', ' ', 'g'))), lambda p: p <> ''), lambda p: contains(trim(regexp_replace(substr(text, 1, length(text) * 4 // 5), '[ \t\n\r\f\v]+', ' ', 'g')), p))) AS seen
    FROM documents""",
)
def excerpt_seen(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of an excerpt stand in what was read of a document."""
    e = F.expr("concat(substring(text, length(text) div 4 + 1, length(text) div 2), '...', substring(text, length(text) * 3 div 4 + 1, 20))")
    return table(spark, d, "documents").select("doc_id", X.excerpt_seen(e, F.expr("substring(text, 1, length(text) * 4 div 5)")).alias("seen"))


@query("hunk_ranges", "SELECT l_orderkey, l_linenumber, l_linenumber AS old_start, l_linenumber + l_quantity::INT - 1 AS old_end, l_linenumber + 3 AS new_start, l_linenumber + 3 AS new_end FROM lineitem")
def hunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    n, q = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
    head = F.concat(F.lit("@@ -"), n, F.lit(","), q, F.lit(" +"), (F.col("l_linenumber") + 3).cast("string"), F.lit(" @@ def f"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.inline(X.hunks(head)))


@query("fence_length", "SELECT doc_id, greatest(3, 1 + doc_id % 5) AS fence FROM documents")
def fence_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.fence(F.concat(F.lit("a ` b "), F.repeat(F.lit("`"), (F.col("doc_id") % 5).cast("int")))).cast("long").alias("fence")).withColumn("fence", F.greatest(F.col("fence"), F.lit(3)))


@query("path_params", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'id,name' ELSE 'item' END AS params FROM pages")
def path_params(spark: SparkSession, d: str) -> DataFrame:
    route = F.when(F.col("page_id") % 2 == 0, F.lit("/a/<int:id>/<name>")).otherwise(F.lit("/b/{item:int}"))
    return table(spark, d, "pages").select("page_id", F.array_join(X.path_params(route), ",").alias("params"))


@query("in_scope", "SELECT page_id, page_id % 4 < 2 AS inside FROM pages")
def in_scope(spark: SparkSession, d: str) -> DataFrame:
    p = F.element_at(F.array(F.lit("a/../b.py"), F.lit("/srv/app/x/y.py"), F.lit("../application/b.py"), F.lit("/srv/app/../etc")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", X.in_scope(p, "/srv/app").alias("inside"))


_BM25 = r"""
WITH docs AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts, regexp_extract_all(lower(source), '[a-z0-9]+') AS ss FROM documents {where}),
sized AS (SELECT doc_id, len(ts) + len(ss) AS length, ts, ss FROM docs),
stats AS (SELECT count(*) AS big_n, avg(length) AS mean FROM sized),
wanted AS (SELECT DISTINCT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1))) AS term FROM benchmark),
occ AS (SELECT doc_id, length, unnest(ts) AS term, 1.0::DOUBLE AS w FROM sized UNION ALL SELECT doc_id, length, unnest(ss), 4.0::DOUBLE FROM sized),
tf AS (SELECT doc_id, length, term, sum(w) AS tf FROM occ WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
scored AS (
  SELECT query_id, doc_id, sum(CASE WHEN ln((big_n - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((big_n - n + 0.5) / (n + 0.5)) END
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
  FROM tf JOIN df USING (term) JOIN wanted USING (term) CROSS JOIN stats GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored {found}) WHERE rank <= 5
"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")), lambda t: F.length(t) > 1))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), terms.alias("terms"))


def _top(docs: DataFrame, queries: DataFrame) -> DataFrame:
    return bm25(docs, "doc_id", {"text": 1.0, "source": 4.0}, queries, 5).withColumn("score", F.round("score", 6)).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("bm25_topk", _BM25.format(where="", found=""))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top(table(spark, d, "documents"), _queries(spark, d))


@query("bm25_filtered", _BM25.format(where="WHERE lang = 'en'", found=""))
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _top(table(spark, d, "documents").where("lang = 'en'"), _queries(spark, d))


def _stored(spark: SparkSession, d: str, allowed: DataFrame | None = None) -> DataFrame:
    """The index is written in two appends, of which the second skips what is in already; the search reads no text of documents."""
    docs, path = table(spark, d, "documents"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    for part in (docs.where("lang = 'en'"), docs):
        stored_index.append(part, "doc_id", {"text": 1.0, "source": 4.0}, path)
    found = stored_index.search(spark, path, _queries(spark, d), 5, allowed)
    return found.select("query_id", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("bm25_stored", _BM25.format(where="", found=""))
def bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d)


@query("bm25_stored_within", _BM25.format(where="", found="WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def bm25_stored_within(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, table(spark, d, "labels").where("quality = 1").select("doc_id"))
