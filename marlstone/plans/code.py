"""Queries over source code, documents with sections, candidates and the learnt filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.stem import stems
from marlstone.operators import code as C
from marlstone.operators import documents as D
from marlstone.operators import learn as L
from marlstone.operators import review as R
from marlstone.operators.search import bm25_tokens
from marlstone.plans import query
from marlstone.plans.text import SQL_LINES
from marlstone.sources.tables import table
from marlstone.sources.work import settled

#: A small application in our own words; the tests hold the expected facts. `$owner` and `$check` differ from application to application.
APP = {
    "shop/models.py": (
        "class Basket(Base):\n    __tablename__ = 'baskets'\n    $owner: Mapped[int] = mapped_column(Integer)\n    total = Column(Integer)\n\n"
        "class Item(Base):\n    basket_id = Column(ForeignKey('baskets.id'))\n\nclass Shelf(Base):\n    label = Column(Text)\n"
    ),
    "shop/views.py": (
        "@app.get('/basket/<int:basket_id>')\n@login_required\ndef show_basket(basket_id):\n    b = Basket.get(basket_id)\n    return render(b)\n\n"
        "@app.delete('/basket/<int:basket_id>')\n@login_required\ndef drop_basket(basket_id):\n    b = Basket.get(basket_id)\n    if $check:\n        b.delete()\n    return 'ok'\n\n"
        "@app.post('/item/<item_id>')\ndef change_item(item_id):\n    i = Item.get(item_id)\n    i.n = 3\n    session.commit()\n\n"
        "@app.route('/shelf', methods=['GET', 'POST'])\n@login_required\ndef shelf():\n    return str(Shelf.all())\n\n"
        "@app.post('/shelf/clear')\ndef clear_shelf():\n    tidy('DELETE FROM shelf')\n\n"
        "@app.post('/basket/<int:basket_id>/pay')\n@login_required\ndef pay(basket_id):\n    b = Basket.get(basket_id)\n    must_own(b, current_user)\n    b.total = 0\n"
    ),
    "shop/files.py": (
        "def find(name):\n    return db.execute(f\"select * from t where n = '{name}'\")\n\n@app.get('/find')\n@login_required\ndef find_page():\n    return find(request.args['q'])\n\n"
        "@app.get('/get/<path:p>')\n@login_required\ndef get_file(p):\n    return open('/srv/' + p)\n\n"
        "@app.get('/safe/<path:p>')\n@login_required\ndef safe_file(p):\n    q = safe_join('/srv', p)\n    return open(q)\n\n"
        "def inside(root, p):\n    return os.path.commonpath([root, p]) == root\n\n"
        "@app.get('/held/<path:p>')\n@login_required\ndef held_file(p):\n    if inside('/srv', p):\n        return open('/srv/' + p)\n"
    ),
    "shop/guards.py": "def must_own(thing, user):\n    if thing.owner_id != user.id:\n        abort(403)\n",
    "shop/broken.py": "def broken(:\n    pass\n",
}


def application(spark: SparkSession) -> DataFrame:
    """One application, whose baskets have owners that dropping one looks at."""
    fill = lambda t: t.replace("$owner", "owner_id").replace("$check", "b.owner_id == current_user.id")
    return spark.createDataFrame([("shop", p, fill(t)) for p, t in APP.items()], "app string, path string, text string")


def applications(spark: SparkSession, d: str) -> DataFrame:
    """An application for each supplier; its nation decides on owners and checks."""
    s, files = table(spark, d, "supplier"), spark.createDataFrame(list(APP.items()), "path string, text string")
    x = s.select(F.concat(F.lit("app"), "s_suppkey").alias("app"), F.col("s_nationkey").alias("k")).join(F.broadcast(files))
    owner = F.when(F.col("k") % 2 == 0, "owner_id").otherwise("weight")
    check = F.when(F.col("k") % 3 == 0, "b.owner_id == current_user.id").otherwise("b.total == 0")
    text = F.replace(F.replace("text", F.lit("$owner"), owner), F.lit("$check"), check)
    return x.select("app", "path", text.alias("text"))


def _known(spark: SparkSession, d: str) -> DataFrame:
    """The facts, parsed once for all the joins of a query."""
    return settled(C.facts(applications(spark, d)))


#: The applications again, for SQL that states the facts of each by hand.
_SHOPS = "WITH shop AS (SELECT 'app' || s_suppkey AS app, s_nationkey % 2 = 0 AS owned, s_nationkey % 3 = 0 AS checked FROM supplier)"


@query(
    "route_inventory",
    f"""{_SHOPS} SELECT app, 'shop/' || path AS path, function, line_start::INT AS line_start, line_end::INT AS line_end, url, methods, auth, writes, kind = 1 OR (kind = 2 AND checked) AS owner_check, id_params
FROM shop CROSS JOIN (VALUES ('views.py', 'show_basket', 1, 5, '/basket/<int:basket_id>', 'GET', 'login', false, 0, 'basket_id'), ('views.py', 'drop_basket', 7, 13, '/basket/<int:basket_id>', 'DELETE', 'login', true, 2, 'basket_id'),
  ('views.py', 'change_item', 15, 19, '/item/<item_id>', 'POST', 'none', true, 0, 'item_id'), ('views.py', 'shelf', 21, 24, '/shelf', 'GET,POST', 'login', true, 0, ''), ('views.py', 'clear_shelf', 26, 28, '/shelf/clear', 'POST', 'none', true, 0, ''),
  ('views.py', 'pay', 30, 35, '/basket/<int:basket_id>/pay', 'POST', 'login', true, 1, 'basket_id'), ('files.py', 'find_page', 4, 7, '/find', 'GET', 'login', false, 0, ''), ('files.py', 'get_file', 9, 12, '/get/<path:p>', 'GET', 'login', false, 0, ''),
  ('files.py', 'safe_file', 14, 18, '/safe/<path:p>', 'GET', 'login', false, 0, ''), ('files.py', 'held_file', 23, 27, '/held/<path:p>', 'GET', 'login', false, 0, '')) r(path, function, line_start, line_end, url, methods, auth, writes, kind, id_params)""",
)
def route_inventory(spark: SparkSession, d: str) -> DataFrame:
    r = C.routes(_known(spark, d))
    return r.select("app", "path", "function", "line_start", "line_end", "url", F.array_join("methods", ",").alias("methods"), "auth", "writes", "owner_check", F.array_join("id_params", ",").alias("id_params"))


@query(
    "symbol_index",
    f"""{_SHOPS} SELECT app, name, 'shop/' || path AS path, line_start::INT AS line_start, line_end::INT AS line_end FROM shop CROSS JOIN (VALUES ('Basket', 'models.py', 1, 4), ('Item', 'models.py', 6, 7), ('Shelf', 'models.py', 9, 10),
  ('show_basket', 'views.py', 1, 5), ('drop_basket', 'views.py', 7, 13), ('change_item', 'views.py', 15, 19), ('shelf', 'views.py', 21, 24), ('clear_shelf', 'views.py', 26, 28), ('pay', 'views.py', 30, 35), ('find', 'files.py', 1, 2),
  ('find_page', 'files.py', 4, 7), ('get_file', 'files.py', 9, 12), ('safe_file', 'files.py', 14, 18), ('inside', 'files.py', 20, 21), ('held_file', 'files.py', 23, 27), ('must_own', 'guards.py', 1, 3)) r(name, path, line_start, line_end)""",
)
def symbol_index(spark: SparkSession, d: str) -> DataFrame:
    return C.symbols(_known(spark, d))


@query(
    "symbol_lookup",
    f"{_SHOPS} SELECT app, 'shop/' || path AS path, name, 'shop/' || defined_in AS defined_in FROM shop CROSS JOIN (VALUES ('views.py', 'must_own', 'guards.py'), ('files.py', 'inside', 'files.py'), ('files.py', 'find', 'files.py')) r(path, name, defined_in)",
)
def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    known = _known(spark, d)
    wanted = known.where("kind = 'call' and name in ('must_own', 'inside', 'find')").select("app", "path", "name").distinct()
    return C.look_up(wanted, known).select("app", "path", "name", "defined_in")


@query(
    "code_windows",
    f"{_SHOPS} SELECT app, 'shop/' || path AS path, 1::INT AS line_start, line_end::INT AS line_end FROM shop CROSS JOIN (VALUES ('models.py', 10), ('views.py', 35), ('files.py', 27), ('guards.py', 3), ('broken.py', 2)) r(path, line_end)",
)
def code_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.facts(applications(spark, d)).where("kind = 'window'").select("app", "path", "line_start", "line_end")


@query(
    "ownership_map",
    f"""{_SHOPS} SELECT app, model, tbl AS "table", owner_columns, via, depth::INT AS depth FROM shop CROSS JOIN (VALUES ('Basket', 'baskets', 'owner_id', 'owner', 0), ('Item', 'item', 'basket_id', 'reference', 1)) r(model, tbl, owner_columns, via, depth) WHERE owned""",
)
def ownership_map(spark: SparkSession, d: str) -> DataFrame:
    return C.owned_models(_known(spark, d)).withColumn("owner_columns", F.array_join("owner_columns", ","))


@query(
    "idor_candidates",
    f"""{_SHOPS} SELECT app, 'shop/views.py' AS path, function, line_start::INT AS line_start, model, auth, (model = 'Basket')::BIGINT + (model = 'Basket' AND checked)::BIGINT AS siblings, priority::INT AS priority
FROM shop CROSS JOIN (VALUES ('show_basket', 1, 'Basket', 'login', 1), ('drop_basket', 7, 'Basket', 'login', 0), ('change_item', 15, 'Item', 'none', 0)) r(function, line_start, model, auth, priority) WHERE owned AND NOT (function = 'drop_basket' AND checked)""",
)
def idor_candidates(spark: SparkSession, d: str) -> DataFrame:
    return C.idor_candidates(_known(spark, d))


@query(
    "missing_auth",
    f"""{_SHOPS} SELECT app, 'shop/views.py' AS path, function, line_start::INT AS line_start, 0.8::DOUBLE AS share_app, (2.0 / 3)::DOUBLE AS share_file
FROM shop CROSS JOIN (VALUES ('change_item', 15), ('clear_shelf', 26)) r(function, line_start) WHERE NOT (owned AND function = 'change_item')""",
)
def missing_auth(spark: SparkSession, d: str) -> DataFrame:
    return C.missing_auth(_known(spark, d))


@query(
    "sink_scan",
    f"""{_SHOPS} SELECT app, 'shop/files.py' AS path, line_start::INT AS line_start, function, sink, family, priority::INT AS priority, 'none' AS control, '' AS control_text, func_start::INT AS func_start
FROM shop CROSS JOIN (VALUES (2, 'find', 'execute', 'sql_injection', 1, 1), (12, 'get_file', 'open', 'path_traversal', 0, 11)) r(line_start, function, sink, family, priority, func_start)""",
)
def sink_scan(spark: SparkSession, d: str) -> DataFrame:
    return C.sinks(_known(spark, d))


@query(
    "guarded_sinks",
    f"""{_SHOPS} SELECT app, 'shop/files.py' AS path, line_start::INT AS line_start, 'path_traversal' AS family, function, control_text FROM shop CROSS JOIN (VALUES (27, 'held_file', 'inside()')) r(line_start, function, control_text)""",
)
def guarded_sinks(spark: SparkSession, d: str) -> DataFrame:
    return C.protected(_known(spark, d))


@query(
    "helper_strength",
    f"{_SHOPS} SELECT app, name, 3::INT AS rank FROM shop CROSS JOIN (VALUES ('must_own')) r(name)",
)
def helper_strength(spark: SparkSession, d: str) -> DataFrame:
    return C.helper_strength(_known(spark, d)).where("rank > 0")


@query(
    "candidate_features",
    f"""{_SHOPS} SELECT app, 'shop/files.py' AS path, line::INT AS line, cwe, 1::DOUBLE AS bias, (cwe = 'CWE-89')::INT::DOUBLE AS fam_sqli, (cwe = 'CWE-22')::INT::DOUBLE AS fam_path, 0::DOUBLE AS fam_idor, 0::DOUBLE AS authz_seed, 0::DOUBLE AS in_route,
  (cwe = 'CWE-89')::INT::DOUBLE AS sql_sink, 1::DOUBLE AS sql_format, 0::DOUBLE AS sql_param, (cwe = 'CWE-22')::INT::DOUBLE AS path_sink, 1::DOUBLE AS path_safe_near, 0::DOUBLE AS obj_lookup, 0::DOUBLE AS owner_near, 1::DOUBLE AS request_near,
  round(ln(3) / 3, 12) AS file_load FROM shop CROSS JOIN (VALUES (2, 'CWE-89'), (12, 'CWE-22')) r(line, cwe)""",
)
def candidate_features(spark: SparkSession, d: str) -> DataFrame:
    cwe = F.when(F.col("family") == "sql_injection", "CWE-89").otherwise("CWE-22")
    found = C.sinks(_known(spark, d), None).select("app", "path", F.col("line_start").alias("line"), cwe.alias("cwe"))
    return C.candidate_features(found, applications(spark, d)).withColumn("file_load", F.round("file_load", 12))


@query("html_sections")
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    return D.sections_html(table(spark, d, "pages"), "page_id", "html")


@query(
    "markdown_sections",
    rf"""WITH {SQL_LINES}, x AS (SELECT doc_id, n, CASE WHEN n % 4 = 1 THEN '# part ' || n ELSE line END AS line FROM lines),
    y AS (SELECT *, sum((n % 4 = 1)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM x)
    SELECT doc_id, section::BIGINT AS section, 'part ' || min(n) AS title, trim(string_agg(line, chr(10) ORDER BY n) FILTER (n % 4 <> 1), ' ' || chr(9) || chr(13) || chr(10)) AS body FROM y GROUP BY doc_id, section HAVING trim(string_agg(line, chr(10) ORDER BY n) FILTER (n % 4 <> 1), ' ' || chr(9) || chr(13) || chr(10)) <> ''""",
)
def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a heading in place of every fourth line."""
    ls = F.split(F.regexp_replace("text", r"\n$", ""), "\n", -1)
    marked = F.array_join(F.transform(ls, lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("# part "), (i + 1).cast("string"))).otherwise(x)), "\n")
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", marked.alias("text"))
    return D.sections_markdown(docs, "doc_id").select("doc_id", F.col("section").cast("long").alias("section"), "title", "body")


@query("bm25_porter")
def bm25_porter(spark: SparkSession, d: str) -> DataFrame:
    """Weighted BM25 over stemmed, accent-free terms; the stemmer runs in Arrow batches."""
    pieces = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"([\p{L}\p{N}]+)"))
    # each piece is a term, so lengths need no stems
    length = (F.size(pieces("text")) + F.size(pieces("source"))).alias("length")
    docs = table(spark, d, "documents").select("doc_id", stems(pieces("text")).alias("body"), stems(pieces("source")).alias("head"), length)
    tokens = docs.select("doc_id", "length", F.concat(F.transform("body", lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("w"))), F.transform("head", lambda t: F.struct(t.alias("term"), F.lit(4.0).alias("w")))).alias("ts"))
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(stems(pieces("text"))).alias("terms"))
    return bm25_tokens(tokens, "doc_id", queries, 5).withColumn("score", F.round("score", 6))


@query("logreg_loao")
def logreg_loao(spark: SparkSession, d: str) -> DataFrame:
    """Quality labels from four flags of a text, each language scored by weights from the others."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    flag = lambda c: c.cast("double")
    rows = docs.select("doc_id", "lang", F.col("quality").cast("double").alias("label"), flag(F.col("text").rlike("[%$#&*]{3}")).alias("marks"), flag(F.col("text").rlike("[A-Z]{6}")).alias("shouts"), flag(F.col("text").rlike(" [|] ")).alias("bars"), flag(F.length("text") > 1000).alias("long"))
    return L.leave_one_out(rows, "lang", "doc_id", ["marks", "shouts", "bars", "long"], "label")


@query(
    "candidate_routing",
    """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'accepted' WHEN event_id % 7 = 0 THEN 'rejected_protected' WHEN event_id % 11 = 0 THEN 'rejected_precedent'
    WHEN event_type = 'view' THEN CASE WHEN value < 10 THEN 'kept_low' ELSE 'kept' END WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'withdrawn' ELSE 'unconfirmed' END AS outcome FROM events""",
)
def candidate_routing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    verdict = F.when(F.col("event_type") == "view", "confirmed").when(F.col("event_type") == "click", "refuted")
    x = e.select("event_id", (F.col("event_id") % 13 == 0).alias("strong"), (F.col("event_id") % 7 == 0).alias("protected"), (F.col("event_id") % 11 == 0).alias("precedent"), verdict.alias("verdict"), (F.col("user_id") % 2 == 0).alias("control_ok"), (F.col("value") < 10).alias("low"))
    return R.route(x).select("event_id", "outcome")


@query(
    "protected_sinks",
    """WITH c AS (SELECT event_id, user_id % 50 AS file, event_type AS family, event_id % 500 AS line FROM events), p AS (SELECT * FROM c WHERE event_id % 9 = 0)
    SELECT event_id, EXISTS (SELECT 1 FROM p WHERE p.file = c.file AND p.family = c.family AND abs(p.line - c.line) <= 3) AS protected FROM c""",
)
def protected_sinks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").select(F.col("event_id").alias("candidate_id"), (F.col("user_id") % 50).alias("file"), F.col("event_type").alias("family"), (F.col("event_id") % 500).alias("line"))
    return R.near_protected(c, c.where("candidate_id % 9 = 0")).select(F.col("candidate_id").alias("event_id"), "protected")


@query(
    "settled_verdicts",
    """SELECT event_id, CASE WHEN event_type <> 'click' THEN 'confirmed' WHEN event_id % 40 BETWEEN 5 AND 25 THEN 'refuted' ELSE 'uncertain' END AS verdict FROM events""",
)
def settled_verdicts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = (F.col("event_id") % 40).cast("string")
    x = e.select("event_id", F.when(F.col("event_type") == "click", "refuted").otherwise("confirmed").alias("verdict"), F.array().cast("array<int>").alias("control_lines"), F.concat(F.lit("see line "), n, F.lit(" and lines "), n).alias("reason"), F.lit(5).alias("lo"), F.lit(25).alias("hi"))
    return R.settle(x).select("event_id", "verdict")


@query(
    "decision_errors",
    "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 5 = 0 THEN 'cwe' END, CASE WHEN p_size % 3 = 0 THEN 'lines' END, CASE WHEN p_size % 4 = 0 THEN 'severity' END], lambda e: e IS NOT NULL), ',') AS errors FROM part",
)
def decision_errors(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    s = F.col("p_size")
    x = p.select("p_partkey", F.when(s % 5 == 0, "x").otherwise(F.concat(F.lit("CWE-"), s)).alias("cwe"), s.alias("line_start"), F.when(s % 3 == 0, s - 1).otherwise(s + 1).alias("line_end"), F.when(s % 4 == 0, "grave").otherwise("high").alias("severity"), F.array(F.lit(1)).alias("evidence"))
    return R.decision_errors(x).select("p_partkey", F.array_join("errors", ",").alias("errors"))


@query("merged_passes", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey % 20, l_suppkey, l_orderkey % 5 ORDER BY l_linenumber, l_orderkey) > 1 AS duplicate FROM lineitem")
def merged_passes(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select((F.col("l_partkey") % 20).alias("cwe"), F.col("l_suppkey").alias("file"), (F.col("l_orderkey") % 5).alias("line"), F.col("l_linenumber").alias("pass"), F.col("l_orderkey").alias("ord"))
    return R.merge_passes(x).select(F.col("ord").alias("l_orderkey"), F.col("pass").alias("l_linenumber"), "duplicate")
