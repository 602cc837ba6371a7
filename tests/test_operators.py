"""Golden cases and randomised restatements for operators that SQL cannot state, and edge rows."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.functions.stem import stem
from marlstone.operators import code as C
from marlstone.operators import documents as D
from marlstone.operators import learn as L
from marlstone.operators import match as M
from marlstone.operators import ordered as O
from marlstone.operators import report as R
from marlstone.operators import review as V
from marlstone.operators.search import bm25
from marlstone.plans.code import application
from marlstone.sources import tables as S
from marlstone.streaming import trace


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_wilson(spark):
    a, b = X.wilson(F.col("k"), F.col("n"))
    got = rows(spark.createDataFrame([(5, 10), (0, 0)], "k long, n long").select("n", F.bround(a, 3).alias("a"), F.bround(b, 3).alias("b")))
    assert got == [(0, None, None), (10, 0.237, 0.763)]


def test_matching_rules(spark):
    f = [("a", 1, "x", "f", [(3, 3)]), ("a", 2, "x", "f", [(4, 4)]), ("a", 3, "x", "g", [(9, 9)]), ("a", 4, "y", "f", [(3, 3)]), ("a", 5, None, "f", [(3, 3)]), ("a", 6, "x", "f", [(12, 12)]), ("a", 7, "x", "f", [(13, 13)])]
    c = [("a", 1, "x", True, "f", 1, 10), ("a", 2, "x", False, "g", 8, 10), ("a", 3, "x", True, "h", 1, 2)]
    findings = spark.createDataFrame(f, "app string, finding_ord int, family string, file string, ranges array<struct<lo:int,hi:int>>")
    cases = spark.createDataFrame(c, "app string, case_ord int, family string, vulnerable boolean, file string, lo int, hi int")
    out = M.outcomes(findings, cases)
    assert [r.outcome for r in out.orderBy("finding_ord").collect()] == ["tp", "duplicate", "fp_safe", "fp_unmatched", "out_of_scope", "duplicate", "fp_unmatched"]
    assert rows(M.missed(out, cases)) == [("a", 3, "x")]


def test_matching_equals_a_loop(spark):
    rnd = random.Random(4)
    f, c = [], []
    for app in range(12):
        c += [(app, k, rnd.choice("xy"), rnd.random() < 0.5, "f", lo := rnd.randint(1, 60), lo + rnd.randint(0, 5)) for k in range(10)]
        f += [(app, k, rnd.choice("xyz"), "f", [(lo := rnd.randint(1, 60), lo + rnd.randint(0, 3))]) for k in range(14)]
    want = {}
    for app, k, fam, _, [(lo, hi)] in f:
        hit = next((x for x in c if x[0] == app and x[2] == fam and lo <= x[6] + 2 and hi >= x[5] - 2), None)
        used = {v[0] for (a, _), v in want.items() if a == app}
        kind = "fp_unmatched" if hit is None else "duplicate" if hit[1] in used else "tp" if hit[3] else "fp_safe"
        want[app, k] = (hit[1] if hit else None, kind)
    out = M.outcomes(spark.createDataFrame(f, "app int, finding_ord int, family string, file string, ranges array<struct<lo:int,hi:int>>"), spark.createDataFrame(c, "app int, case_ord int, family string, vulnerable boolean, file string, lo int, hi int"))
    assert {(r.app, r.finding_ord): (r.case_ord, r.outcome) for r in out.collect()} == want


def test_leaders(spark):
    x = spark.createDataFrame([("g", n) for n in (1, 4, 7, 7)] + [("h", 2)], "g string, n long")
    assert rows(O.leaders(x, ["g"], "n", 3, "n")) == [("g", 1), ("g", 7), ("h", 2)]
    y = spark.createDataFrame([("g", 12, 1), ("g", 11, 2), ("g", 20, 3), ("g", 17, 4)], "g string, n long, o long")
    assert rows(O.leaders(y, ["g"], "n", 3, "o")) == [("g", 12), ("g", 17), ("g", 20)][:1] + [("g", 20)]


def test_quota_equals_a_loop(spark):
    rnd = random.Random(2)
    data = [(i, rnd.choice("ab"), rnd.choice("uvwxyz"), f"{rnd.random():.9f}", i % 2) for i in range(300)]
    got = {r.id for r in O.quota(spark.createDataFrame(data, "id int, lang string, source string, h string, half int").withColumn("h", F.concat("h", F.lpad(F.col("id").cast("string"), 4, "0"))), "h", "lang", "source", 9, 2, "half").join(spark.createDataFrame(data, "id int, lang string, source string, h0 string, half int").select("id", F.concat("h0", F.lpad(F.col("id").cast("string"), 4, "0")).alias("h")), "h").collect()}
    want = set()
    for half in (0, 1):
        a, b = {}, {}
        for i, x, y, h, s in sorted((r for r in data if r[4] == half), key=lambda r: r[3] + f"{r[0]:04d}"):
            if a.get(x, 0) < 9 and b.get(y, 0) < 2:
                a[x], b[y] = a.get(x, 0) + 1, b.get(y, 0) + 1
                want.add(i)
    assert got == want


def test_packing_never_exceeds_and_keeps_words():
    rnd = random.Random(1)
    text = "\n\n".join(" ".join("w" * rnd.randint(1, 30) for _ in range(rnd.randint(1, 90))) + "." for _ in range(20)) + "x" * 700
    parts = O.split_text(text, 200)
    assert all(0 < len(p) <= 200 for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())


def test_lines_and_line_ends(spark):
    x = spark.createDataFrame([(1, "a\n\nb\n"), (2, ""), (3, None), (4, "a\r\nb\u2028c\x1cd")], "k int, text string")
    assert rows(S.lines(x).where("k < 4")) == [(1, 1, "a"), (1, 2, ""), (1, 3, "b")]
    assert x.where("k = 4").select(S.all_lines(F.col("text"))).head()[0] == ["a", "b", "c", "d"]


def test_scalar_functions(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c).head()[0]
    assert ask(X.hunks(F.lit("@@ -3,2 +5 @@ x\n@@ -9 +0,0 @@"))) == [(3, 4, 5, 5), (9, 9, 0, 0)]
    assert ask(X.reveal(F.lit("a\u200bb\U000e0041\U000e0042c\ufeff"))) == "a[U+200B]b[2 hidden unicode tag characters removed]c[U+FEFF]" and ask(X.reveal(F.lit("plain"))) == "plain"
    assert [ask(X.in_scope(F.lit(p), "/srv/app")) for p in ("x.py", "../app/x", "../apple", "/srv/app2/x", "a/../../x", "c:/x", "")] == [True, True, False, False, False, False, False]
    assert ask(X.excerpt_seen(F.lit("..."), F.lit("abc"))) is False
    assert ask(X.excerpt_seen(F.lit("a"), F.lit(None).cast("string"))) is None
    assert ask(X.f1(F.lit(0.0), F.lit(0.0))) == 0.0 and ask(X.f1(F.lit(None).cast("double"), F.lit(0.5))) is None
    assert ask(X.fence(F.lit("a ```` b"))) == 5
    assert ask(X.neutral(F.lit("![x](y) <b> `q` & |"))) == "!\\[x\\](y) &lt;b&gt; 'q' &amp; \\|"


def test_code_facts(spark):
    known = C.facts(application(spark)).cache()
    r = {x.function: x for x in C.routes(known).collect()}
    assert set(r) == {"show_basket", "drop_basket", "change_item", "shelf", "clear_shelf", "pay", "find_page", "get_file", "safe_file", "held_file"}
    assert r["shelf"].methods == ["GET", "POST"] and r["drop_basket"].methods == ["DELETE"] and r["drop_basket"].owner_check and r["pay"].owner_check and r["change_item"].auth == "none"
    assert [x[:3] for x in rows(C.owned_models(known).select("app", "model", "depth"))] == [("shop", "Basket", 0), ("shop", "Item", 1)]
    assert {(x.function, x.model, x.priority) for x in C.idor_candidates(known).collect()} == {("show_basket", "Basket", 1), ("change_item", "Item", 0)}
    assert {x.function for x in C.missing_auth(known).collect()} == {"clear_shelf"}
    assert {(x.function, x.family) for x in C.sinks(known).collect()} == {("find", "sql_injection"), ("get_file", "path_traversal")}
    assert {(x.function, x.control_text) for x in C.protected(known).collect()} == {("held_file", "inside()")}
    assert known.where("kind = 'unreadable'").count() == 1
    assert {(x.name, x.rank) for x in C.helper_strength(known).where("rank > 0").collect()} == {("must_own", 3)}


def test_models_of_an_application(spark):
    text = """
class Account(AbstractUser):
    pass
class Person(Model):
    email = CharField()
    phone = CharField()
class Order(db.Model):
    __tablename__ = 'orders'
    owner_id: Mapped[int] = mapped_column(Integer)
class Line(db.Model):
    order_id = Column(ForeignKey('orders.id'))
class Part(SQLModel):
    line_id: int = Field(foreign_key='line.id')
class Far(SQLModel):
    part_id: int = Field(foreign_key='part.id')
SCHEMA = "CREATE TABLE IF NOT EXISTS notes (id INT PRIMARY KEY, body VARCHAR(10, 2), writer INT REFERENCES users(id), FOREIGN KEY (writer) REFERENCES users(id))"
LOANS = "SELECT id, borrower_id FROM loans WHERE id = ?"
KNOWN = "SELECT owner FROM notes"
"""
    known = C.facts(spark.createDataFrame([("a", "m.py", text), ("b", "bad.py", "def (: CREATE TABLE t (user_id int, x int)")], "app string, path string, text string")).cache()
    got = {(r.app, r.model): (r.table, ",".join(r.owner_columns), r.via, r.depth) for r in C.owned_models(known).collect()}
    assert got == {
        ("a", "Person"): ("person", "", "person", 0), ("a", "Order"): ("orders", "owner_id", "owner", 0), ("a", "Line"): ("line", "order_id", "reference", 1),
        ("a", "Part"): ("part", "line_id", "reference", 2), ("a", "loans"): ("loans", "borrower_id", "owner", 0), ("b", "t"): ("t", "user_id", "owner", 0),
    }


def test_which_sinks_are_seeds(spark):
    # what stands before a call of the module includes the functions above it
    text = """
import os
def lonely(a):
    return db.execute("select * from t where x = " + a)
def fixed(name_of):
    return open(name_of)
def named(filename):
    return open(filename)
def caller():
    fixed("constant.txt")
    fed(request.args["p"])
def fed(p):
    return open(p)
def two(a, request):
    x = 1
    db.execute("delete from t where n = %s" % a)
    y = 2
    db.execute("delete from t where n = %s" % request.args["n"])
def looked_up(request):
    row = session.query(File).filter(File.id == request.args["id"]).first()
    return open(row.path)
def weak(request):
    p = os.path.join("/srv", request.args["name"])
    if not p.startswith("/srv"):
        raise ValueError
    return open(p)
def part(request):
    return open(Path(request.args["x"]).name)
class View:
    def get(self, q):
        return text("select a from b where c = '{}'".format(q))
    def list(self, q):
        return conn.execute(text(f"select a from b where c = {q}"))
request_file = request.args["f"]
open(request_file)
"""
    files = [("a", "app.py", text), ("a", "app/management/commands/load.py", text.replace("fed", "unfed")), ("a", "settings.py", text)]
    got = sorted((r.function, r.line_start, r.priority, r.control) for r in C.sinks(C.facts(spark.createDataFrame(files, "app string, path string, text string"))).collect())
    assert got == [
        ("<module>", 35, 0, "weak"), ("fed", 13, 1, "none"), ("get", 31, 0, "none"), ("list", 33, 1, "none"), ("lonely", 4, 1, "none"), ("named", 8, 1, "none"), ("two", 18, 0, "none"), ("weak", 26, 0, "weak"),
    ]


def test_parts_are_joined_as_they_were_cut():
    assert O.split_text("Aaaa bbbb. Cccc dddd. Eeee ffff.", 22) == ["Aaaa bbbb. Cccc dddd.", "Eeee ffff."]
    assert O.split_text("one\ntwo\nthree\n\nfour", 9) == ["one\ntwo", "three", "four"]
    assert O.split_text("a b\n\nc d\n \ne f", 9) == ["a b\n\nc d", "e f"]
    assert O.split_text("x" * 7, 3) == ["xxx", "xxx", "x"] and O.split_text("  ", 3) == []


def test_the_first_content_of_a_page_is_taken():
    from marlstone.operators.documents import _Sections

    def read(html):
        p = _Sections()
        p.feed(html)
        p.close()
        return p.sections()

    assert read("<article><p>a</p></article><article><p>b</p></article><div role='main'><p>c</p></div>") == [("Introduction", "a")]
    assert read("<article><p>a</p></article><main><h2>T</h2><div><p>b</p></div></main><main><p>c</p></main>") == [("T", "b")]
    assert read("<nav><main><p>n</p></main></nav><div role='main'><div><p>c</p></div></div><p>d</p>") == [("Introduction", "c")]
    assert read("<h1>A</h1><p>x</p><footer><p>f</p></footer><h2>B</h2><p>y") == [("A", "x"), ("B", "y")]


def test_windows():
    import ast

    text = "\n".join(f"def f{i}():\n" + "    x = 1\n" * 50 for i in range(5)) + "def g():\n" + "    y = 2\n" * 300
    total = len(text.splitlines())
    w = C.windows(ast.parse(text), total)
    assert all(b - a < 120 for a, b in w) and w[0][0] == 1 and w[-1][1] == total
    assert all(w[i][1] + 1 == w[i + 1][0] for i in range(len(w) - 1))
    assert C.windows(None, 0) == [] and C.windows(None, 130) == [(1, 120), (121, 130)]


def test_sections(spark):
    page = "<html><nav><p>no</p></nav><main><p>first <b>bold</b></p><h1>One ¶</h1><ul><li><p>in</p> li</li></ul><pre> a\n b</pre><script>x</script><h2>Two</h2></main><p>out</p></html>"
    assert rows(D.sections_html(spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, h string"), "k", "h")) == [(1, 0, "Introduction", "first bold"), (1, 1, "One", "in li\na\n b")]
    md = spark.createDataFrame([(1, "a\n# T\nb\n## U ##\n\n##### v\n")], "k int, text string")
    assert rows(D.sections_markdown(md, "k").select("title", "body"), "title") == [("Introduction", "a"), ("T", "b"), ("U", "##### v")]
    rst = spark.createDataFrame([(1, "intro\n\nTitle\n=====\nbody\n\nAbc\n-\nmore")], "k int, text string")
    assert rows(D.sections_rst(rst, "k").select("title", "body"), "title") == [("Introduction", "intro"), ("Title", "body\n\nAbc\n-\nmore")]


def test_bm25_and_stems_equal_the_full_text_index(spark):
    db = sqlite3.connect(":memory:")
    texts = ["the running dogs", "a dog runs and runs", "relational operators", "nothing here", "operator of relations, running", "generalizations hopping happily"]
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(texts, 1)))
    words = sorted({w for t in texts for w in t.replace(",", "").split()} | {"caresses", "ponies", "agreed", "plastered", "motoring", "conflated", "sized", "falling", "filing", "happy", "sky", "digitizer", "conformably", "electrical", "adoption", "controlling", "rate", "cease", "vietnamization"})
    db.execute("create virtual table v using fts5(x, tokenize='porter unicode61')")
    db.executemany("insert into v(rowid, x) values (?, ?)", list(enumerate(words, 1)))
    db.execute("create virtual table terms using fts5vocab(v, instance)")
    want = {words[d - 1]: t for t, d in db.execute("select term, doc from terms")}
    assert {w: stem(w) for w in words} == want
    db.execute("create virtual table p using fts5(x, tokenize='unicode61')")
    db.executemany("insert into p(rowid, x) values (?, ?)", list(enumerate(texts, 1)))
    score = {d: -s for d, s in db.execute("select rowid, bm25(p) from p where p match 'runs OR running'")}
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "id int, text string")
    got = bm25(docs, "id", {"text": 1.0}, spark.createDataFrame([(1, ["runs", "running"])], "query_id int, terms array<string>"), 9)
    assert {r.id: pytest.approx(r.score) for r in got.collect()} == score


def test_leave_one_out(spark):
    rnd = random.Random(5)
    data = [(rnd.choice("pqr"), i, float(a := rnd.random() < 0.5), float(a) if rnd.random() < 0.9 else 1.0 - a) for i in range(120)]
    got = L.leave_one_out(spark.createDataFrame(data, "g string, id int, a double, label double"), "g", "id", ["a"], "label").collect()
    assert len(got) == 120 and sum(r.keep == bool(data[r.id][2]) for r in got) == 120


def test_leave_one_out_keeps_every_row(spark):
    schema = "g string, id int, a double, label double"
    one = L.leave_one_out(spark.createDataFrame([("p", 1, 1.0, 1.0), ("p", 2, 0.0, 0.0)], schema), "g", "id", ["a"], "label").collect()
    assert [(r.g, r.id, r.p, r.keep) for r in sorted(one)] == [("p", 1, 0.5, True), ("p", 2, 0.5, True)]
    data = [("p", 1, 1.0, 1.0), ("q", 2, 0.0, 0.0), (None, 3, 1.0, 1.0), (None, 4, 0.0, None)]
    got = {r.id: r.p for r in L.leave_one_out(spark.createDataFrame(data, schema), "g", "id", ["a"], "label").collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[3] > 0.5 > got[4]
    named = {r.id: r.p for r in L.leave_one_out(spark.createDataFrame([(g or "none", *x) for g, *x in data], schema), "g", "id", ["a"], "label").collect()}
    assert got == named
    assert L.leave_one_out(spark.createDataFrame([], schema), "g", "id", ["a"], "label").collect() == []


def test_review_rules(spark):
    x = spark.createDataFrame([("refuted", [], "see line 7", 1, 9), ("refuted", [], "nothing", 1, 9), ("refuted", [12], "", 1, 9), ("confirmed", None, "", 1, 9)], "verdict string, control_lines array<int>, reason string, lo int, hi int")
    assert [r.verdict for r in V.settle(x).collect()] == ["refuted", "uncertain", "uncertain", "confirmed"]


def test_sarif_document(spark):
    f = spark.createDataFrame([("CWE-89", "high", "m", [("a.py", 1, 2), ("b.py", 3, 3)])], "rule string, severity string, message string, evidence array<struct<file:string,lo:int,hi:int>>")
    doc = json.loads(R.sarif(f, "tool", "1").head().json)
    result = doc["runs"][0]["results"][0]
    assert result["level"] == "error" and len(result["relatedLocations"]) == 1 and doc["runs"][0]["tool"]["driver"]["rules"] == [{"id": "CWE-89"}]


def test_sources(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_bytes(b"a\0b")
    (tmp_path / "c.txt").write_text("no")
    assert [r.path.rsplit("/", 1)[1] for r in S.source_files(spark, str(tmp_path)).collect()] == ["a.py"]
    (tmp_path / "w.xml").write_text('<L><Weakness ID="89" Name="N"><Description>a\n  b</Description><Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="74"/></Related_Weaknesses></Weakness></L>')
    w = S.weaknesses(spark, str(tmp_path / "w.xml")).head()
    assert (w.id, w.description, [tuple(x) for x in w.related]) == ("CWE-89", "a b", [("ChildOf", "CWE-74")])
    raw = spark.createDataFrame([(json.dumps({"results": [{"check_id": "p.q.rule", "path": "a.py", "start": {"line": 3}, "end": {"line": 4}, "extra": {"message": "m", "severity": "ERROR"}}]}),)], "json string")
    a = S.scanner_findings(raw, "rules", {"rule": "sql"})
    b = S.scanner_findings(spark.createDataFrame([(json.dumps({"results": [{"test_id": "B1", "filename": "a.py", "line_range": [9, 8], "line_number": 8, "issue_severity": "LOW", "issue_text": "t"}]}),)], "json string"), "lint", {"B1": "x"})
    assert [(r.rule_id, r.family, r.line_start, r.line_end, r.scanner) for r in S.scan_union(a, b).collect()] == [("rule", "sql", 3, 4, "rules"), ("B1", "x", 8, 9, "lint")]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in/a.json", "w") as f:
        for i in range(6):
            f.write(json.dumps({"ts": f"2024-01-01T00:00:0{i}", "run": "r", "event_id": f"E{i // 2}", "tool": "read", "status": "ok" if i % 2 else "error", "duration_ms": 1.0}) + "\n")
    q = trace.append(trace.once(trace.read(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    q = trace.reliability(trace.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("rel").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.ok, r.error) for r in spark.sql("select * from rel").collect()] == [(3, 3)]
    patches = spark.createDataFrame([("h", "open", None, 1), ("h", None, "n", 2), ("h", "closed", None, 3)], "hypothesis string, status string, note string, version long")
    patches.write.parquet(str(tmp_path / "p"))
    q = trace.hypotheses(spark.readStream.schema(patches.schema).parquet(str(tmp_path / "p"))).writeStream.format("memory").queryName("hyp").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select * from hyp").collect()] == [("h", "closed", "n", 3)]


def test_catalog(spark, tmp_path):
    from marlstone.operators import catalog as K

    (tmp_path / "w.xml").write_text('<L><Weakness ID="89" Name="N"><Description>d</Description><Related_Weaknesses><Related_Weakness Nature="ChildOf" CWE_ID="74"/></Related_Weaknesses><Common_Consequences><Consequence><Scope>A</Scope><Scope>B</Scope><Impact>I</Impact></Consequence></Common_Consequences></Weakness><Weakness ID="2" Name="M"><Description>e</Description></Weakness></L>')
    w = S.weaknesses(spark, str(tmp_path / "w.xml"))
    assert rows(K.weakness_chunks(w)) == [("CWE-2", 0, "CWE-2: M\ne"), ("CWE-89", 0, "CWE-89: N\nd"), ("CWE-89", 1, "- A, B: I"), ("CWE-89", 2, "- ChildOf CWE-74")]
    cards = spark.createDataFrame([("c", json.dumps({"a": {"refs": ["x#1"], "b": [{"refs_more": ["y#2", "z"]}]}, "refs": "no"}))], "id string, json string")
    refs = K.references(cards)
    assert rows(refs) == [("c", "a.b[0].refs_more", "y#2"), ("c", "a.b[0].refs_more", "z"), ("c", "a.refs", "x#1")]
    odd = spark.createDataFrame([("d", "{"), ("e", None), ("f", "[[{\"refs\": [1, {\"refs\": [2]}], \"n\": {\"refsx\": []}}], 3]"), ("g", "7")], "id string, json string")
    assert rows(K.references(odd)) == [("f", "[0][0].refs", "1"), ("f", "[0][0].refs", '{"refs":[2]}')]
    chunks = spark.createDataFrame([("x#1",), ("y#2",)], "id string")
    assert [r.ref for r in K.broken_references(refs, chunks).collect()] == ["z"]
    fam = spark.createDataFrame([("f", ["CWE-1", "CWE-2"]), ("g", ["CWE-3"])], "family string, cwe_ids array<string>")
    assert rows(K.outside_family(spark.createDataFrame([("c", "f", ["CWE-2", "CWE-9"]), ("d", "g", ["CWE-3"])], "id string, family string, cwe_ids array<string>"), fam)) == [("c", ["CWE-9"])]
    assert rows(K.family_categories(fam, spark.createDataFrame([("A1", ["CWE-2", "CWE-1"]), ("A2", ["CWE-7"])], "category string, cwe_ids array<string>"))) == [("f", "A1")]
    known, skipped = K.wanted([spark.createDataFrame([("CWE-100",), ("CWE-9",)], "id string"), spark.createDataFrame([("CWE-9",), ("CWE-7",)], "id string")], spark.createDataFrame([("CWE-9",), ("CWE-100",)], "id string"))
    assert [r.id for r in known.collect()] == ["CWE-9", "CWE-100"] and [r.id for r in skipped.collect()] == ["CWE-7"]
    one = spark.range(1)
    assert one.select(K.mapped_ids(F.lit("CWE-5 list: CWE-20, CWE-3 CWE-20"), "list:")).head()[0] == ["CWE-3", "CWE-20"]
    assert one.select(K.top_list(F.lit("CWE-2 CWE-1 CWE-2"), 2)).head()[0] == ["CWE-2", "CWE-1"]
    with pytest.raises(Exception, match="ids found: 1"):
        one.select(K.top_list(F.lit("CWE-2"), 2)).collect()
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    m = spark.createDataFrame([("a", digest("1")), ("b", digest("2")), ("c", "x")], "path string, sha256 string")
    assert rows(K.manifest_faults(m, spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4")], "path string, text string"))) == [("b", "changed"), ("c", "missing"), ("d", "unlisted")]
    facts = C.facts(application(spark))
    loci = spark.createDataFrame([("shop", "k1", "shop/views.py", "shelf")], "app string, case_id string, path string, function string")
    assert [(r.line_start, r.line_end) for r in K.manifest_loci(loci, facts).collect()] == [(21, 24)]
    assert rows(K.core_split(spark.createDataFrame([("a", 1), ("a", 2)], "app string, id int"), spark.createDataFrame([("a", 1, "CWE-89"), ("a", 2, "CWE-5"), ("b", 1, "CWE-89")], "app string, id int, cwe string"), ["CWE-89"])) == [(False, 1), (True, 1)]
    x = spark.createDataFrame([("x = 1  # hi\ny = '# no'\n",), ("def (:",), (None,)], "t string").select(K.without_comments("t").alias("t"))
    assert [r.t for r in x.collect()] == ["x = 1      \ny = '# no'\n", "def (:", ""]
    assert one.select(K.hidden_report(F.lit("a​b‮​"))).head()[0] == "U+200B ZERO WIDTH SPACE, U+202E RIGHT-TO-LEFT OVERRIDE"
    assert one.select(K.wrapped(F.lit("a N1 b"), "N1")).head()[0] == "<<N1\na  b\nN1>>"
