"""Edge rows of the candidates' way and of advisories: nulls, empty tables, bounds, repeats."""

import json

from pyspark.sql import functions as F

from marlstone.operators import advisories as A
from marlstone.operators import catalog as K
from marlstone.operators import sweep as W
from marlstone.sources import tables as S


def test_arguments(spark):
    cases = [
        ("read_file", '{"path": "a", "start_line": 1, "end_line": null}', []),
        ("read_file", '{"path": null}', ["path: no text"]),
        ("read_file", "[1]", ["path: missing"]),
        ("read_file", "not json", ["path: missing"]),
        ("read_file", None, ["path: missing"]),
        ("list_files", "{}", []),
        ("list_files", '{"max_entries": 501}', ["max_entries: out of bounds"]),
        ("list_files", '{"max_entries": "7"}', []),
        ("list_files", '{"max_entries": 7.5}', ["max_entries: no number"]),
        ("search_code", '{"pattern": "", "x": 1}', ["pattern: out of bounds", "x: not known"]),
        ("scan_static", '{"scanner": "other"}', ["scanner: no choice"]),
        ("retrieve_knowledge", '{"query": "q", "cwe": "CWE-1", "k": 8}', []),
        ("retrieve_knowledge", '{"query": "q", "cwe": "cwe-1", "k": 0}', ["cwe: no id", "k: out of bounds"]),
        (None, "{}", ["tool: unknown "]),
    ]
    df = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(cases)], "i int, tool string, arguments string")
    got = {r["i"]: r["errors"] for r in W.argument_errors(df).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(cases)}


def test_requests_end_at_the_first_that_cannot_be_answered(spark):
    symbols = spark.createDataFrame([("a", "f", "x.py", 5, 200), ("a", "f", "w.py", 1, 3), ("a", "g", "x.py", 7, 9)], "app string, name string, path string, line_start int, line_end int")
    asked = [("a", 1, 1, "x.py", "m.f(1)"), ("a", 1, 2, "x.py", "f"), ("a", 1, 3, "x.py", "g"), ("a", 2, 1, "z.py", "f"), ("a", 2, 2, "z.py", "g"), ("a", 2, 3, "z.py", "f"), ("a", 3, 1, "x.py", None), ("b", 4, 1, "x.py", "f")]
    got = W.answered_requests(spark.createDataFrame(asked, "app string, candidate int, turn int, path string, need string"), symbols)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 1, "f", "x.py", 5, 85), ("a", 2, 1, "f", "w.py", 1, 3), ("a", 2, 2, "g", "x.py", 7, 9)]


def test_windows_and_empty_tables(spark):
    w = spark.createDataFrame([("a", "m.py", 1, 9), ("a", "b.py", 10, 19), ("a", "b.py", 1, 9)], "app string, path string, line_start int, line_end int")
    first = spark.createDataFrame([("a", "m.py"), ("a", "m.py")], "app string, path string")
    x = W.budgeted_windows(w, first, 2)
    assert [(r["path"], r["line_start"], r["skipped"]) for r in x.orderBy("ord").collect()] == [("m.py", 1, False), ("b.py", 1, False), ("b.py", 10, True)]
    assert tuple(W.coverage(x).first()) == ("a", 3, 1, ["b.py"], ["b.py", "m.py"])
    assert W.coverage(W.budgeted_windows(w.limit(0), first.limit(0))).count() == 0
    c = spark.createDataFrame([("e", "f", 5), ("e", None, 5), ("none", "f", 5), ("e", "f", None)], "event_id string, family string, line int")
    shown = spark.createDataFrame([("e", 1, 9)], "event_id string, lo int, hi int")
    assert sorted(r["fate"] for r in W.in_window(c, shown, ["f"]).collect()) == ["kept", "other_family", "out_of_window", "out_of_window"]


def test_advisories(spark):
    good = {"id": "A", "published": "2026-01-02T03", "database_specific": {"cwe_ids": ["CWE-89", "CWE-564", "CWE-1"]}, "references": [{"url": "https://github.com/o/r/commit/abcdef123"}, {"url": "https://github.com/o/r/commit/abcdef1234567"}]}
    bad = [{**good, "withdrawn": "x"}, {**good, "published": "2025-01-01"}, {**good, "published": None}, {**good, "database_specific": None}, {**good, "references": []}, {**good, "database_specific": {"cwe_ids": ["CWE-89", "CWE-22"]}}]
    df = spark.createDataFrame([(json.dumps(x),) for x in [good, *bad]] + [("{",), (None,)], "json string")
    rows = A.selected(df, "2026").collect()
    assert [(r["id"], r["family"], r["cwes"], r["sha"]) for r in rows] == [("A", "sql_injection", ["CWE-564", "CWE-89"], "abcdef1234567")]


def test_source_without_talk(spark):
    src = '"""doc\nmore"""\nx = 1  # é # c\ny = "# kept"\nif x:\n    "alone"  # with it\n    # c\n'
    r = spark.createDataFrame([(src,), ("",), (None,), ("x = (",)], "t string").select("t", K.code_lines("t").alias("n"), K.without_talk("t").alias("s")).collect()
    assert r[0]["n"] == [3, 4, 5]
    assert r[0]["s"] == '"""[docstring removed]"""\n\nx = 1  # [comment removed]\ny = "# kept"\nif x:\n    """[docstring removed]"""\n    # [comment removed]\n'
    assert [(x["n"], x["s"]) for x in r[1:]] == [([], ""), ([], ""), (None, "x = (")]


def test_chunks_of_a_source(spark):
    x = spark.createDataFrame([("s", 3, "One", "a b " * 40), ("s", 5, "Stub", "short"), ("s", 9, "Two", "c" * 90), ("t", 1, "T", None)], "k string, section int, title string, body string")
    got = K.source_chunks(x, "k", 100, ["a", "two"]).orderBy("id").collect()
    assert [(r["id"], r["title"]) for r in got] == [("s#000.0", "One"), ("s#000.1", "One"), ("s#002.0", "One \u2014 Two")]
    assert all(len(r["text"]) <= 100 for r in got)


def test_word_lists_and_written_rows(spark, tmp_path):
    x = spark.createDataFrame([("a", "sources: [p, 3]\nx: 1"), ("b", "sources: ["), ("c", None), ("d", "- 1")], "app string, text string")
    assert sorted(tuple(r) for r in S.word_lists(x).collect()) == [("a", "sources", 0, "p"), ("a", "sources", 1, "3")]
    path = str(tmp_path / "rows")
    for rows in ([(1, None)], [(2, "b"), (3, "")]):
        S.write_jsonl(spark.createDataFrame(rows, "i int, t string"), path)
    assert sorted(tuple(r) for r in S.jsonl(spark, path, "i int, t string").collect()) == [(2, "b"), (3, "")]


def test_observed_text(spark):
    ev = spark.createDataFrame([(1, "r", "x", 1, 2), (2, "s", "x", 1, 2), (3, "o", "x", 1, 2), (4, "none", "x", 1, 2), (5, "r", "x", 9, 9)], "evidence_id int, event_id string, file string, line_start int, line_end int")
    events = spark.createDataFrame([("r", "read_file"), ("s", "search_code"), ("o", "list_files")], "event_id string, tool string")
    shown = spark.createDataFrame([("r", "y", 2, "b"), ("r", "y", 1, "a"), ("s", "y", 1, "n"), ("s", "x", 2, "m"), ("o", "x", 1, "q")], "event_id string, path string, n int, text string")
    got = {r["evidence_id"]: r["observed"] for r in W.observed_text(ev, events, shown).collect()}
    assert got == {1: "a\nb", 2: "m", 3: None, 4: None, 5: ""}


def test_paths(spark):
    hint = lambda p: spark.range(1).select(A.gives_hint(F.lit(p)).alias("x")).first()["x"]
    assert [hint(p) for p in ("README", "a/docs/b.py", "docs/LICENSE", "src/readers.py")] == [True, True, False, False]
    x = spark.range(1).select(A.slug_title(F.lit("p/A01_2025-Broken_Access-x.html")).alias("x"), A.slug_title(F.lit("plain")).alias("y")).first()
    assert tuple(x["x"]) == ("A01:2025", "Broken Access-x") and tuple(x["y"]) == ("plain", None)
