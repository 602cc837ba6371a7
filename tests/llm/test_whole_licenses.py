"""License notices: words that tell them apart are exact, and no fuzzy match is lost beside a better one."""

from marlstone.llm import licenses


def test_notices_are_told_apart(spark):
    rows = {
        1: ("Licensed under CC BY 4.0", "cc-by"), 2: ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa"), 3: ("Licensed under CC-BY-ND", "cc-by,cc-by-nd"), 4: ("Licensd under CC BY-NC 4.0", "cc-by,cc-by-nc"),
        5: ("the General Public Licence", "gpl"), 6: ("Released under the BSD license", "bsd"), 7: ("Relesed under the MIT licence", "mit"), 8: ("licensed under cc by nce", "cc-by"),
        9: ("Released under the ISC license", "isc"), 10: ("Apache License, Version 1.1", ""), 11: ("under the Apache License, Version 2.0", "apache-2.0"), 12: ("small rights reserved", ""), 13: ("licensed under CC-BY-NC-SA", "cc-by,cc-by-nc-sa"),
        14: ("GNU Lesser General Public License", "gpl,lgpl"), 15: ("al rights reserved", "reserved"),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in rows.items()], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.license_labels(docs).collect()} == {i: labels for i, (_, labels) in rows.items()}


def test_every_span_of_a_joined_window(spark):
    text = "Mozilla Publik License, Mozilla Public License, Mozila Public License"
    spans = licenses.license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted((s.start, s.end, s.edits) for s in spans) == [(0, 22, 1), (24, 46, 0), (48, 69, 1)]


def test_no_notice_is_taken_for_another():
    import numpy as np

    from marlstone.llm import _text as T

    scanner = licenses.Scanner()
    apart = {"gpl": {"lgpl", "agpl"}}  # whose notices hold the other's phrase
    for x in licenses.NOTICES:
        data = np.frombuffer(f"so {x.text.replace('[', '').replace(']', '')} ok".encode(), np.uint8)
        found = {f.label for f in scanner.fuzzy(T.words(data, np.array([0, len(data)]), T.ALNUM))}
        assert x.label in found and all(x.label in apart.get(label, ()) for label in found - {x.label}), (x, found)


def test_a_text_of_nothing_but_candidates_ends_soon(spark):
    import time

    rows = [(1, "all rights resrved " * 20_000), (2, "license " * 100_000), (3, "under the mit license released " * 20_000)]
    began = time.time()
    got = {r.doc_id: r for r in licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 30
    assert got[1].labels == "reserved" and got[2].labels == ""
    assert licenses.license_spans(spark.createDataFrame(rows[:1], "doc_id long, text string")).count() == 20_000
