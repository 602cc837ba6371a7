"""Line dedup takes repeated passages out whole, whatever stands beside them."""

import random

from marlstone.llm import linededup


def test_passages_of_short_lines_go_whole(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(8))
    passages = ["\n".join(" ".join(word() for _ in range(20)) for _ in range(n)) for n in (2, 3, 3, 4, 5) * 8]
    rows = []
    for k, p in enumerate(passages):
        rows += [(k, f"{word()} before\n{p}\n{word()} after"), (1000 + k, f"{word()} own start\n{p}\n{word()} own end")]
    rows += [(3000, "A single line.\n\nunlike one"), (3001, "unlike two\n\n\nA single line.\n\nunlike three")]
    got = {r.doc_id: r for r in linededup.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for k, p in enumerate(passages):
        first, again = text[k], text[1000 + k].split("\n")
        assert got[k].text == first and got[1000 + k].text == f"{again[0]}\n{again[-1]}"
        assert got[1000 + k].removed_lines == p.count("\n") + 1 and got[1000 + k].removed_words == len(p.split()) and got[1000 + k].n_lines == len(again)
    assert got[3000].text == text[3000] and got[3001].text == text[3001]


def test_unrelated_neighbours_are_no_chunk(spark):
    rows = [(1, "line 0\nuniq a"), (2, "uniq b\nline 12"), (3, "line 0\nline 12\nuniq q"), (4, "uniq r\n\nline 0\n \nline 12\nend"), (5, "a\na\na\na"), (6, "x\na\na\ny")]
    got = {r.doc_id: r.text for r in linededup.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "uniq r\n\nend", 5: rows[4][1], 6: rows[5][1]}


def test_long_and_repetitive_texts_end_soon(spark):
    rows = [(k, "\n".join(f"row {j % 7}" for j in range(60_000))) for k in range(3)] + [(9, "word " * 400_000)]
    got = {r.doc_id: r.text for r in linededup.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the joints of a cycle have two marks, as it breaks off within its last turn: two chunks, each of which stays once
    assert got[0] == "\n".join(f"row {j % 7}" for j in range(8)) and got[1] == got[2] == "" and got[9] == rows[3][1]


def test_first_places_stay_whole(spark):
    # a chain of documents that share parts: nothing goes that would then stand nowhere
    rows = [(2, "bbb\nccc"), (5, "aaa\nbbb\nccc"), (9, "aaa\nbbb")]
    got = {r.doc_id: r.text for r in linededup.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: "bbb\nccc", 5: "aaa\nbbb", 9: ""}
