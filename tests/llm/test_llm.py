"""Each operator of the subpackage against a brute-force statement, on tables with edge rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import bpe, chat, decontaminate, fingerprint, licenses, linededup, near_dedup, quality, secrets, token_counts
from marlstone.llm._work import Work
from marlstone.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Extra columns whose names operators use inside.
EXTRA = ["score", "component", "n", "tokens", "_id", "_key", "_repeats", "h", "path", "edits", "kept", "_gone", "_x0", "_lines"]


def texts(seed=1, n=120):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 90))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        t = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 6])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        out.append("".join(w + rnd.choice([" ", " ", " ", "\n"]) for w in t))
    return [*out, "", None, " \n ", "one", "ONE", "a b c", "a b c", "é ü <|endoftext|> x", "x" * 5000, ("long words here " * 9000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())] + [(3, texts()[3], "en"), (None, "no id here at all you see", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in EXTRA:
        df = df.withColumn(c, F.lit("x"))
    return df.repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Work(spark, "t")).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), Work(spark, "t")).count() == 0


@pytest.mark.parametrize("percent", [60, 85])
def test_near_duplicates(spark, docs, percent):
    known = [(r.doc_id, shingles(r.text)) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    root = {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in known:
        for j, b in known:
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicates(spark, docs, percent).collect()
    assert len(got) == docs.count()
    sizes = {(i, len(s)) for i, s in known}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.doc_id, r.n_shingles) in sizes and r.component_id == find(r.doc_id) and r.kept == (r.doc_id == find(r.doc_id))


def near_groups(seed, groups, size):
    """Rows, and the smallest id that brute force reaches from each."""
    rnd, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{g}_{i}" for i in range(120)]
        for _ in range(size):
            i, t = len(rows), list(base)
            for k in range(rnd.choice([0, 1, 1, 2, 3, 4])):
                t[rnd.randrange(120)] = f"e{i}_{k}"
            rows.append((i, " ".join(t)))
    known, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i - i % size, i):
            if 100 * len(known[i] & known[j]) >= 85 * len(known[i] | known[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return rows, {i: find(i) for i in range(len(rows))}


@pytest.mark.parametrize("small", [{}, {"small_node": 4, "max_depth": 3}, {"small_node": 1, "max_depth": 6}])
def test_near_duplicates_of_a_large_group(spark, small):
    """Also with nodes that branch again and again: the recursion loses nothing here, so recall against brute force is 1."""
    rows, want = near_groups(8, 1, 260)
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), **small).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) > 10


def test_recall_of_pairs_in_many_groups(spark):
    rows, want = near_groups(9, 60, 6)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), small_node=2).collect()}
    pairs = [(i, j) for i in want for j in range(i - i % 6, i) if want[i] == want[j]]
    assert len(pairs) > 200 and sum(got[i] == got[j] for i, j in pairs) >= 0.99 * len(pairs)
    assert all(want[i] == want[j] for i in got for j in range(i - i % 6, i) if got[i] == got[j])


def test_no_structural_collisions(spark):
    """Two texts of one word that a polynomial hash modulo a power of two takes for the same."""
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    got = near_dedup.near_duplicates(spark, spark.createDataFrame([(1, t), (2, t.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")).collect()
    assert all(r.kept for r in got) and len(got) == 2


def test_bpe_is_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = bpe.encode_decode(spark, docs, PATH).collect()
    assert len(got) == docs.count()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in got)
    back = bpe.decode(spark, bpe.encode(spark, docs.where("doc_id is not null"), PATH), PATH).collect()
    assert {r.doc_id: r.text for r in back} == {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}


def test_bpe_streams_with_constant_memory():
    tokenizers = pytest.importorskip("tokenizers")
    model, t = bpe.load(bpe.model_bytes(PATH)), tokenizers.Tokenizer.from_file(PATH)
    rnd = random.Random(2)
    for text in ("".join(rnd.choice("abcdeé ") for _ in range(30000)).replace(" ", "q"), "ab" * 20000, "x" * 30000, "the" * 9000):
        parts = [text.encode()[i : i + 777] for i in range(0, len(text.encode()), 777)]
        assert list(model.tokens(iter(parts))) == t.encode(text, add_special_tokens=False).ids
        assert [i for ids in model.runs(f"ok {text} yes") for i in ids] == t.encode(f"ok {text} yes", add_special_tokens=False).ids
    assert max(map(len, model.runs("xq" * 500_000))) <= bpe.PIECES

    def endless():
        for k in range(400):
            yield b"abcdefgh" * 64
            produced.append(k)

    produced = []
    out = model.tokens(endless())
    next(out)
    assert len(produced) < 20  # tokens come long before the piece ends


def test_bpe_on_random_unicode():
    tokenizers = pytest.importorskip("tokenizers")
    model, t = bpe.load(bpe.model_bytes(PATH)), tokenizers.Tokenizer.from_file(PATH)
    rnd = random.Random(6)
    for _ in range(2000):
        x = "".join(rnd.choice(["a", "th", " ", "  ", "\n", "é", "ß", "1", "'s", "'re", "--", "中", "😀", "<|endoftext|>", " ", "\x1c", " "]) for _ in range(rnd.randint(0, 40)))
        assert [i for r in model.runs(x) for i in r] == t.encode(x, add_special_tokens=False).ids


def test_fingerprints(spark, docs):
    rows = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0], r[1] or 0, r[2]))
    got = sorted(fingerprint.compare_with_edits(spark, docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r[1] for r in rows]
    prints = {}
    for (_, _, t), (_, _, nxt), r in zip(rows, rows[1:] + rows[:1], got, strict=True):
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        a, b = shingles(t), shingles(e)
        want = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - want) < (0.12 if len(a) > 20 else 0.5)
    one = fingerprint.compare_with_edits(spark, spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).head()
    assert one.near_next == 1.0


def test_licenses(spark, docs):
    odd = spark.createDataFrame([(1000, "Relesed undr the MIT  licence. All rights reserved, ALL RIGHTS RESERVED"), (1001, "cc-by cc by"), (1002, "ccby all rights")], "doc_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    every = docs.select("doc_id", "text").unionByName(odd)
    got = licenses.license_labels(every).collect()
    text = {r.doc_id: r.text or "" for r in every.collect()}
    for r in got:
        w = word.findall(text[r.doc_id].translate(LOWER))
        at, labels = [], set()
        for p, label in licenses.BASE.items():
            q = p.split()
            for k in range(len(w) - len(q) + 1):
                if w[k : k + len(q)] == q:
                    at.append(k)
                    labels.add(label)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert {r.doc_id: r.labels for r in got if r.doc_id and r.doc_id >= 1000} == {1000: "mit,reserved", 1001: "cc-by", 1002: ""}
    spans = licenses.license_spans(odd).where("label = 'mit'").collect()
    assert [(s.start, s.end, s.edits) for s in spans] == [(0, 29, 3)]


def test_fuzzy_search_finds_what_a_full_scan_finds():
    import numpy as np
    import regex

    from marlstone.llm import _text as T

    rnd = random.Random(9)
    notice, k = "licensed under the apache license version 2", 4
    for _ in range(150):
        t = list(notice)
        for _ in range(rnd.randint(0, 6)):
            p = rnd.randrange(len(t))
            t[p : p + 1] = rnd.choice([[], [rnd.choice("abc")], [t[p], rnd.choice("abc")]])
        text = "some words " + "".join(t) + " and more"
        data = np.frombuffer(text.encode(), np.uint8)
        found = licenses.Scanner((licenses.Notice(notice, "apache", k),)).fuzzy(T.words(data, np.array([0, len(data)]), T.ALNUM))
        plain = " ".join(text.split())
        assert bool(found) == bool(regex.search(f"(?b)(?<![0-9a-z])(?:{regex.escape(notice)}){{e<={k}}}(?![0-9a-z])", plain))


def test_chat(spark):
    rows = [(1, 0, "user", "a\\n<|im_end|>"), (1, 1, "assistant", "x\\"), (1, 1, "assistant", "x\\"), (1, 2, None, None), (2, 0, "assistant", ""), (None, 0, "user", "<|im_start|>assistant\nq")]
    rows += [(7, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(37)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("x")).withColumn("node", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.conversations(spark, chat.from_turns(df))).collect()}
    for c in (1, 2, 7, None):
        turns = [(r or "", t or "") for i, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_sha256, got[c].loss_chars) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), hashlib.sha256(learnt.encode()).hexdigest(), len(learnt))
    assert chat.read_back(chat.conversations(spark, chat.from_turns(df.where("false")))).count() == 0


def test_reply_trees(spark):
    rnd = random.Random(4)
    nodes = [("t", i, rnd.randrange(i) if i else None, "user", f"n{i}", rnd.random()) for i in range(60)]
    parent, score = {n[1]: n[2] for n in nodes}, {n[1]: n[5] for n in nodes}
    want = {}
    for leaf in set(parent) - set(parent.values()):
        path, at = [], leaf
        while at is not None:
            path.append(at)
            at = parent[at]
        want[leaf] = path[::-1]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    got = chat.conversations(spark, df).collect()
    assert {r.leaf: [int(t[1:]) for _, t in chat.read_turns(r.formatted)] for r in got} == want
    order = sorted(want, key=lambda leaf: (-round(sum(score[n] for n in want[leaf]), 9), leaf))
    assert [r.leaf for r in sorted(got, key=lambda r: r.branch)] == order
    assert chat.conversations(spark, df, branches=2).count() == 2


def line_rule(rows):
    """The rule of line dedup by whole Python: id -> (text, lines that go), and the places of each chunk."""
    units, marks, places = {}, {}, {}
    for d, (_, t) in enumerate(rows):
        worded = [x for x in t.split("\n") if WORD.search(x)]
        units[d] = [[k for k in zip(worded, worded[1:])], worded]
        for k in units[d][0]:
            marks.setdefault(k, []).append(d)
    for d in units:
        joints, worded = units[d]
        k = 0
        while k < len(joints):
            m = k + 1
            if len(marks[joints[k]]) > 1:
                while m < len(joints) and sorted(marks[joints[m]]) == sorted(marks[joints[k]]):
                    m += 1
                places.setdefault(tuple(worded[k : m + 1]), []).append((d, k))
            k = m
        for k, x in enumerate(worded):
            if len(WORD.findall(x)) >= 50:
                places.setdefault((x,), []).append((d, k))
    out = {}
    for d, (i, t) in enumerate(rows):
        parts = t.split("\n")
        worded = [k for k, x in enumerate(parts) if WORD.search(x)]
        gone, stay = set(), set()
        for chunk, at in places.items():
            for p in at if len(at) > 1 else ():
                if p[0] == d:
                    (stay if p == min(at) else gone).update(range(worded[p[1]], worded[p[1] + len(chunk) - 1] + 1))
        gone -= stay
        out[i] = "\n".join(x for k, x in enumerate(parts) if k not in gone), len(gone)
    return out, places


def test_line_dedup(spark, docs):
    shared = "\n".join("shared line number %d with some words in it" % k for k in range(12))
    more = [(900, "own start\n" + shared + "\nown end"), (901, shared), (902, "x\n" + shared + "\ny\nz"), (903, "Les."), (904, "Les."), (905, " ".join(["word"] * 60)), (906, "zzz\n" + " ".join(["word"] * 60))]
    every = docs.select("doc_id", "text", *EXTRA).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    out = linededup.rewrite(spark, every)
    assert out.columns[:-3] == every.columns and out.count() == every.count()
    got = {r.doc_id: r for r in linededup.line_dedup(spark, every).collect()}
    assert got[900].text == more[0][1] and got[903].text == got[904].text == "Les." and got[905].text and got[906].text == "zzz"
    assert len(got[902].text) < len(more[2][1]) / 2 and got[902].text.startswith("x\n") and got[902].text.endswith("z")
    want, _ = line_rule(sorted({(-(2**63) if r.doc_id is None else r.doc_id, r.text) for r in every.collect() if r.text is not None}))
    for i, (text, gone) in want.items():
        if i >= 0:
            assert got[i].text == text and (got[i].n_lines, got[i].removed_lines) == (len(text.split("\n")) + gone if text or not gone else got[i].n_lines, gone), i


def test_repeated_chunks_stand_whole_at_their_first_place(spark):
    rnd = random.Random(23)
    passages = [[f"p{k} line {j}" for j in range(rnd.randint(2, 5))] for k in range(12)]

    def part():
        p = rnd.choice(passages)
        return p[rnd.choice([0, 0, 1]) : rnd.choice([len(p), len(p), 2])] + [f"own {rnd.randint(0, 99)}"]

    rows = [(d, "\n".join(x for _ in range(rnd.randint(1, 5)) for x in part())) for d in range(80)]
    got = {r.doc_id: (r.text, r.removed_lines) for r in linededup.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, places = line_rule(rows)
    assert got == want and sum(n for _, n in got.values()) > 100
    repeated = {chunk: min(at)[0] for chunk, at in places.items() if len(at) > 1}
    assert len(repeated) > 20 and all("\n".join(chunk) in got[d][0] for chunk, d in repeated.items())


def test_decontamination(spark, docs):
    rnd = random.Random(5)
    items = [(k, " ".join(f"q{k}w{j}" for j in range(rnd.randint(3, 40)))) for k in range(12)] + [(90, None), (91, ""), (3, None)]
    w = lambda k: items[k][1].split()
    half = len(w(5)) // 2
    leaks = [(800, "before " + items[2][1].upper().replace(" ", ", ") + " after"), (801, " ".join(w(5)[half:] + ["x"] + w(5)[:half])), (802, " ".join(w(6)[: len(w(6)) // 3])), (803, items[7][1] + "\n" + items[8][1])]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(leaks, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(spark, every, bench).collect()}
    assert got == {(800, 2), (801, 5), (803, 7), (803, 8)}
    clean = decontaminate.drop_contaminated(spark, every, bench)
    assert clean.count() == every.count() - 3 and clean.columns == every.columns
    assert decontaminate.matches(spark, every, bench.where("false")).count() == 0


def test_candidates_lose_no_contained_item(monkeypatch):
    import numpy as np

    rnd = random.Random(31)
    text = lambda n: " ".join(f"w{rnd.randint(0, 6)}" for _ in range(n))
    items = [(k, text(rnd.randint(1, 30))) for k in range(60)] + [(99, "")]
    docs = [text(rnd.randint(0, 60)) for _ in range(40)] + [items[k][1] + " " + text(5) for k in range(20)]
    rows = np.cumsum([0, *map(len, docs)])
    data = np.frombuffer("".join(docs).encode(), np.uint8)
    index = decontaminate.Index(items)
    words = decontaminate.T.words(data, rows, decontaminate.T.ALNUM)
    h = decontaminate.T.word_hashes(words)
    want = set()
    for r in range(len(docs)):
        for k, (_, item) in enumerate(index.items):
            n = sum(m for _, _, m in decontaminate.tiles(item, h[words.first[r] : words.first[r + 1]])) if len(item) else 0
            if len(item) and n >= 0.6 * len(item):
                want.add((r, k, n))
    for places in (1, 50, 1 << 20):
        monkeypatch.setattr(decontaminate, "PLACES", places)
        got = [(r, i if i != 99 else 60, n) for r, i, _, n, _, _ in index.contained(data, rows, 0.6)]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_a_run_that_all_share_is_not_tiled(monkeypatch):
    import numpy as np

    word = lambda: "".join(random.choice("abcdefghij") for _ in range(9))
    shared = " all rights reserved by us "
    index = decontaminate.Index([(k, " ".join(word() for _ in range(20)) + shared + word()) for k in range(1000)])
    docs = [" ".join(word() for _ in range(60)) + shared + word() for _ in range(200)]
    monkeypatch.setattr(decontaminate, "tiles", lambda *a: pytest.fail("tiled"))
    assert not list(index.contained(np.frombuffer("".join(docs).encode(), np.uint8), np.cumsum([0, *map(len, docs)]), 0.6))


def test_tiles_are_the_greedy_tiling():
    import numpy as np

    def plain(a, b, least):
        ma, mb, out = [False] * len(a), [False] * len(b), []
        while True:
            best = []
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                        n += 1
                    if n >= least and (not best or n >= best[0][0]):
                        best = [*([] if not best or n > best[0][0] else best), (n, i, j)]
            if not best:
                return out
            for n, i, j in best:
                if not any(ma[i : i + n]) and not any(mb[j : j + n]):
                    ma[i : i + n] = mb[j : j + n] = [True] * n
                    out.append((i, j, n))

    rnd = random.Random(7)
    for _ in range(120):
        a = np.array([rnd.randrange(6) for _ in range(rnd.randint(1, 30))], np.uint64)
        b = np.array([rnd.randrange(6) for _ in range(rnd.randint(1, 40))], np.uint64)
        least = min(3, len(a))
        assert decontaminate.tiles(a, b, 3) == plain(a.tolist(), b.tolist(), least)


def test_tiling_of_repetitive_texts_ends_soon():
    import time

    import numpy as np

    began = time.time()
    one = decontaminate.tiles(np.full(3000, 7, np.uint64), np.full(100_000, 7, np.uint64))
    two = decontaminate.tiles(np.resize(np.arange(2, dtype=np.uint64), 3001), np.resize(np.arange(3, dtype=np.uint64), 100_000), 2)
    assert one == [(0, 0, 3000)] and sum(n for *_, n in two) == 3000 and time.time() - began < 5


def test_secrets(spark, docs, tmp_path):
    key = hashlib.sha1(b"1").hexdigest()
    rows = [(700, f'set token = "{key}" here'), (701, f"see commit {key} for it"), (702, "card 4635346203346400 and 12"), (703, None), (704, "api_key: 9f86d081884c7d659a2feaa0c55ad015")]
    every = docs.select("doc_id", "text", "path").unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    got = {r.doc_id: r for r in secrets.secrets(spark, every, path="path").collect()}
    assert set(got) == {700, 704} and got[700].first_char == 13 and got[700].length == 40
    model = secrets.train(secrets.labelled_findings(spark))
    fresh = secrets.labelled_findings(spark, 1600, seed=77)
    from pyspark.ml.functions import array_to_vector

    x = model.transform(fresh.withColumn("features", array_to_vector(F.array(*secrets.features("candidate", "before", "before2", "path")))))
    assert x.where("label = prediction").count() >= 1580
    every.write.parquet(str(tmp_path / "d"))
    plan = secrets.secrets(spark, spark.read.parquet(str(tmp_path / "d")), "path", secrets.labelled_findings(spark, 400))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_token_counts_after_edits(spark, docs):
    model = bpe.load(bpe.model_bytes(PATH))
    count = lambda t: sum(len(r) for r in model.runs(t))
    got = token_counts.edit_counts(spark, token_counts.three_edits(docs), PATH).collect()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        t = r.text or ""
        n, first = len(t), t[:40]
        e = t[: n // 3] + t[n // 3 + min(20, n) :]
        m = min(n // 2, len(e))
        e = e[:m] + first + e[m:] + " ok."
        want[r.doc_id] = (n, count(t), len(e), count(e))
    assert all((r.n_chars, r.n_tokens, r.n_chars_after, r.n_tokens_after) == want[r.doc_id] for r in got) and len(got) == docs.count()
    assert all(r.encoded_chars < 400 for r in got if r.n_chars > 100000)
    rnd, pieces = random.Random(3), ["a", " ", "  ", "\n", "é", "the", "1", "'s", "'r", "e", "--", "<|endoftext|>", "<|endof", "text|>", "\t"]
    for _ in range(400):
        t = "".join(rnd.choice(pieces) for _ in range(rnd.choice([0, 3, 30, 900])))
        tree = token_counts.CountTree(model, t)
        for _ in range(6):
            at, cut, new = rnd.randint(0, len(t) + 2), rnd.choice([0, 1, 5, 40]), "".join(rnd.choice(pieces) for _ in range(rnd.choice([0, 1, 4, 30])))
            a = min(at, len(t))
            t = t[:a] + new + t[a + min(cut, len(t) - a) :]
            tree.edit(at, cut, new)
            assert (tree.text, tree.total, tree.length) == (t, count(t), len(t))


def test_an_edit_costs_its_own_length_and_sees_whole_special_tokens(tmp_path):
    import json
    import time

    spans = []
    model = bpe.load(bpe.model_bytes(PATH))
    for n in (20_000, 400_000):
        tree = token_counts.CountTree(model, "some words of it, and more. " * (n // 28))
        began = time.perf_counter()
        for k in range(400):
            tree.edit(k * 37 % n, 3, "new ")
        spans.append(time.perf_counter() - began)
    assert spans[1] < 4 * spans[0] + 0.05
    j = json.loads(bpe.model_bytes(PATH))
    j["added_tokens"] = [*j["added_tokens"], {"id": 60000, "content": "<|a special token of some length|>"}]
    long = bpe.BPE(json.dumps(j).encode())
    count = lambda t: sum(len(r) for r in long.runs(t))
    tree = token_counts.CountTree(long, "x y <|a special token of some lengt|> z " * 3)
    assert tree.total == count(tree.text)
    tree.edit(tree.text.index("|> z"), 0, "h")
    assert tree.total == count(tree.text) and "length|>" in tree.text


def test_quality(spark, docs):
    rnd = random.Random(1)
    good = lambda: " ".join(rnd.choice(["the", "of", "and", "house", "tree", "was", "red"]) for _ in range(40))
    rows = [(i, good() if i % 2 else " ".join(w + "!!" for w in good().upper().split())) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    got = quality.classify(spark, d, labels).collect()
    assert len(got) == 400 and sum(r.held_out for r in got) in range(40, 130)
    assert all(r.predicted == r.doc_id % 2 and r.predicted == int(r.score >= 0.3) for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    edge = quality.classify(spark, docs, labels).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge)
    none = quality.classify(spark, docs, labels.where("false")).collect()
    assert all(r.score == 0.5 for r in none)


def test_empty_tables(spark, empty):
    labels, bench = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string")
    for out in (
        near_dedup.near_duplicates(spark, empty), bpe.encode_decode(spark, empty, PATH), fingerprint.compare_with_edits(spark, empty), licenses.license_labels(empty), linededup.line_dedup(spark, empty),
        decontaminate.matches(spark, empty, bench), secrets.secrets(spark, empty, "path"), token_counts.edit_counts(spark, token_counts.three_edits(empty), PATH), quality.classify(spark, empty, labels),
    ):
        assert out.count() == 0


def test_pipeline(spark, docs, tmp_path):
    passage = " ".join(f"bench{k}" for k in range(30))
    good = [(2000 + i, f"the house {i} was red and the tree {i} of it stood there number {i}\nand more of {i} follows here", "en") for i in range(60)]
    bad = [(3000 + i, " ".join(w + "!!" for w in f"THE HOUSE {i} WAS RED AND SO ON {i} MORE".split()), "en") for i in range(60)]
    more = [(4000, good[0][1] + " yes " + passage, "en"), (4001, good[5][1] + " x", "en")]
    every = docs.unionByName(spark.createDataFrame(good + bad + more, "doc_id long, text string, lang string"), allowMissingColumns=True).withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad], "doc_id long, quality int")
    d = str(tmp_path / "sf")
    every.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, d)
        if name != "bpe":
            assert out.columns == every.columns
        out.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert not kept["quality"] & {i for i, *_ in bad} and {i for i, *_ in good} <= kept["quality"]
    emptied = kept["quality"] - kept["line_dedup"]
    assert emptied <= {r.doc_id for r in every.collect()} - {i for i, *_ in good} - {4000, 4001}
    assert 4000 in kept["near_dedup"] and 4000 not in kept["decontamination"]
    assert kept["bpe"] == kept["decontamination"]
    run = corpus_pipeline.run(spark, d)
    assert sorted(map(str, run.collect())) == sorted(map(str, now.collect()))
