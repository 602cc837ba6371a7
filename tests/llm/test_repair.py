"""Structure repair against a plain search over edits, at every block size."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from marlstone.llm.repair import damaged_and_repaired

SCHEMA = "conv_id long, turn long, role string, text string, block string"


def broken(rows):
    """The damage rule, row by row: conversation -> rows in order."""
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        out[conv]  # noqa: B018
        said = lambda v: " " if v is None else str(v)
        role, text, fate = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def plainly(conv, rows):
    faults, seen = [], set()
    for _, role, text in rows:
        solid = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("b" if not solid else "d" if (role, text) in seen else "" if solid[-1] in ".!?" else "t")
        seen.add((role, text))

    @cache
    def best(i, done, budget):
        """Least (cost, audit, result roles) that makes rows i.. follow the roles done legally, by brute search."""
        found = []
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", done):
            found.append((0, "", ()))
        if budget:
            for r in ("user", "assistant"):
                if legal(done + r[0]) and (x := best(i, shorten(done + r[0]), budget - 1)):
                    found.append((2 + x[0], "I" + x[1], ((r, ""), *x[2])))
        if i < len(rows):
            _, role, text = rows[i]
            if x := best(i + 1, done, 2):
                found.append((3 + x[0], "D" + x[1], x[2]))
            if faults[i] not in ("b", "d"):
                for e, c, r in (("K", 0, role), ("R", 2, "user"), ("R", 2, "assistant")):
                    if legal(done + (r[:1] or " ")) and (x := best(i + 1, shorten(done + r[0]), 2)):
                        found.append((c + (faults[i] == "t") + x[0], e + x[1], ((r, text), *x[2])))
        return min(found, key=lambda f: f[:2], default=None)

    cost, audit, result = best(0, "", 2)
    initials = [role[:1] for _, role, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in result).encode()).hexdigest()
    return (conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), bad, cost, audit, digest)


def legal(done):
    return re.fullmatch("s?(ua)*u?", done) is not None


def shorten(done):
    """The same grammar state with few letters."""
    return done if len(done) < 4 else "ua" + "u" * (done[-1] == "u")


def key(row):
    return tuple((v is not None, v) for v in row)


@pytest.mark.parametrize("block", [1, 3, 8192])
def test_repair_equals_a_search(spark, block):
    rng = random.Random(5)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(0, 14)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            text = rng.choice(["So it is.", "yes!", "no", "", " \t", None, "Why?\n", "é ...", "a\x85"])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, text, "x"))
    rows += [(None, 0, "user", "hello.", "y"), (None, None, None, None, "y"), (7, 3, "user", "same.", "z"), (7, 3, "user", "same.", "z")]
    got = [tuple(r) for r in damaged_and_repaired(spark, spark.createDataFrame(rows, SCHEMA), block).collect()]
    want = [plainly(c, r) for c, r in broken(rows).items()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_all_rows_dropped_and_empty_tables(spark):
    gone = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    got = damaged_and_repaired(spark, spark.createDataFrame([(*gone, "user", "Hi.", "x")], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(gone[0], 0, 0, 0, 0, 0, 0, "", nothing)]
    assert damaged_and_repaired(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_long_conversation_is_cut_and_keeps_its_result(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"line {rng.randrange(300)}" + rng.choice(["", ".", "?"]), "") for t in range(3000)]
    table = spark.createDataFrame(rows, SCHEMA)
    a, b = damaged_and_repaired(spark, table, 64).collect(), damaged_and_repaired(spark, table).collect()
    assert a == b
    assert len(a) == 1
    long = spark.createDataFrame([(2, 0, "user", "w" * 2_000_000 + ".", "")], SCHEMA)
    assert damaged_and_repaired(spark, long).first()["audit"] in ("KI", "D", "DI", "RI", "")
