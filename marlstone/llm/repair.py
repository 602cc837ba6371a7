"""Repair of damaged conversations to the grammar s?(ua)+ by the cheapest edits.

Every row is one symbol: the kind of its role and its first fault. A backward dynamic programme gives the cost
to go from each turn and grammar state, and a forward walk takes, at each step, the ASCII-least edit
among those that keep to that cost. The turns are then rebuilt from the edits for the digest.

A conversation may be of any length. Its rows are ordered by a range sort and cut into blocks of BLOCK rows. A block is a min-plus
matrix from entry state to exit state; only the blocks of one conversation are chained (a matrix product for
each block), and then all blocks are solved side by side. The digest of a conversation is one
stream by its nature: its rows pass in order through a task that holds one batch and the digest's state.

Edits and costs: Keep 0, Rerole to user or assistant 2, Delete 3 (blank and duplicate rows must go), Insert an
empty user or assistant turn 2; a truncated row that stays adds 1. Grammar states: START (nothing yet), OPENED
(after a system turn), ASKED (after a user turn), ANSWERED. The next legal role is fixed by the state but
at START, where a system turn may be kept; so the edits alone determine the result.

Defined results: a null conv_id is one conversation of its own; null turns come first; a null role or text is one space; rows of
the same turn are ordered by role and text, so a repeated row is next to its original; roles count by their first letter;
a conversation without rows after damage has zeros, an empty audit and the digest of the empty string; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm._work import Work

#: Rows of a conversation that one step holds, as symbols of one byte.
BLOCK = 8192
START, OPENED, ASKED, ANSWERED = range(4)
FAR = 1 << 60
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Kinds of roles and faults; a row's symbol is the hexadecimal digit of 4 * role + fault.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, CUT, BLANK, REPEATED = range(4)
#: Where the next user or assistant turn leads from a state, and which it is.
ONWARD = (ASKED, ASKED, ANSWERED, ASKED)
NEXT_ROLE = ("user", "user", "assistant", "user")
EXPECTED = (USER, USER, ASSISTANT, USER)
#: Cost to go after the last row: nothing, a pair, an answer, nothing.
FINAL = [0, 2 * INSERT, INSERT, 0]
_BLANK = r"[\x20\x09-\x0D]"
Costs = list[int]


def _edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits that use up a row, in ASCII order."""
    role, fault = divmod(symbol, 4)
    out = [("D", DELETE, state)]
    if fault in (SOUND, CUT):
        more = TRUNCATED if fault == CUT else 0
        if role == EXPECTED[state]:
            out.append(("K", more, ONWARD[state]))
        elif role == SYSTEM and state == START:
            out.append(("K", more, OPENED))
        out.append(("R", REROLE + more, ONWARD[state]))
    return out


_EDITS = [[_edits(symbol, state) for state in range(4)] for symbol in range(16)]


def cost_to_go(symbols: list[int], after: Costs) -> list[Costs]:
    """For each place before, between and behind the rows: the least cost from each state, the costs behind the last given."""
    out = [after]
    for symbol in reversed(symbols):
        rest = out[-1]
        use = [min(cost + rest[then] for _, cost, then in _EDITS[symbol][state]) for state in range(4)]
        # at most two insertions lead somewhere new: from START or OPENED to ASKED, and on to ANSWERED
        asked = min(use[ASKED], INSERT + use[ANSWERED])
        answered = min(use[ANSWERED], INSERT + use[ASKED])
        out.append([min(use[START], INSERT + asked), min(use[OPENED], INSERT + asked), asked, answered])
    out.reverse()
    return out


def walk(symbols: list[int], costs: list[Costs], state: int, last: bool) -> str:
    """The least audit among the cheapest from a state; last: nothing follows these rows."""
    audit = []
    for i, symbol in enumerate(symbols):
        while True:
            tight = [(initial, then) for initial, cost, then in _EDITS[symbol][state] if cost + costs[i + 1][then] == costs[i][state]]
            if INSERT + costs[i][ONWARD[state]] == costs[i][state]:
                tight.append(("I", ONWARD[state]))
            initial, then = min(tight)
            audit.append(initial)
            state = then
            if initial != "I":
                break
    while last and costs[-1][state]:
        audit.append("I")
        state = ONWARD[state]
    return "".join(audit)


def matrix(symbols: list[int]) -> list[int]:
    """Least costs from each entry state to each exit state, row by row."""
    exits = [cost_to_go(symbols, [0 if s == e else FAR for s in range(4)])[0] for e in range(4)]
    return [min(exits[e][s], FAR) for s in range(4) for e in range(4)]


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage that the rows' keys decide; nulls of role and text are one space."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = (F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn")).cast("binary")) % 20).cast("int")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), either("role").alias("role"), either("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fate") == 3, 2).otherwise(1)))
    return rows.where("fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _kind(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)


def _symbols(rows: DataFrame, work: Work) -> DataFrame:
    """(conv_id, block, symbols) of placed rows: a digit a row, in order, at most BLOCK of them."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(rf"[.!?]{_BLANK}*\z")
    facts = rows.select("conv_id", "block", "pos", _kind(F.col("role")).alias("kind"), blank.alias("blank"), whole.alias("whole"), F.sha2(F.concat_ws("\n", "role", "text").cast("binary"), 256).alias("said"), F.length("role").alias("role_chars"))
    facts = work.save(facts)
    first = facts.where("NOT blank").groupBy("conv_id", "said", "role_chars").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), REPEATED).when(~F.col("whole"), CUT).otherwise(SOUND)
    coded = facts.join(first, "pos", "left").select("conv_id", "block", "pos", F.lower(F.hex(F.col("kind") * 4 + fault)).alias("symbol"))
    inside = F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"])
    return work.save(coded.groupBy("conv_id", "block").agg(F.array_join(inside, "").alias("symbols")))


def _digits(symbols: str) -> list[int]:
    return [int(x, 16) for x in symbols]


def _record(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(conv, block, matrix(_digits(symbols))) for conv, block, symbols in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield _record(out, ["conv_id", "block", "costs"], [pa.int64(), pa.int64(), pa.list_(pa.int64())])


def _costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from its last to its first: the costs to go behind each, carried as four numbers."""
    at, behind = (), FINAL
    for batch in batches:
        out = []
        for conv, block, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (conv,):
                at, behind = (conv,), FINAL
            out.append((conv, block, behind))
            behind = [min(costs[4 * s + e] + behind[e] for e in range(4)) for s in range(4)]
        yield _record(out, ["conv_id", "block", "behind"], [pa.int64(), pa.int64(), pa.list_(pa.int64())])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's audit for the states that it can be entered in: START alone where it is the only block."""
    for batch in batches:
        out = []
        for conv, block, symbols, behind, last, only in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = _digits(symbols)
            costs = cost_to_go(rows, behind or FINAL)
            ways = [walk(rows, costs, s, last) for s in range(1 if only else 4)]
            out.append((conv, block, symbols, ways))
        yield _record(out, ["conv_id", "block", "symbols", "audits"], [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())])


class _Rebuilt:
    """A conversation while its blocks and rows pass by."""

    LEGAL = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
    __slots__ = ("audit", "before", "blank", "conv", "cost", "cut", "digest", "edits", "illegal", "least", "most", "repeated", "some", "state", "turn", "turns")

    def __init__(self, conv: int | None):
        self.conv, self.digest, self.audit, self.state = conv, hashlib.sha256(), [], START
        self.blank = self.repeated = self.cut = self.illegal = self.cost = self.turns = 0
        self.least = self.most = self.turn = self.before = None
        self.edits, self.some = iter(()), False

    def block(self, symbols: str, audits: list[str]) -> None:
        self._inserted()
        audit = audits[self.state]
        self.audit.append(audit)
        self.edits, at = iter(audit), 0
        for symbol in _digits(symbols):
            role, fault = divmod(symbol, 4)
            self.blank += fault == BLANK
            self.repeated += fault == REPEATED
            self.cut += fault == CUT
            self.illegal += self.before is not None and (self.before, role) not in self.LEGAL
            self.before = role
            while audit[at] == "I":
                at += 1
            self.cost += {"D": DELETE, "R": REROLE}.get(audit[at], 0) + (TRUNCATED if fault == CUT and audit[at] != "D" else 0)
            at += 1
        self.cost += INSERT * audit.count("I")

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = self.turn = turn
        for edit in self.edits:
            if edit == "I":
                self._say(NEXT_ROLE[self.state], "")
                self.state = ONWARD[self.state]
                continue
            if edit == "K":
                self._say(role, text)
                self.state = OPENED if self.state == START and role[:1] == "s" else ONWARD[self.state]
            elif edit == "R":
                self._say(NEXT_ROLE[self.state], text)
                self.state = ONWARD[self.state]
            break

    def _inserted(self) -> None:
        for _ in self.edits:  # what is left behind the last row are insertions
            self._say(NEXT_ROLE[self.state], "")
            self.state = ONWARD[self.state]

    def _say(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True

    def result(self) -> tuple:
        self._inserted()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return self.conv, gaps, self.blank, self.repeated, self.cut, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


_OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_OUT_KINDS = [*[pa.int64()] * 7, pa.string(), pa.string()]


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks, blocks and rows in order of conversation, block and place; a row for each conversation."""
    now: _Rebuilt | None = None
    for batch in batches:
        out = []
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "symbols", "audits", "pos", "turn", "role", "text")]
        for conv, symbols, audits, pos, turn, role, text in zip(*columns, strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.result())
                now = _Rebuilt(conv)
            if symbols is not None:
                now.block(symbols, audits)
            elif pos is not None:
                now.row(turn, role, text)
        yield _record(out, _OUT, _OUT_KINDS)
    if now is not None:
        yield _record([now.result()], _OUT, _OUT_KINDS)


def repair(spark: SparkSession, original: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conv_id of original: faults, cost, audit and digest of the repaired rows.

    rows: conv_id, turn, role, text, none null but conv_id and turn; those of no conversation in original yield a row too.
    """
    work = Work(spark, "repair")
    order = ["conv_id", "turn", "role", "text"]
    placed = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    # the upper bits of pos number the partition, so no block reaches over two
    placed = work.save(placed.withColumn("block", F.expr(f"pos div {block}")))
    blocks = _symbols(placed, work)

    spans = blocks.groupBy("conv_id").agg(F.min("block").alias("first"), F.max("block").alias("final"))
    spans = spans.withColumnRenamed("conv_id", "of")
    blocks = blocks.join(spans, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    blocks = work.save(blocks.withColumn("last", F.col("block") == F.col("final")).withColumn("only", F.col("first") == F.col("final")).drop("first", "final"))
    single = blocks.where("only").select("conv_id", "block", "symbols", F.lit(None).cast("array<long>").alias("behind"), "last", "only")
    chained = blocks.where("NOT only")
    steps = chained.select("conv_id", "block", "symbols").mapInArrow(_matrices, "conv_id long, block long, costs array<long>")
    behind = steps.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(_costs_behind, "conv_id long, block long, behind array<long>")
    behind = behind.toDF("of", "at", "behind")
    chained = chained.join(behind, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).select(*single.columns)
    solved = single.unionByName(chained).mapInArrow(_solved, "conv_id long, block long, symbols string, audits array<string>")

    marks = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    stream = solved.unionByName(placed, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("block"), F.asc_nulls_first("pos"))
    return stream.mapInArrow(_rebuild, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged_and_repaired(spark: SparkSession, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """repair of the conversations (conv_id, turn, role, text) after damage."""
    return repair(spark, conversations, damaged(conversations), block)
