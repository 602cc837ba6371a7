"""Chat formatting from reply trees.

Nodes (tree, node, parent, role, text, score) form trees by tree. Root-to-leaf paths come from iterative
self-joins that double: round k has every leaf's ancestors up to 2**k steps away and joins them with a table
of 2**k-step pointers, so a path of n turns needs log2(n) rounds and no row more than the paths have turns.
Branches are ranked by the sum of their turns' scores, ties by leaf; each chosen branch becomes one conversation in a
template whose control strings are escaped inside roles and texts, with the spans of the assistant's
texts as its loss mask.

Defined results: null roles and texts are empty, null scores 0; a node whose parent is null or not in its tree
is a root; nodes of a cycle have no leaf and give no path; repeated (tree, node) rows are a fault of the input,
so `from_turns` numbers rows itself and keeps repeats and ties as turns of their own (ordered by turn, role,
text); rows with a null conv_id form one conversation whose id is null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm._work import Work

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"


def escape(text: str) -> str:
    """Without `<|` and, for roles, without line ends; `unescape` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation and the starts and ends, in code points, of what the loss is taken on."""
    out, at, starts, ends = [], 0, [], []
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        out += [head, body, f"{END}\n"]
        if role == LEARNT:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), starts, ends


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        turns.append((unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def paths(spark: SparkSession, nodes: DataFrame, work: Work) -> DataFrame:
    """(tree, leaf, node, back) for every node of every root-to-leaf path; back counts steps up from the leaf."""
    step = work.save(nodes.join(nodes.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")))
    leaves = nodes.select("tree", "node").join(step.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    known = work.save(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("back")))
    parts, size = [known], 1
    while not step.isEmpty() and not known.isEmpty():
        more = parts[0]
        for p in parts[1:]:
            more = more.union(p)
        known = work.save(more.join(step, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("back") + size).alias("back")))
        parts.append(known)
        step = work.save(step.join(step.select("tree", F.col("node").alias("up"), F.col("up").alias("far")), ["tree", "up"]).select("tree", "node", F.col("far").alias("up")))
        size *= 2
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            turns = [(x["role"], x["text"]) for x in batch.column("turns")[i].as_py()]
            text, starts, ends = format_turns(turns)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(i, 1) for c in ("tree", "leaf", "score", "branch")), pa.array([text]), pa.array([starts], pa.list_(pa.int32())), pa.array([ends], pa.list_(pa.int32()))],
                ["tree", "leaf", "score", "branch", "formatted", "loss_starts", "loss_ends"],
            )


def conversations(spark: SparkSession, nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, score, branch, formatted, loss_starts, loss_ends): the best `branches` paths of each tree, or all."""
    work = Work(spark, "chat")
    nodes = work.save(
        nodes.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    )
    found = paths(spark, nodes.select("tree", "node", "parent"), work)
    found = found.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    ranked = found.groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    ranked = ranked.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if branches is not None:
        ranked = ranked.where(F.col("branch") <= branches)
    ranked = work.save(ranked)
    turns = found.select("tree", "leaf", "node", "back").join(ranked.select("tree", "leaf"), ["tree", "leaf"], "left_semi").join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    turns = turns.groupBy("tree", "leaf").agg(F.reverse(F.array_sort(F.collect_list(F.struct("back", "role", "text")))).alias("turns"))
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    return turns.join(ranked, ["tree", "leaf"]).select("tree", "leaf", "score", "branch", "turns").mapInArrow(
        _format, f"tree {kinds['tree']}, leaf {kinds['node']}, score double, branch int, formatted string, loss_starts array<int>, loss_ends array<int>"
    )


def from_turns(rows: DataFrame) -> DataFrame:
    """Nodes of linear conversations (conv_id, turn, role, text): each turn answers the one before it."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    out = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "turn", "role", "text")
    out = out.withColumn("node", F.row_number().over(order))
    return out.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        out = []
        for tree, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("tree", "formatted", "loss_starts", "loss_ends")), strict=True):
            turns = read_turns(text)
            learnt = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
            whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            out.append((int(tree) if tree else None, len(turns), whole, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
        cols = zip(*out, strict=True) if out else [()] * len(names)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, taken from the output alone."""
    return formatted.select("tree", "formatted", "loss_starts", "loss_ends").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
