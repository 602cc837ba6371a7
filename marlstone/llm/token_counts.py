"""Edit-aware token counts.

A document's pre-tokens stand in slots, each with its part of the text; a segment tree over the slots holds the characters and tokens below each
node. An edit finds its slot by descending along the character sums, reads pre-tokens again from a little
before the edit (`context` characters: as far as the pattern looks ahead, or the vocabulary's longest special token) until a
border falls on an old one, encodes just those pieces, and updates the sums on the slots' paths to the root.
So an edit costs its own length, the slots it touches and the tree's height, not the document's length. Only when edits have put
FULL pre-tokens into one slot is the tree built again, from the counts it has.

Edits of a document apply in their order, each to the text that the former left; `at` and `remove` count
code points and are cut to the text. Defined results: a null text is empty, a null insert inserts nothing, null
numbers are 0; rows are independent, so repeated rows, repeated or null ids and extra columns change nothing;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.bpe import BPE, load, model_bytes

LOOKAHEAD = 4  # characters beyond a pre-token that the pattern may look at, rounded up
SLOT = 64  # pre-tokens in a slot when a tree is built
FULL = 16 * SLOT  # a slot with more makes its tree be built again


class CountTree:
    """Token counts of one text under edits."""

    def __init__(self, model: BPE, text: str):
        self.model, self.encoded = model, 0
        self.context = max([LOOKAHEAD, *map(len, model.special)])
        pieces: list[tuple[int, int]] = []
        for part in model.splitter.split(text) if model.splitter else [text]:
            if part in model.special:
                pieces.append((len(part), 1))
            else:
                found = model.pattern.findall(part)
                pieces += zip(map(len, found), map(len, map(model.__getitem__, found)), strict=True)
        self._build(pieces, text)

    @property
    def text(self) -> str:
        return "".join(self.texts)

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _count(self, piece: str) -> int:
        return 1 if piece in self.model.special else len(self.model[piece])

    def _build(self, pieces: list[tuple[int, int]], text: str) -> None:
        self.slots = [pieces[i : i + SLOT] for i in range(0, len(pieces), SLOT)] or [[]]
        self.size = 1 << (len(self.slots) - 1).bit_length()
        self.chars, self.tokens, self.texts = [0] * (2 * self.size), [0] * (2 * self.size), []
        at = 0
        for k, slot in enumerate(self.slots):
            n = sum(c for c, _ in slot)
            self.texts.append(text[at : at + n])
            at += n
            self.chars[self.size + k], self.tokens[self.size + k] = n, sum(t for _, t in slot)
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _set(self, slot: int, pieces: list[tuple[int, int]], text: str) -> None:
        self.slots[slot], self.texts[slot] = pieces, text
        k = self.size + slot
        self.chars[k], self.tokens[k] = len(text), sum(t for _, t in pieces)
        while k := k // 2:
            self._sum(k)

    def _find(self, at: int) -> tuple[int, int]:
        """The slot that holds a character, and where it starts."""
        k, begin = 1, 0
        while k < self.size:
            k *= 2
            if begin + self.chars[k] <= at and self.chars[k + 1]:
                begin += self.chars[k]
                k += 1
        return k - self.size, begin

    def _next(self, text: str, at: int, special: list[int]) -> int:
        """The end of the pre-token that starts at a place; `special` is the next special token's span, kept between calls."""
        if self.model.splitter and special[1] <= at < special[2]:
            m = self.model.splitter.search(text, at)
            special[:2] = m.span() if m else (len(text), len(text))
        if at == special[0] < special[1]:
            return special[1]
        return self.model.pattern.match(text, at, special[0]).end()

    def edit(self, at: int, remove: int, insert: str) -> None:
        at = min(max(0, at), self.length)
        remove = min(max(0, remove), self.length - at)
        if not remove and not insert:
            return
        slot, begin = self._find(max(0, at - self.context))
        kept, start = [], 0  # places count from the slot's start from here on
        at -= begin
        for piece in self.slots[slot]:
            if start + piece[0] + self.context > at:
                break
            kept.append(piece)
            start += piece[0]
        last, parts, old = slot, [self.texts[slot]], list(self.slots[slot])
        n = len(parts[0])
        while n < at + remove + self.context and last + 1 < len(self.slots):
            last += 1
            parts.append(self.texts[last])
            old += self.slots[last]
            n += len(parts[-1])
        was = "".join(parts)
        text = was[:at] + insert + was[at + remove :]
        shift, fresh = len(insert) - remove, []
        index, border, new = len(kept), start, start  # the old piece that starts at border; the end of the fresh ones
        special = [0, 0, len(text) + 1]  # span of the next special token, and up to where it was looked for
        special[:2] = (len(text), len(text)) if not self.model.splitter else (start, start)
        while True:
            while border + shift < new and index < len(old):
                border += old[index][0]
                index += 1
            if new >= at + len(insert) and border >= at + remove and border + shift == new:
                break
            if new == len(text) and last + 1 == len(self.slots):
                break
            end = self._next(text, new, special) if new < len(text) else new
            if end + self.context > len(text) and last + 1 < len(self.slots):
                # what follows may change this piece: take in the next slots, twice as much as there is
                goal = 2 * len(text) + self.context
                parts = [text]
                n = len(text)
                while n < goal and last + 1 < len(self.slots):
                    last += 1
                    parts.append(self.texts[last])
                    old += self.slots[last]
                    n += len(parts[-1])
                text = "".join(parts)
                special = [len(text), len(text), len(text) + 1] if not self.model.splitter else [new, new, len(text) + 1]
                continue
            fresh.append((end - new, self._count(text[new:end])))
            self.encoded += end - new
            new = end
        for k in range(slot + 1, last + 1):
            self._set(k, [], "")
        self._set(slot, kept + fresh + old[index:], text)
        if len(self.slots[slot]) > FULL:
            self._build([p for s in self.slots for p in s], self.text)


def edit_counts(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Token counts of docs (doc_id, text, edits array<struct<at, remove, insert>>) before and after their edits.

    Returns doc_id, n_chars, n_tokens, n_edits, n_chars_after, n_tokens_after and encoded_chars, the characters that
    were encoded again for the edits. path names the vocabulary file on the driver.
    """
    shared = spark.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        names = ["doc_id", "n_chars", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "encoded_chars"]
        for batch in batches:
            out = []
            for text, edits in zip(batch.column(1), batch.column(2), strict=True):
                tree = CountTree(model, text.as_py() or "")
                n, before, edits = tree.length, tree.total, edits.as_py() or []
                for e in edits:
                    if e:
                        tree.edit(e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                out.append((n, before, len(edits), tree.length, tree.total, tree.encoded))
            cols = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits")
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_tokens long, n_edits long, n_chars_after long, n_tokens_after long, encoded_chars long")


def edit(at: Column, remove: Column, insert: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), remove.cast("int").alias("remove"), insert.cast("string").alias("insert"))


def three_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits each: a cut in the first third, the text's first characters pasted in its middle, a mark appended."""
    n = F.length(F.coalesce("text", F.lit("")))
    edits = F.array(edit(F.floor(n / 3), F.least(F.lit(20), n), F.lit("")), edit(F.floor(n / 2), F.lit(0), F.substring(F.coalesce("text", F.lit("")), 1, 40)), edit(n + 40, F.lit(0), F.lit(" ok.")))
    return docs.withColumn("edits", edits)
