"""Byte-level BPE as a bounded-lookahead streaming transducer.

The encoder reads bytes from left to right and keeps, for every position, the last token of the encoding of
the prefix that ends there: the one token that ends at this position and may stand after the last token of
the prefix before it. Two tokens may stand side by side if the merge list would not have joined across
their border. A token is emitted once no later byte can change it: when the back pointers of the newest
positions, as many as the longest token has bytes, have all met in its end. `lookahead` bounds how far that
may lag: a later byte changes tokens leftwards only along a chain of merges in which each next one ends in
what the former begins with and stands later in the list; the longest such chain in bytes, found by
one pass over the list, is sufficient. So memory beside the text is constant for pieces of any length: those of more than
LONG characters are fed in parts and their ids come in bounded lists; shorter ones are remembered whole.

Decoding is a state machine from token bytes to text that holds back an incomplete character.

Defined results: a null text is the empty text, which has no tokens; rows are independent, so repeated rows
and ids, null ids and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the tokenizer format: its pre-token pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
CACHE = 400_000  # pieces whose tokens a worker remembers
PIECES = 1 << 16  # pieces of a text, or ids of a long piece, that are in hand at once
LONG = 4096
_MODELS: dict[str, BPE] = {}


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a vocabulary file: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class BPE(dict):
    """Tables of one vocabulary. As a dict: piece of text to its token ids, filled on demand."""

    def __init__(self, model: bytes):
        super().__init__()
        j = json.loads(model)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {as_bytes(t): i for t, i in j["model"]["vocab"].items() if all(c in letters for c in t)}
        special = {t["content"]: t["id"] for t in j["added_tokens"]}
        for t in special:
            vocab.pop(t.encode(), None)
        size = max([*vocab.values(), *special.values()]) + 1
        self.special = special
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.bytes_of = [b""] * size
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for t, i in special.items():
            self.bytes_of[i] = t.encode()
        self.width = list(map(len, self.bytes_of))
        self.text_of = [str(i) for i in range(size)]
        #: A token's place in the merge list (0 for single bytes), and the two tokens it was merged from.
        self.rank, self.parts, self.joined = [0] * size, [None] * size, {}
        self.by_bytes: dict[bytes, int] = {bytes([b]): vocab[bytes([b])] for b in range(256) if bytes([b]) in vocab}
        reach: dict[int, int] = {}
        self.lookahead = 1
        for place, m in enumerate(j["model"]["merges"], 1):
            left, right = map(as_bytes, m if isinstance(m, list) else m.split(" "))
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.joined[a, b] = c
            if not self.parts[c]:
                self.rank[c], self.parts[c] = place, (a, b)
                self.by_bytes[left + right] = c
            reach[a] = max(reach.get(a, 0), len(left) + max(reach.get(b, 0), len(right)))
            self.lookahead = max(self.lookahead, reach[a])
        self.longest = max(map(len, self.by_bytes))
        self._automaton()
        self.lookahead += self.longest
        self.pattern = regex.compile(PATTERN)
        self._beside: dict[int, bool] = {}

    def beside(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes in a row is just a, b."""
        if len(self._beside) > 250_000:
            self._beside.clear()
        known = self._beside[a << 20 | b] = self._settle(a, b)
        return known

    def _settle(self, a: int, b: int) -> bool:
        """Undo the two tokens' merges at their border, latest first; a merge across it that comes before the one just undone would have won."""
        rank, parts, joined = self.rank, self.parts, self.joined
        limit = len(rank) + 1  # only merges placed before it apply; ties go to the left one
        while True:
            c = joined.get((a, b))
            if c is not None and rank[c] < limit:
                return False
            if parts[a] is None and parts[b] is None:
                return True
            if rank[a] > rank[b] or parts[b] is None:
                limit, a = rank[a], parts[a][1]
            else:
                limit, b = rank[b] + 1, parts[b][0]

    def _automaton(self) -> None:
        """Suffix automaton of the tokens: step, the longest token that ends in a state, and each token's next shorter suffix."""
        self.step: dict[int, int] = {}  # state << 8 | byte
        self.fail, own, bytes_in = [0], [-1], [0]
        for b, t in self.by_bytes.items():
            state = 0
            for x in b:
                state = self.step.setdefault(state << 8 | x, len(self.fail))
                if state == len(self.fail):
                    self.fail.append(0)
                    own.append(-1)
                    bytes_in.append(0)
            own[state] = t
        children: dict[int, list[tuple[int, int]]] = {}
        for key, state in self.step.items():
            children.setdefault(key >> 8, []).append((key & 255, state))
        self.ends, self.shorter = [-1] * len(self.fail), [-1] * len(self.width)
        queue = [0]
        for state in queue:
            for x, child in children.get(state, ()):
                f = self.fail[state]
                while state and f and (f << 8 | x) not in self.step:
                    f = self.fail[f]
                self.fail[child] = self.step.get(f << 8 | x, 0) if state else 0
                below = self.ends[self.fail[child]]
                self.ends[child] = own[child] if own[child] >= 0 else below
                if own[child] >= 0:
                    self.shorter[own[child]] = below
                queue.append(child)
        self.tree = len(self.step)

    def _leap(self, state: int, x: int) -> int:
        """A step that falls back; remembered as long as there is room."""
        at = state
        while at and (at << 8 | x) not in self.step:
            at = self.fail[at]
        out = self.step.get(at << 8 | x, 0)
        if len(self.step) < self.tree + 150_000:
            self.step[state << 8 | x] = out
        return out

    def _extend(self, held: bytes, last: list[int], state: int = 0) -> int:
        """Append the last token of each prefix of held that last does not have yet; state is the automaton's after last."""
        step, ends, width, seen, shorter, add = self.step.get, self.ends, self.width, self._beside.get, self.shorter, last.append
        i = len(last)
        for x in held[i - 1 :]:
            n = step(state << 8 | x)
            state = self._leap(state, x) if n is None else n
            t = ends[state]
            while (p := last[i - width[t]]) >= 0 and not ((ok := seen(p << 20 | t)) or (ok is None and self.beside(p, t))):
                t = shorter[t]
            add(t)
            i += 1
        return state

    def _back(self, last: list[int], at: int) -> list[int]:
        """The tokens of the prefix that ends at a position."""
        out, width = [], self.width
        while at > 0:
            out.append(t := last[at])
            at -= width[t]
        return out[::-1]

    def tokens(self, stream: Iterable[bytes]) -> Iterator[int]:
        """The ids of one piece whose bytes come in parts, each as soon as it is stable."""
        held, last, state = b"", [-1], 0  # last[i]: last token of the prefix that ends i bytes into held; -1 where emitted tokens end
        for part in stream:
            for k in range(0, len(part), 4096):
                held += part[k : k + 4096]
                state = self._extend(held, last, state)
                if len(held) > self.lookahead + self.longest:
                    out = self._back(last, self._stable(last))
                    yield from out
                    cut = sum(self.width[t] for t in out)
                    held, last = held[cut:], [*last[cut:]]
        yield from self._back(last, len(held))

    def _stable(self, last: list[int]) -> int:
        """The last position that the back pointers of all the newest positions, and so of all later ones, go through."""
        at = limit = len(last) - 1
        chain = set()
        while at > 0:
            chain.add(at)
            at -= self.width[last[at]]
        for at in range(limit - 1, max(0, limit - self.longest), -1):
            while at > 0 and at not in chain:
                at -= self.width[last[at]]
            limit = min(limit, at)
        return limit

    def __missing__(self, piece: str) -> tuple[int, ...]:
        held, last = piece.encode(), [-1]
        if len(held) <= self.lookahead:
            self._extend(held, last)
            out = tuple(self._back(last, len(held)))
        else:
            out = tuple(self.tokens((held,)))
        if len(self) >= CACHE:
            self.clear()
        if len(piece) <= 64:
            self[piece] = out
        return out

    def runs(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, in bounded lists."""
        for part in self.splitter.split(text) if self.splitter else [text]:
            if part in self.special:
                yield [self.special[part]]
            elif len(part) <= LONG:
                if part:
                    yield list(chain.from_iterable(map(self.__getitem__, self.pattern.findall(part))))
            else:
                found = (m[0] for m in self.pattern.finditer(part)) if len(part) > PIECES else iter(self.pattern.findall(part))
                while some := list(islice(found, PIECES)):
                    for long, group in groupby(some, lambda p: len(p) > LONG):
                        if not long:
                            yield list(chain.from_iterable(map(self.__getitem__, group)))
                        for piece in group if long else ():
                            ids = self.tokens(piece[i : i + LONG].encode() for i in range(0, len(piece), LONG))
                            while few := list(islice(ids, PIECES)):
                                yield few

    def decoder(self) -> Decoder:
        return Decoder(self)


class Decoder:
    """Ids in, text out; bytes of an unfinished character are kept for the next call."""

    def __init__(self, model: BPE):
        self.table, self.state = model.bytes_of.__getitem__, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], end: bool = False) -> str:
        return self.state.decode(b"".join(map(self.table, ids)), end)


def load(model: bytes) -> BPE:
    key = hashlib.md5(model).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = BPE(model)
    return _MODELS[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def digest(model: BPE, text: str) -> tuple[int, str, str]:
    """Number of tokens, digest of the ids and digest of the decoded text."""
    n, ids_hash, text_hash, back, name = 0, hashlib.sha256(), hashlib.sha256(), model.decoder(), model.text_of.__getitem__
    for ids in model.runs(text):
        ids_hash.update((("," if n else "") + ",".join(map(name, ids))).encode())
        text_hash.update(back.feed(ids).encode())
        n += len(ids)
    text_hash.update(back.feed((), True).encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def encode_decode(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs (doc_id, text).

    path names the vocabulary file on the driver; its content (a few MB, whatever the corpus) is broadcast.
    """
    shared = spark.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        for batch in batches:
            rows = [digest(model, x.as_py() or "") for x in batch.column(1)]
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) with the token ids: (doc_id, ids array<int>)."""
    shared = spark.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = list(chain.from_iterable(model.runs(batch.column(1)[i].as_py() or "")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(spark: SparkSession, tokens: DataFrame, path: str) -> DataFrame:
    """The texts of encode()'s rows: (doc_id, text)."""
    shared = spark.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        for batch in batches:
            texts = [model.decoder().feed(x or (), True) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
