"""License scans: exact phrases by their words, and short notices with a few edits.

Fuzzy search works on each text's normal form (its words, A-Z lower-cased, joined by one space). A notice that
may have k edits is split into k + 1 pieces; at least one of them is unchanged, so exact search for
the pieces finds every candidate place. In a window of bounded size around each, the regex library's bounded-error matching decides and
reports the span and its edits. A match begins and ends at word borders, and the words in brackets, which tell licenses
apart, have no edits; they are spent on the rest. Each place has a window of its own, so no match hides
another and a text of nothing but candidates takes time in proportion to its length.

Defined results: a null or empty text has no words and no label; labels are distinct and sorted; rows are
independent, so repeated rows, repeated or null ids and extra columns change nothing; an empty table gives
an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import _text as T

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}



class Notice(NamedTuple):
    text: str  # words in brackets stand as they are
    label: str
    edits: int  # of single bytes of the normal form
    unless: str = ""  # words, parted by |, of which none may follow


#: Short notices of common licenses.
NOTICES = (
    Notice("released under the [mit] license", "mit", 3),
    Notice("licensed under the [mit] license", "mit", 3),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    Notice("licensed under the apache license version [2]", "apache-2.0", 4),
    Notice("the apache license version [2]", "apache-2.0", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 5),
    Notice("released under the [bsd] license", "bsd", 3),
    Notice("licensed under the [bsd] license", "bsd", 3),
    Notice("released under the [isc] license", "isc", 3),
    Notice("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    Notice("mozilla public license", "mpl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("european union public licence", "eupl", 3),
    Notice("boost software license", "bsl-1.0", 2),
    Notice("gnu general public license", "gpl", 2),
    Notice("general public license", "gpl", 2),
    Notice("gnu [lesser] general public license", "lgpl", 2),
    Notice("gnu [library] general public license", "lgpl", 2),
    Notice("gnu [affero] general public license", "agpl", 2),
    Notice("licensed under cc by [sa]", "cc-by-sa", 2),
    Notice("licensed under cc by [nd]", "cc-by-nd", 2),
    Notice("licensed under cc by [nc]", "cc-by-nc", 2, "sa|nd"),
    Notice("licensed under cc by [nc] [sa]", "cc-by-nc-sa", 2),
    Notice("licensed under cc by [nc] [nd]", "cc-by-nc-nd", 2),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 6),
    Notice("dedicated to the public domain", "public-domain", 3),
    Notice("all rights reserved", "reserved", 1),
)
_SIDE = r"[0-9a-z\x80-\xff]"
_REMEMBERED = 20_000  # windows


class Found(NamedTuple):
    row: int
    label: str
    start: int  # in bytes of the block
    end: int
    edits: int
    share: float  # of the notice that is as it should be


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of the edits + 1 pieces of a notice."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def phrase_starts(w: T.Words, hashes: np.ndarray, phrase: str) -> np.ndarray:
    """Words at which a phrase's words stand, all in one row, checked byte by byte."""
    parts = phrase.encode().split(b" ")
    want = T.words(np.frombuffer(phrase.encode(), np.uint8), np.array([0, len(phrase)]), T.ALNUM)
    n = len(hashes) - len(parts) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    hit = np.ones(n, bool)
    for k, h in enumerate(T.word_hashes(want)):
        hit &= hashes[k : k + n] == h
    at = np.flatnonzero(hit)
    row = np.searchsorted(w.first, at, "right")
    at = at[at + len(parts) <= w.first[row]]
    same = [all(w.data[w.start[i + k] : w.end[i + k]].tobytes() == p for k, p in enumerate(parts)) for i in at]
    return at[np.array(same, bool)] if len(at) else at


def pattern(notice: Notice) -> regex.Pattern:
    """The notice with its edits, the best match first. Beside a bracketed word each part may have all edits; their sum is to be checked."""
    out = ""
    for i, part in enumerate(regex.split(r"\[(\w+)\]", notice.text)):
        if i % 2:
            out += f"(?<!{_SIDE}){part}(?!{_SIDE})"
        elif part:
            out += f"(?:{regex.escape(part)}){{e<={notice.edits}}}" if part != " " else " "
    return regex.compile(f"(?b)(?<!{_SIDE}){out}(?!{_SIDE})" + (f"(?! (?:{notice.unless})(?!{_SIDE}))" if notice.unless else ""))


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = []
        for x in notices:
            plain = x.text.replace("[", "").replace("]", "")
            if len(plain) <= 5 * x.edits + 2:  # two matches beside each other must not fit into one window
                raise ValueError(f"too many edits for its length: {x.text}")
            self.notices.append((plain, x.label, x.edits, [(at, p.encode()) for at, p in pieces(plain, x.edits)], pattern(x), 0 if not x.unless else 1 + max(map(len, x.unless.split("|")))))
        self._known: dict[tuple[int, str], tuple[int, int, int] | None] = {}

    def _match(self, number: int, before: str, window: str) -> tuple[int, int, int] | None:
        """Start, end and edits of the best match in a window, remembered as texts repeat themselves."""
        key = (number, before + window if before else "\n" + window)
        if key not in self._known:
            if len(self._known) >= _REMEMBERED:
                self._known.clear()
            m = self.notices[number][4].search(before + window, len(before))
            n = sum(m.fuzzy_counts) if m else 0
            self._known[key] = (m.start() - len(before), m.end() - len(before), n) if m and n <= self.notices[number][2] else None
        return self._known[key]

    def fuzzy(self, w: T.Words) -> list[Found]:
        """The notices in the rows of a block."""
        inside = T.ALNUM[w.data]
        keep = inside.copy()
        keep[w.end[w.end < len(keep)]] = True  # the first byte after a word becomes the space
        at = np.flatnonzero(keep)
        text = np.where(inside[at], w.data[at], 0x20).astype(np.uint8).tobytes()
        rows = np.searchsorted(at, w.rows).tolist()
        found = []
        for number, (notice, label, edits, parts, _, further) in enumerate(self.notices):
            places: set[tuple[int, int]] = set()
            for offset, piece in parts:
                i = -1
                while (i := text.find(piece, i + 1)) >= 0:
                    row = bisect_right(rows, i) - 1
                    if i + len(piece) <= rows[row + 1]:
                        places.add((row, i - offset))
            matches: set[tuple[int, int, int, int]] = set()
            for row, place in places:
                a = max(rows[row], place - edits)
                b = min(rows[row + 1], place + len(notice) + 2 * edits + 1 + further)
                # Latin-1 keeps one character for a byte
                if m := self._match(number, text[max(rows[row], a - 1) : a].decode("latin-1"), text[a:b].decode("latin-1")):
                    matches.add((m[2], row, a + m[0], a + m[1]))
            taken: list[tuple[int, int]] = []
            for n, row, s, e in sorted(matches):
                k = bisect_right(taken, (s, e))
                if (k and taken[k - 1][1] > s) or (k < len(taken) and taken[k][0] < e):
                    continue  # a better match of the same notice holds part of it
                taken.insert(k, (s, e))
                found.append(Found(row, label, int(at[s]), int(at[e - 1]) + 1, n, 1 - n / len(notice)))
        return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        for i, j, data, rows in T.blocks(batch.column(1)):
            w = T.words(data, rows, T.ALNUM)
            h, n = T.word_hashes(w), j - i
            count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            best = np.zeros(n)
            for phrase, label in BASE.items():
                at = phrase_starts(w, h, phrase)
                row = np.searchsorted(w.first, at, "right") - 1
                np.add.at(count, row, 1)
                np.minimum.at(first, row, at - w.first[row])
                np.maximum.at(last, row, at - w.first[row])
                for r in set(row.tolist()):
                    base[r].add(label)
                    best[r] = 1.0
            every = [set(x) for x in base]
            for f in scanner.fuzzy(w):
                every[f.row].add(f.label)
                best[f.row] = max(best[f.row], f.share)
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, n),
                    pa.array(np.diff(w.first)),
                    pa.array(count),
                    pa.array(first, mask=none),
                    pa.array(last, mask=none),
                    pa.array([",".join(sorted(x)) for x in base]),
                    pa.array([",".join(sorted(x)) for x in every]),
                    pa.array(best),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def license_labels(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): word and phrase counts, labels and the best match's score."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        for i, _, data, rows in T.blocks(batch.column(1)):
            w = T.words(data, rows, T.ALNUM)
            ids = batch.column(0)
            out = []
            for f in scanner.fuzzy(w):
                begin = int(rows[f.row])
                chars = np.cumsum((data[begin : f.end] & 0xC0) != 0x80)
                s = int(chars[f.start - begin]) - 1
                out.append((ids[i + f.row].as_py(), f.label, s, int(chars[-1]), f.edits, data[f.start : f.end].tobytes().decode("utf-8", "replace")))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "label", "start", "end", "edits", "matched"])


def license_spans(docs: DataFrame) -> DataFrame:
    """Every fuzzy match: its label, its span in code points, its edits and its text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_spans, "doc_id long, label string, start long, end long, edits int, matched string")
