"""Porter's stemmer, from its published rules, as an Arrow UDF over distinct terms."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The rules of steps 2, 3 and 4: ending and replacement.
STEP2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", bli="ble", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate",
    ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble", logi="log",
)
STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[i - 1] == "c") else "c"
    return out


def _m(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


@lru_cache(1 << 16)
def stem(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if "v" in _shape(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _m(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (STEP2, STEP3):
        end = max((e for e in rules if w.endswith(e)), key=len, default=None)
        if end and _m(w[: -len(end)]) > 0:
            w = w[: -len(end)] + rules[end]
    end = max((e for e in STEP4 if w.endswith(e)), key=len, default=None)
    if end and _m(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_m(w[:-1]) > 1 or (_m(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _m(w) > 1:
        w = w[:-1]
    return w


def fold(w: str) -> str:
    """Lower case without accents."""
    if w.isascii():
        return w.lower()
    return "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c))


@lru_cache(1 << 17)
def term(w: str) -> str:
    """A search term: folded and stemmed."""
    return stem(fold(w))


@F.arrow_udf(ArrayType(StringType()))
def stems(tokens: pa.Array) -> pa.Array:
    """Terms of lists of words; each different word of a batch is stemmed once."""
    lists = tokens.cast(pa.list_(pa.string()))
    words = lists.flatten().dictionary_encode()
    known = pa.array([None if w is None else term(w) for w in words.dictionary.to_pylist()], pa.string())
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), known.take(words.indices))
