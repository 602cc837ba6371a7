"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that do not show: zero width, direction marks, tags.
HIDDEN = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{E0000}-\x{E007F}]"


def tidy(c: Column | str) -> Column:
    """ASCII white space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0b]+", " "))


def sha256(c: Column | str) -> Column:
    return F.sha2(c, 256)


def dev_half(key: Column) -> Column:
    """A split that stays: the first hex digit of the lower-cased key's digest is even."""
    return F.conv(F.substring(F.sha2(F.lower(key), 256), 1, 1), 16, 10).cast("int") % 2 == 0


def query_tokens(c: Column | str) -> Column:
    """Distinct runs of letters and digits of two or more, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)")), lambda t: F.length(t) > 1))


def cwe_id(c: Column | str) -> Column:
    """`89`, `cwe_89`, `Cwe 89` to `CWE-89`; anything else stays as it is, tidied."""
    t = F.trim(c)
    digits = F.regexp_extract(t, r"^(?i:cwe[-_ ]?)?([0-9]+)$", 1)
    return F.when(digits != "", F.concat(F.lit("CWE-"), digits)).otherwise(t)


def cwe_number(c: Column | str) -> Column:
    return F.regexp_extract(c, r"([0-9]+)$", 1).cast("int")


def neutral(c: Column | str) -> Column:
    """Markdown and HTML lose their force; the order of the replacements matters."""
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("`", "'"), ("![", "!\\["), ("](", "\\]("), ("|", "\\|")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: Characters of the tag block, and characters that are not seen.
TAGS = r"\x{E0000}-\x{E007F}"
UNSEEN = r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}"


def reveal(c: Column | str) -> Column:
    """Hidden characters made visible: each by its code point, runs of tag characters by their length, as they may spell out text."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.regexp_extract_all(c, F.lit(f"([{TAGS}]+|[{UNSEEN}]|[^{TAGS}{UNSEEN}]+)"))
    shown = F.transform(
        parts,
        lambda p: F.when(p.rlike(f"^[{TAGS}]"), F.concat(F.lit("["), F.length(p).cast("string"), F.lit(" hidden unicode tag characters removed]")))
        .when(p.rlike(f"^[{UNSEEN}]"), F.concat(F.lit("[U+"), F.lpad(F.hex(F.ascii(p)), 4, "0"), F.lit("]")))
        .otherwise(p),
    )
    return F.when(c.rlike(f"[{TAGS}{UNSEEN}]"), F.array_join(shown, "")).otherwise(c)


def fence(c: Column | str) -> Column:
    """Length of the fence that a quotation needs: one more than its longest run of backticks, three at least."""
    return F.greatest(F.lit(3), 1 + F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(`+)")), F.length)), F.lit(0)))


def line_of(text: Column, offset: Column) -> Column:
    """The line of a character, both from 1."""
    return F.length(F.substring(text, F.lit(1), offset - 1)) - F.length(F.replace(F.substring(text, F.lit(1), offset - 1), F.lit("\n"), F.lit(""))) + 1


def excerpt_seen(excerpt: Column, observed: Column) -> Column:
    """Whether every piece of an excerpt (cut at line ends and dots of omission) stands in the text; false if there is none, null if the text is unknown."""
    pieces = F.filter(F.transform(F.split(excerpt, r"\n|…|\.\.\."), tidy), lambda p: p != "")
    seen = tidy(observed)
    return F.when(observed.isNotNull(), (F.size(pieces) > 0) & F.forall(pieces, lambda p: F.contains(seen, p)))


def path_params(c: Column | str) -> Column:
    """Names of `<type:name>` and `{name}` parts of a route."""
    angle = F.transform(F.regexp_extract_all(c, F.lit("<([^<>]+)>")), lambda x: F.element_at(F.split(x, ":"), -1))
    brace = F.transform(F.regexp_extract_all(c, F.lit(r"\{([^{}]+)\}")), lambda x: F.element_at(F.split(x, ":"), 1))
    return F.concat(angle, brace)


def hunks(c: Column | str) -> Column:
    """Ranges of a diff's hunk heads: array of (old_start, old_end, new_start, new_end); a missing length is 1."""
    heads = F.regexp_extract_all(c, F.lit(r"(@@ -[0-9]+(?:,[0-9]+)? \+[0-9]+(?:,[0-9]+)? @@)"))

    def one(h: Column) -> Column:
        g = lambda i: F.regexp_extract(h, r"@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@", i)
        n = lambda i: F.when(g(i) == "", F.lit(1)).otherwise(g(i).try_cast("int"))
        end = lambda a, b: F.greatest(n(a), n(a) + n(b) - 1)
        return F.struct(n(1).alias("old_start"), end(1, 2).alias("old_end"), n(3).alias("new_start"), end(3, 4).alias("new_end"))

    return F.transform(heads, one)


def numbered(n: Column, line: Column) -> Column:
    return F.format_string("%5d| %s", n, line)


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    """Null if either is, 0 if both are 0."""
    return F.when(precision.isNotNull() & recall.isNotNull(), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share's interval, within 0 and 1; null for n = 0."""
    m = F.when(n > 0, n.cast("double"))
    p = k / m
    middle = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def clipped_sigmoid(x: Column, bound: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-bound), F.least(F.lit(bound), x))))


def in_scope(path: Column, root: str) -> Column:
    """Whether a path, with its dots resolved, lies below the root; compared part by part, never as a prefix of the string."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    full = F.when(F.startswith(path, F.lit("/")), parts).otherwise(F.concat(F.split(F.lit(root), "/"), parts))
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    done = F.aggregate(full, F.array().cast("array<string>"), step)
    base = [x for x in root.split("/") if x]
    bad = F.contains(path, F.lit("\x00")) | path.rlike("^[A-Za-z]:") | (path == "")
    return F.coalesce(~bad & (F.slice(done, 1, len(base)) == F.array(*map(F.lit, base))), F.lit(False))
