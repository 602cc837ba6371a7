"""Building a corpus: catalogue entries and cards to chunks, references, manifests and their checks."""

from __future__ import annotations

import ast
import io
import tokenize
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.window import Window

from marlstone.functions.text import cwe_number
from marlstone.operators.ordered import first_wins, split_text
from marlstone.sources.work import settled


def weakness_chunks(entries: DataFrame) -> DataFrame:
    """(id, k, text): an entry's description, then its consequences and its relations as bullets; empty parts are left out."""
    bullets = lambda c, f: F.coalesce(F.array_join(F.transform(c, f), "\n"), F.lit(""))
    parts = F.array(
        F.concat_ws("\n", F.concat_ws(": ", "id", "name"), "description", "extended"),
        bullets("consequences", lambda x: F.concat(F.lit("- "), F.array_join(x["Scope"], ", "), F.lit(": "), F.array_join(x["Impact"], ", "))),
        bullets("related", lambda x: F.concat_ws(" ", F.lit("-"), x["nature"], x["id"])),
    )
    return entries.select("id", F.posexplode(F.filter(parts, lambda p: p != "")).alias("k", "text"))


def card_chunks(cards: DataFrame, sections: list[str]) -> DataFrame:
    """(id, section, text) for each named section of a card (columns of a row) that has text."""
    parts = F.array(*(F.struct(F.lit(s).alias("section"), F.col(s).cast("string").alias("text")) for s in sections))
    return cards.select("id", F.inline(F.filter(parts, lambda p: p["text"].isNotNull() & (F.trim(p["text"]) != ""))))


def references(cards: DataFrame) -> DataFrame:
    """(id, path, ref) of every `refs...` list at any depth of a card (id, json); a text that is no JSON has none.

    Each round opens the objects and lists that the round before left, one level for all cards at once, until none is left.
    """
    explode = cards.sparkSession.tvf.variant_explode
    kind = F.schema_of_variant("value")
    level = cards.select("id", F.lit("").alias("path"), F.try_parse_json("json").alias("node"))
    found = None
    while True:
        inner = level.lateralJoin(explode(F.col("node").outer())).select("id", "path", "pos", "key", "value")
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise("."), "key"))
        inner = settled(inner.select("id", F.concat("path", step).alias("path"), F.coalesce(F.col("key").startswith("refs"), F.lit(False)).alias("named"), "value", kind.alias("kind")).where("kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%'"))
        lists = inner.where("named AND kind LIKE 'ARRAY%'").select("id", "path", F.col("value").alias("list"))
        refs = lists.lateralJoin(explode(F.col("list").outer())).select("id", "path", F.col("value").cast("string").alias("ref"))
        found = refs if found is None else found.unionByName(refs)
        level = inner.where("NOT (named AND kind LIKE 'ARRAY%')").select("id", "path", F.col("value").alias("node"))
        if level.isEmpty():
            return found


def broken_references(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    return refs.join(chunks.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti")


def outside_family(cards: DataFrame, families: DataFrame) -> DataFrame:
    """Cards (id, family, cwe_ids) with ids that their family (family, cwe_ids) does not have."""
    f = families.select("family", F.col("cwe_ids").alias("allowed"))
    return cards.join(f, "family", "left").select("id", F.array_except("cwe_ids", F.coalesce("allowed", F.array().cast("array<string>"))).alias("extra")).where(F.size("extra") > 0)


def family_categories(families: DataFrame, categories: DataFrame) -> DataFrame:
    """(family, category) that share an id: both sides exploded, so it is an equi join."""
    a = families.select("family", F.explode("cwe_ids").alias("cwe"))
    return a.join(categories.select("category", F.explode("cwe_ids").alias("cwe")), "cwe").select("family", "category").distinct()


def wanted(parts: list[DataFrame], known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of any part in numeric order that are known entries, and those that are not."""
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    union = union.distinct()
    return union.join(known, "id", "left_semi").orderBy(cwe_number("id")), union.join(known, "id", "left_anti").orderBy(cwe_number("id"))


def top_list(text: Column, size: int = 25) -> Column:
    """Distinct ids in the order they are named; another number than `size` is an error."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(CWE-\d+)")))
    return F.when(F.size(found) == size, found).otherwise(F.raise_error(F.concat(F.lit("ids found: "), F.size(found).cast("string"))).cast("array<string>"))


def mapped_ids(text: Column, marker: str) -> Column:
    """The ids that a page lists after a marker, by number."""
    after = F.substring(text, F.locate(marker, text) + len(marker), F.length(text))
    numbers = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(after, F.lit(r"CWE-(\d+)")), lambda n: n.cast("int"))))
    return F.when(F.locate(marker, text) > 0, F.transform(numbers, lambda n: F.concat(F.lit("CWE-"), n.cast("string")))).otherwise(F.array().cast("array<string>"))


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk of each content by its order."""
    return first_wins(chunks.withColumn("content_hash", F.sha2("text", 256)), ["content_hash"], ["ord"])


def manifest_faults(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Paths whose digest is not the manifest's (path, sha256), or that are missing or not listed."""
    have = files.select("path", F.sha2("text", 256).alias("found"))
    fault = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("found") != F.col("sha256"), "changed")
    return manifest.join(have, "path", "full_outer").select("path", fault.alias("fault")).where("fault is not null")


def manifest_loci(manifest: DataFrame, known: DataFrame) -> DataFrame:
    """Manifest cases (app, case_id, path, function) with the lines of their functions in code facts; one that is not found raises."""
    spans = known.where("kind = 'function'").select("app", "path", F.col("name").alias("function"), "line_start", "line_end")
    x = manifest.join(spans, ["app", "path", "function"], "left")
    return x.withColumn("line_start", F.when(F.col("line_start").isNull(), F.raise_error(F.concat(F.lit("no such function: "), "function")).cast("int")).otherwise(F.col("line_start")))


def core_split(hits: DataFrame, primary: DataFrame, core: list[str]) -> DataFrame:
    """Hits (app, id) by whether their entry's primary id (app, id, cwe) is in the core set."""
    return hits.join(primary, ["app", "id"]).groupBy(F.col("cwe").isin(*core).alias("core")).agg(F.count(F.lit(1)).alias("n"))


@F.pandas_udf(StringType())
def hidden_report(s: pd.Series) -> pd.Series:
    """Sorted distinct hidden characters with their names."""
    odd = {*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFEFF, *range(0xE0000, 0xE0080)}
    return s.map(lambda t: ", ".join(f"U+{c:04X} {unicodedata.name(chr(c), '?')}" for c in sorted({ord(x) for x in t or ""} & odd)))


@F.pandas_udf(StringType())
def without_comments(s: pd.Series) -> pd.Series:
    """Python source with comments blanked, lines kept; what does not parse stays as it is."""

    def blank(t: str) -> str:
        try:
            ast.parse(t)
            lines = t.splitlines(keepends=True)
            for k in tokenize.generate_tokens(io.StringIO(t).readline):
                if k.type == tokenize.COMMENT:
                    (r, a), (_, b) = k.start, k.end
                    lines[r - 1] = lines[r - 1][:a] + " " * (b - a) + lines[r - 1][b:]
            return "".join(lines)
        except (SyntaxError, ValueError, tokenize.TokenError):
            return t

    return s.map(lambda t: blank(t or ""))


# What stands in place of what was taken out.
COMMENT_MARK = "# [comment removed]"
DOC_MARK = '"""[docstring removed]"""'


_MARKS = ArrayType(StructType().add("kind", StringType()).add("line", IntegerType()).add("last", IntegerType()).add("column", IntegerType()))
_LAYOUT = frozenset((tokenize.STRING, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER))


@F.pandas_udf(_MARKS)
def source_marks(s: pd.Series) -> pd.Series:
    """What stands where in Python source: comments, code, and texts that are statements by themselves; null where tokens cannot be told."""

    def marks(text: str) -> list[dict] | None:
        row = lambda kind, line, last, column: {"kind": kind, "line": line, "last": last, "column": column}
        try:
            tokens = [(t.type, *t.start, t.end[0]) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type not in _LAYOUT]
        except (SyntaxError, tokenize.TokenError):
            return None
        out = [row("comment" if kind == tokenize.COMMENT else "code", line, last, column) for kind, line, column, last in tokens]
        try:
            statements = [n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Expr)]
        except (SyntaxError, ValueError):
            return out
        lines = text.split("\n")
        alone = (n for n in statements if isinstance(getattr(n.value, "value", None), str))
        return out + [row("alone", n.lineno, n.end_lineno, len(lines[n.lineno - 1].encode()[: n.col_offset].decode())) for n in alone]

    return s.map(lambda t: marks(t or ""))


def code_lines(text: Column | str) -> Column:
    """Numbers of the lines that hold anything but comments, strings and layout; null for a text whose tokens cannot be told."""
    # the text as in without_talk, so that both read the marks that are made once
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    code = F.filter(source_marks(text), lambda m: m["kind"] == "code")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(code, lambda m: F.sequence(m["line"], m["last"])))))


def without_talk(text: Column | str) -> Column:
    """Source with marks in place of comments and of texts that stand alone as statements, on the same lines; strings that are used stay, and so does what has no tokens."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    marks = F.coalesce(source_marks(text), F.array().cast(_MARKS))

    def line(marks: Column, t: Column, i: Column) -> Column:
        here = F.filter(marks, lambda m: (m["kind"] != "code") & (m["line"] <= i + 1) & (m["last"] > i))
        # a text that stands alone comes before a comment beside it
        first = F.get(F.array_sort(F.transform(here, lambda m: F.struct(m["kind"].alias("kind"), m["line"].alias("line"), m["column"].alias("column")))), F.lit(0))
        mark = F.when(first["kind"] == "alone", F.lit(DOC_MARK)).otherwise(F.lit(COMMENT_MARK))
        return F.when(first.isNull(), t).when(first["line"] <= i, F.lit("")).otherwise(F.concat(F.substring(t, F.lit(1), first["column"]), mark))

    # marks come from Python and may not stand inside a lambda, so text and marks go in as a list of one
    both = F.array(F.struct(F.split(text, "\n", -1).alias("lines"), marks.alias("marks")))
    done = F.transform(both, lambda x: F.array_join(F.transform(x["lines"], lambda t, i: line(x["marks"], t, i)), "\n"))
    return F.get(done, F.lit(0))


def source_chunks(sections: DataFrame, key: str, limit: int, terms: list[str] | None = None, shortest: int = 80) -> DataFrame:
    """(key, id, title, text, sha256): the chunks of sections (key, section, title, body) of a source.

    Bodies shorter than `shortest` are headings and links and go; the others are packed into parts of at most `limit` characters, of which those
    stay that hold one of the terms, title included. Ids count a source's sections and a section's parts from 0, gaps included.
    """

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_text(t or "", limit))

    w = Window.partitionBy(key).orderBy("section")
    x = sections.select(key, "title", "body", (F.row_number().over(w) - 1).alias("_n"), F.first("title").over(w).alias("_head"))
    x = x.withColumn("body", F.trim(F.regexp_replace("body", r"\n{3,}", "\n\n"), F.lit(" \t\r\n"))).where(F.length("body") >= shortest)
    x = x.select(key, "title", "_n", "_head", F.posexplode(cut("body")).alias("_k", "text"))
    if terms:
        said = F.lower(F.concat_ws(" ", "title", "text"))
        x = x.where(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(said, t)))
    title = F.when(F.col("title") == F.col("_head"), F.col("title")).otherwise(F.concat_ws(" \u2014 ", "_head", "title"))
    return x.select(key, F.format_string("%s#%03d.%d", F.col(key).cast("string"), "_n", "_k").alias("id"), title.alias("title"), "text", F.sha2("text", 256).alias("sha256"))


def wrapped(text: Column, nonce: str) -> Column:
    """A text between marks that it cannot forge: the nonce is taken out of it."""
    return F.concat(F.lit(f"<<{nonce}\n"), F.replace(text, F.lit(nonce), F.lit("")), F.lit(f"\n{nonce}>>"))
