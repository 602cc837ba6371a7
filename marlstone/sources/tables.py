"""Readers: the shared tables and the file formats that reviews and corpora come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPED = ("node_modules", "vendor", "dist", "build", ".git", "__pycache__", "venv", "site-packages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row a line: the other columns, n from 1 and line. A final line end starts no line of its own."""
    parts = F.split(F.regexp_replace(text, r"\n$", ""), "\n", -1)
    others = [c for c in texts.columns if c != text]
    return texts.where(F.col(text).isNotNull() & (F.col(text) != "")).select(*others, F.posexplode(parts).alias("i", "line")).select(*others, (F.col("i") + 1).alias("n"), "line")


def all_lines(text: Column) -> Column:
    """The lines of a text at every line end that Unicode knows; a final one starts no line."""
    parts = F.split(text, r"\R|[\x1c-\x1e]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def list_files(paths: DataFrame, path: str, limit: int, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Paths in order without those below a skipped folder, at most limit, and whether there were more."""
    kept = paths.where(~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, skip)))).orderBy(path).limit(limit + 1)
    more = kept.agg(F.count(F.lit(1)).alias("total"))
    return kept.orderBy(path).limit(limit).crossJoin(F.broadcast(more)).withColumn("truncated", F.col("total") > limit).drop("total")


def source_files(spark: SparkSession, root: str, pattern: str = "*.py", most_bytes: int = 1 << 20) -> DataFrame:
    """(path, text, sha256) of text files below a folder; large files and files with a NUL in their first 4096 bytes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    head = F.substring("content", 1, 4096)
    known = files.where((F.col("length") <= most_bytes) & ~F.hex(head).rlike("^(..)*?00"))
    return known.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))


def is_source(path: Column | str) -> Column:
    """Whether a path is Python source of the project itself: in no vendored, hidden or test folder and no test."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    name, above = F.element_at(parts, -1), F.slice(parts, F.lit(1), F.size(parts) - 1)
    skipped = F.arrays_overlap(above, F.array(*map(F.lit, (*SKIPPED, "test", "tests"))))
    return F.endswith(name, F.lit(".py")) & ~F.startswith(name, F.lit("test_")) & ~skipped


# Lines of a window, characters of a line, and what stands for the rest of it.
WINDOW_LINES, LINE_CHARS, LINE_CUT = 120, 400, " \u2026[line truncated]"


def read_windows(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests (request_id, path, start, end) of files (path, text) with status, total_lines, sha256, line_end, long_lines and shown.

    A window ends at the file's end or after WINDOW_LINES; lines are cut at LINE_CHARS and counted in long_lines. No file, a NUL in its
    first 4096 characters, a start beyond its end and a window that ends before it starts are statuses without text. An empty file has no lines.
    """
    head = F.substring("text", 1, 4096)
    ls = F.when(F.coalesce("text", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace("text", r"\n$", ""), "\n", -1))
    have = files.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.contains(F.coalesce(head, F.lit("")), F.lit("\x00")).alias("_binary"), ls.alias("_ls"))
    x = requests.join(have, "path", "left").withColumn("total_lines", F.size("_ls"))
    last = F.least(F.coalesce("end", F.col("start") + WINDOW_LINES - 1), F.col("start") + WINDOW_LINES - 1, "total_lines")
    status = F.when(F.col("_ls").isNull(), "no_file").when(F.col("_binary"), "binary").when(F.coalesce("end", "start") < F.col("start"), "bad_range").when(F.col("start") > F.col("total_lines"), "beyond_end").otherwise("ok")
    x = x.withColumn("status", status).withColumn("line_end", F.when(F.col("status") == "ok", last))
    part = F.slice("_ls", F.col("start"), F.col("line_end") - F.col("start") + 1)
    shown = F.transform(part, lambda s: F.when(F.length(s) > LINE_CHARS, F.concat(F.substring(s, 1, LINE_CHARS), F.lit(LINE_CUT))).otherwise(s))
    long_lines = F.size(F.filter(part, lambda s: F.length(s) > LINE_CHARS))
    ok = F.col("status") == "ok"
    return x.select("request_id", "path", "status", F.when(F.col("_ls").isNotNull(), F.col("total_lines")).alias("total_lines"), "sha256", "line_end", F.when(ok, long_lines).alias("long_lines"), F.when(ok, F.array_join(shown, "\n")).alias("shown"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; rows that do not fit fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines in a folder, null fields written out; what was there is replaced."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def word_lists(files: DataFrame, keys: tuple[str, ...] = ("sources", "sanitizers", "sql_sinks", "file_sinks"), most: int = 50) -> DataFrame:
    """(app, key, ord, word): the first words of each named list in a project's settings (app, text), written in YAML; settings that do not parse count as none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            rows = []
            for app, text in zip(pdf["app"], pdf["text"], strict=True):
                try:
                    found = yaml.safe_load(text or "")
                except yaml.YAMLError:
                    continue
                for k in keys if isinstance(found, dict) else ():
                    listed = found.get(k)
                    rows += [(app, k, i, str(w)) for i, w in enumerate(listed[:most] if isinstance(listed, list) else [])]
            yield pd.DataFrame(rows, columns=["app", "key", "ord", "word"])

    return files.select("app", "text").mapInPandas(run, "app string, key string, ord int, word string")


def weaknesses(spark: SparkSession, path: str) -> DataFrame:
    """Weakness entries of a catalogue in XML, white space normalised, nested lists as arrays of structs."""
    schema = T.StructType.fromDDL(
        "_ID string, _Name string, _Abstraction string, Description string, Extended_Description string, "
        "Related_Weaknesses struct<Related_Weakness: array<struct<_CWE_ID: string, _Nature: string>>>, "
        "Common_Consequences struct<Consequence: array<struct<Scope: array<string>, Impact: array<string>>>>"
    )
    rows = spark.read.format("xml").option("rowTag", "Weakness").schema(schema).load(path)
    tidy = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    related = F.col("Related_Weaknesses.Related_Weakness")
    return rows.select(
        F.concat(F.lit("CWE-"), "_ID").alias("id"), tidy("_Name").alias("name"), tidy("Description").alias("description"), tidy("Extended_Description").alias("extended"),
        F.transform(related, lambda r: F.struct(r["_Nature"].alias("nature"), F.concat(F.lit("CWE-"), r["_CWE_ID"]).alias("id"))).alias("related"),
        F.col("Common_Consequences.Consequence").alias("consequences"),
    )


def scanner_findings(raw: DataFrame, kind: str, families: dict[str, str]) -> DataFrame:
    """Results of a static scanner, one JSON document a row in `json`, in one schema."""
    family = F.create_map(*(F.lit(x) for kv in families.items() for x in kv))
    if kind == "rules":
        row = "struct<results: array<struct<check_id: string, path: string, start: struct<line: int>, end: struct<line: int>, extra: struct<message: string, severity: string>>>>"
        r = raw.select(F.explode(F.from_json("json", row)["results"]).alias("r"))
        rule = F.element_at(F.split("r.check_id", r"\."), -1)
        return r.select(rule.alias("rule_id"), family[rule].alias("family"), F.col("r.path").alias("file"), F.col("r.start.line").alias("line_start"), F.col("r.end.line").alias("line_end"), F.col("r.extra.severity").alias("severity"), F.col("r.extra.message").alias("message"))
    row = "struct<results: array<struct<test_id: string, filename: string, line_range: array<int>, line_number: int, issue_severity: string, issue_text: string>>>"
    r = raw.select(F.explode(F.from_json("json", row)["results"]).alias("r"))
    lo, hi = F.coalesce(F.array_min("r.line_range"), "r.line_number"), F.coalesce(F.array_max("r.line_range"), "r.line_number")
    return r.select(F.col("r.test_id").alias("rule_id"), family[F.col("r.test_id")].alias("family"), F.col("r.filename").alias("file"), lo.alias("line_start"), hi.alias("line_end"), F.col("r.issue_severity").alias("severity"), F.col("r.issue_text").alias("message"))


def scan_union(a: DataFrame, b: DataFrame, cap: int = 100) -> DataFrame:
    """Both scanners' findings in order of place, at most cap."""
    both = a.withColumn("scanner", F.lit("rules")).unionByName(b.withColumn("scanner", F.lit("lint")))
    return both.orderBy("file", "line_start", "scanner", "rule_id").limit(cap)


def label_cases(entries: DataFrame, families: dict[str, str], pad: int = 8) -> DataFrame:
    """Labelled entries to cases: family of the first known weakness id, lines padded and cut at 1."""
    family = F.create_map(*(F.lit(x) for kv in families.items() for x in kv))
    ids = F.concat(F.array("primary_cwe"), F.coalesce("acceptable_cwes", F.array().cast("array<string>")))
    found = F.get(F.filter(F.transform(ids, lambda c: F.try_element_at(family, c)), lambda f: f.isNotNull()), F.lit(0))
    return entries.withColumn("family", found).withColumn("lo", F.greatest(F.lit(1), F.col("line_start") - pad)).withColumn("hi", F.coalesce("line_end", "line_start") + pad)


def pair_cases(entries: DataFrame) -> DataFrame:
    """Each advisory with its ranges before and after the fix becomes a vulnerable and a safe case."""
    sides = F.array(F.struct(F.lit(True).alias("vulnerable"), F.col("vulnerable_ranges").alias("ranges")), F.struct(F.lit(False).alias("vulnerable"), F.col("fixed_ranges").alias("ranges")))
    return entries.withColumn("side", F.explode(sides)).select("id", "family", "path", "side.*")
