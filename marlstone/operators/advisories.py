"""Advisories to cases: which are selected, which files and hunks of a fix count, which files would give the answer away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions import text as X

# The family of each weakness, places of commits, and paths and lines that do not count.
FAMILIES = {
    "sql_injection": "CWE-89 CWE-564 CWE-943".split(),
    "path_traversal": "CWE-22 CWE-23 CWE-36 CWE-73".split(),
    "authorization_idor": "CWE-639 CWE-862 CWE-863 CWE-284 CWE-285 CWE-306".split(),
}
COMMIT = r"https://github\.com/([^/\s]+)/([^/\s]+)/commit/([0-9a-f]{7,40})"
TEST_PATH = r"(^|/)(tests?|testing|docs?|examples?|benchmarks?)/|(^|/)(test_[^/]*|[^/]*_test|conftest|setup)\.py$"
VERSION_FILE = r"(^|/)(_?version|__about__|__version__|_meta)\.py$"
IMPORT_LINE = r"(?U)^\s*(import\s|from\s+\S+\s+import\s|$|\)|[\w, ]+,?\s*$)"
HINT_FILE = r"(?i)(^readme|\.md$|\.rst$|^hints?|^solutions?|^walkthrough|^writeup|^docs?$)"

_ADVISORY = "id string, withdrawn string, published string, database_specific struct<cwe_ids: array<string>>, references array<struct<url: string>>"


def selected(raw: DataFrame, year: str, families: dict[str, list[str]] = FAMILIES) -> DataFrame:
    """(id, family, cwes, published, owner, repo, sha, hash, dev) of advisories, one JSON document a row in `json`.

    Taken are those of a year that are not withdrawn, whose weaknesses belong to one family and whose references name one
    commit; of several spellings of it the longest stands, by text where they are equally long. JSON that does not parse is left out.
    """
    a = raw.select(F.from_json("json", _ADVISORY).alias("a")).select("a.*")
    known = F.create_map(*(F.lit(x) for f, ids in families.items() for c in ids for x in (c, f)))
    cwes = F.filter(F.coalesce("database_specific.cwe_ids", F.array().cast("array<string>")), lambda c: F.map_contains_key(known, c))
    urls = F.coalesce(F.transform("references", lambda r: r["url"]), F.array().cast("array<string>"))
    commits = F.transform(F.filter(urls, lambda u: u.rlike(COMMIT)), lambda u: F.struct(F.regexp_extract(u, COMMIT, 3).alias("sha"), F.regexp_extract(u, COMMIT, 1).alias("owner"), F.regexp_extract(u, COMMIT, 2).alias("repo")))
    x = a.withColumn("cwes", F.array_sort(cwes)).withColumn("commits", commits)
    x = x.withColumn("families", F.array_distinct(F.transform("cwes", lambda c: known[c])))
    one_commit = F.size(F.array_distinct(F.transform("commits", lambda c: F.substring(c["sha"], 1, 7)))) == 1
    taken = (F.coalesce("withdrawn", F.lit("")) == "") & F.startswith("published", F.lit(year)) & (F.size("families") == 1) & one_commit
    best = F.array_min(F.transform("commits", lambda c: F.struct((-F.length(c["sha"])).alias("n"), c["owner"].alias("owner"), c["repo"].alias("repo"), c["sha"].alias("sha"))))
    x = x.where(taken).withColumn("c", best).withColumn("repo", F.regexp_replace("c.repo", r"\.git$", ""))
    return x.select(
        "id", F.col("families")[0].alias("family"), "cwes", F.substring("published", 1, 10).alias("published"), "c.owner", "repo", "c.sha", F.sha2("id", 256).alias("hash"),
        X.dev_half(F.concat_ws("/", "c.owner", "repo")).alias("dev"),
    )


def counted_files(changed: DataFrame, most: int = 5) -> DataFrame:
    """changed (id, path) with whether a file counts; none of a fix does that changes more than `most` files of source besides tests and version files."""
    source = F.endswith("path", F.lit(".py")) & ~F.col("path").rlike(TEST_PATH) & ~F.col("path").rlike(VERSION_FILE)
    x = changed.withColumn("_source", source)
    n = F.count_if("_source").over(Window.partitionBy("id"))
    return x.withColumn("counts", F.col("_source") & (n <= most)).drop("_source")


def imports_only(before: Column, after: Column) -> Column:
    """Whether both sides of a hunk, arrays of lines, hold import lines alone: such a hunk is not where the fault is."""
    plain = lambda ls: F.forall(ls, lambda x: x.rlike(IMPORT_LINE))
    return plain(before) & plain(after)


def gives_hint(path: Column | str) -> Column:
    """Whether any part of a path is a file or folder that explains the answer; a licence always stays."""
    parts = F.split(path, "/")
    return F.exists(parts, lambda p: p.rlike(HINT_FILE)) & ~F.startswith(F.upper(F.element_at(parts, -1)), F.lit("LICENSE"))


def slug_title(path: Column | str) -> Column:
    """(code, title) of a file name like `A01_2025-Broken_Access`: `A01:2025` and `Broken Access`."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]+$", "")
    cut = F.split(stem, "-", 2)
    return F.struct(F.replace(cut[0], F.lit("_"), F.lit(":")).alias("code"), F.replace(F.get(cut, F.lit(1)), F.lit("_"), F.lit(" ")).alias("title"))


def ablation(unfiltered: DataFrame, filtered: DataFrame, saved: DataFrame) -> DataFrame:
    """Metrics (app, tp, fp, fn) of a run, of the same run filtered and of a saved run of the verifier, beside each other for applications that all have."""
    side = lambda x, name: x.select("app", F.struct("tp", "fp", "fn").alias(name))
    return side(unfiltered, "unfiltered").join(side(filtered, "filtered"), "app").join(side(saved, "verifier"), "app")


def speeds(runs: DataFrame) -> DataFrame:
    """Model calls (expected, prompt_tokens, prompt_ns, tokens, ns) with tokens a second and whether the prompt was cut: under nine tenths of what was sent came through."""
    rate = lambda n, ns: F.round(F.try_divide(F.col(n), F.col(ns) / 1e9), 1)
    cut = F.coalesce("prompt_tokens", F.lit(0)) < 0.9 * F.col("expected")
    return runs.withColumn("truncated", cut).withColumn("prompt_rate", rate("prompt_tokens", "prompt_ns")).withColumn("rate", rate("tokens", "ns"))


def structured_validity(runs: DataFrame, most_errors: int = 5) -> DataFrame:
    """(model, runs, valid, errors) of structured calls (model, seed, error: null where the reply was valid); the first errors by seed."""
    w = Window.partitionBy("model", F.col("error").isNull()).orderBy("seed", "error")
    x = runs.withColumn("_k", F.row_number().over(w))
    first = F.collect_list(F.when(F.col("error").isNotNull() & (F.col("_k") <= most_errors), F.struct("_k", "error")))
    return x.groupBy("model").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("error").isNull()).alias("valid"), F.transform(F.array_sort(first), lambda e: e["error"]).alias("errors"))
