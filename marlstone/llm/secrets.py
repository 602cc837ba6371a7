"""Secret scans: candidate strings, then a random forest that removes false positives.

All of it is DataFrame expressions and Spark's own random forest, which run in the JVM; nothing is shuffled after the
scan. A text is cut at white space, quotes, brackets and marks, and after colons and equals signs; a candidate is a piece of at least MIN_LENGTH letters,
digits and `+/_=.-` that has a digit or changes case often, or one of any length that a key word with `=` or `:` stands before; a full stop
behind it is not part of it, the equals signs that pad base64 are. A quoted value behind a colon or an equals sign that holds other marks is one candidate
as it stands, unless it is an address. The forest looks at its length, at the transitions between its
kinds of characters, at the share of it that a small dictionary covers, at the path of its file and at the
words before and behind it. It learns from labelled findings (a bounded table: `labelled_findings` makes one whose labels
hold by construction; findings from reviews have the same columns).

Defined results: null and empty texts have no candidates; a null path is an empty one; each row is scanned on its
own, so repeated rows repeat their findings; ids pass through, null too; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm._work import Work

MIN_LENGTH = 16
LABELLED = 6000
TREES, DEPTH, SEED = 24, 7, 5
ACCEPT = 0.5
#: What pieces are cut at: separators go, a colon or equals sign ends a piece and stays with it.
_SEPARATORS = " \t\n\x0b\f\r\"'`<>(){}[],;|*$%&#!?@~^\\"
_SEP = r"\s\"'`<>(){}\[\],;|*$%&#!?@~^\\"
_MARKS = "!@#$%&*~^?"
#: A quoted value behind a colon or equals sign that holds marks is one piece, its quotes included, unless it is an address; separators that end a text are one too.
_QUOTED = "|".join(rf"{q}(?=[^{q}\s\\]*[{_MARKS}])(?![^{q}\s\\]*(?:://|[?&]\w+=))[^{q}\s\\]++{q}" for q in "\"'`")
_PIECE = rf"(?<=[:=])[ \t]{{0,2}}(?:{_QUOTED})|[{_SEP}]*+(?:[^{_SEP}:=]++(?:={{1,2}}(?=[{_SEP}]|\z)|[:=])?|[:=])|[{_SEP}]++\z"
_AFTER = 4  # pieces behind a candidate that count as its neighbours, as far as they are on its line
_BODY = r"^[A-Za-z0-9+/_=.\-]+$"
_CHANGES = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"

#: Pieces of words that make up ordinary text and identifiers.
DICTIONARY = (
    "the and ing tion ment ness able ible less ful ous ive ers est ent ant ance ence ity ist ism ize ise ation "
    "that this with from have they what when your more some time will about other into than them then there which "
    "data name file path main test user type list item value index count code class function version config "
    "public private static return import export default string number object error message request response "
    "example sample dummy placeholder changeme here mail com org net http https www html json text image src lib "
    "und die der das sch ung lich keit heit ein eine les des que pour dans ent eau eux oui con los las para como"
).split()
KEY_WORDS = r"(?i)(token|secret|passw|pwd|api|key|auth|bearer|credential|private|signing)"
PLAIN_WORDS = r"(?i)(commit|sha|md5|hash|checksum|digest|uuid|guid|id$|etag|revision|build|version|order|card|phone|example|sample|dummy|fake)"
QUIET_PATHS = r"(?i)(test|spec|example|sample|fixture|mock|docs?/|vendor|lock)"

FEATURES = ["length", "changes", "digits", "uppers", "lowers", "marks", "distinct", "hexes", "dictionary", "quiet_path", "key_word", "assigned", "plain_word", "known_prefix", "holds_plain", "url_user", "quoted", "key_after", "plain_after"]


def features(c: str, before: str, before2: str, path: str, after: str = "after", quoted: str = "quoted") -> list[Column]:
    """The feature columns, in the order of FEATURES, of a candidate with the two words before it, those behind it, its path and whether a quote opens it."""
    s, n = F.col(c), F.greatest(F.length(c), F.lit(1)).cast("double")
    near = F.concat_ws(" ", F.coalesce(before2, F.lit("")), F.coalesce(before, F.lit("")))
    share = lambda cls: F.length(F.regexp_replace(s, f"[^{cls}]", "")) / n
    covered = F.length(F.regexp_replace(F.lower(s), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    return [
        n,
        F.regexp_count(s, F.lit(_CHANGES)) / n,
        share("0-9"),
        share("A-Z"),
        share("a-z"),
        share(r"\W_"),
        F.size(F.array_distinct(F.split(s, ""))) / n,
        share("0-9a-fA-F"),
        1 - covered / n,
        flag(F.col(path).rlike(QUIET_PATHS)),
        flag(near.rlike(KEY_WORDS)),
        flag(F.coalesce(before, F.lit("")).rlike("[=:]$")),
        flag(near.rlike(PLAIN_WORDS)),
        flag(s.rlike(r"^(AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|xox[abp]-|sk_live_|sk-|AIza|eyJ)")),
        flag(s.rlike(r"(?i)(example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234567)")),
        flag(F.coalesce(before, F.lit("")).rlike("^//[^/]+:$")),
        flag(F.col(quoted)),
        flag(F.col(after).rlike(KEY_WORDS)),
        flag(F.col(after).rlike(PLAIN_WORDS)),
    ]


def labelled_findings(spark: SparkSession, rows: int = LABELLED, seed: int = SEED) -> DataFrame:
    """Findings whose label holds by construction: (candidate, before, before2, after, quoted, path, label).

    In paths of tests, examples and documents a key without a known prefix is a made-up one.
    """
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat_ws(":", i.cast("string"), F.lit(f"{seed}-{salt}")), 256)
    b64 = F.base64(F.unhex(h("b")))
    alnum = F.translate(F.concat(b64, F.base64(F.unhex(h("b2")))), "+/=", "Qz7")
    digits = F.translate(h("d"), "abcdef", "503142")
    pick = lambda salt, options: F.element_at(F.array(*map(F.lit, options)), (F.conv(F.substring(h(salt), 1, 6), 16, 10).cast("int") % len(options) + 1).cast("int"))
    word = F.concat(pick("w1", DICTIONARY), pick("w2", DICTIONARY), pick("w3", DICTIONARY), pick("w4", DICTIONARY), pick("w5", DICTIONARY))
    keys = ["token", "secret", "api_key", "password", "TOKEN", "API_KEY", "auth_token", "client_secret", "aws_secret_access_key", "private_key"]
    plain = ["commit", "sha1", "checksum", "digest", "revision", "etag", "build"]
    common = ["the", "of", "and", "is", "was", "in", "la", "der", "que", "then", "for"]
    quiet = ["tests/test_login.py", "docs/setup.md", "spec/api_spec.rb", "examples/run.sh", "fixtures/user.json", "vendor/lib.js"]
    told = F.concat(F.lit(" "), pick("a1", ["is the ", "is my ", "as ", "is our new ", "was the old "]), pick("k", ["api token", "access token", "secret", "api key", "password", "deploy key"]))
    plain_told = F.concat(F.lit(" "), pick("a1", ["is the ", "as ", "was the "]), pick("a2", ["checksum", "commit", "md5 digest", "build id", "revision", "etag"]))
    some = F.concat(F.lit(" "), pick("a1", common), F.lit(" "), pick("a2", DICTIONARY))
    marked = F.concat(F.initcap(F.substring(alnum, 1, 3)), pick("m1", list(_MARKS)), F.substring(alnum, 4, 4), pick("m2", list(_MARKS)), F.substring(alnum, 8, 4), pick("m3", [*_MARKS, ""]))
    joint = pick("m", ["-", "_", "."])
    phrase = F.concat(*(x for j in range(1, 5) for x in (joint, pick(f"w{j}", DICTIONARY), pick(f"v{j}", DICTIONARY))))
    phrase = F.substring(phrase, 2, 200)
    name = F.concat(*(F.initcap(pick(f"w{j}", DICTIONARY)) for j in range(1, 6)), F.initcap(pick("v1", [*common, "testing", "very", "long"])))
    cases = [  # (candidate, word before, word before that, label), then the words behind it, whether it is quoted and whether its path is a quiet one, where they matter
        (F.substring(h("x"), 1, 40), F.lit("="), pick("k", keys), 1),
        (F.upper(F.substring(h("x"), 1, 40)), F.lit("="), pick("k", keys), 1),
        (F.substring(h("x"), 1, 32), F.concat(pick("k", keys), F.lit(":")), pick("c", common), 1),
        (F.substring(b64, 1, 40), F.lit("="), pick("k", keys), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16))), F.lit("="), pick("k", [*keys, *common]), 1),
        (F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36)), pick("k", ["=", "bearer", "Bearer", "is"]), pick("c", [*keys, *common]), 1),
        (F.concat(F.lit("sk_live_"), F.substring(alnum, 1, 24)), F.lit("="), pick("k", keys), 1),
        (F.substring(alnum, 1, 24), pick("k", ["token=", "api_key=", "password=", "secret="]), pick("c", common), 1),
        (F.substring(h("x"), 1, 40), pick("p", plain), pick("c", common), 0),
        (F.concat_ws("-", F.substring(h("x"), 1, 8), F.substring(h("x"), 9, 4), F.substring(h("x"), 13, 4), F.substring(h("x"), 17, 4), F.substring(h("x"), 21, 12)), pick("p", ["id", "uuid", "=", "of"]), pick("c", ["uuid", *common]), 0),
        (F.substring(digits, 1, 16), pick("c", common), pick("c2", common), 0),
        (F.concat(word, F.substring(digits, 1, 2)), pick("c", common), pick("c2", common), 0),
        (F.concat(F.initcap(pick("w1", DICTIONARY)), F.initcap(pick("w2", DICTIONARY)), F.initcap(pick("w3", DICTIONARY)), F.initcap(word)), pick("c", ["=", *common]), pick("c2", common), 0),
        (F.concat_ws("/", pick("w1", DICTIONARY), pick("w2", DICTIONARY), pick("w3", DICTIONARY), F.concat(pick("w4", DICTIONARY), F.substring(digits, 1, 1), F.lit(".html"))), pick("c", ["=", *common]), pick("c2", common), 0),
        (F.concat(pick("e", ["your_token_here_", "example_secret_", "changeme_placeholder_", "xxxxxxxxxxxxxxxx"]), F.substring(digits, 1, 3)), F.lit("="), pick("k", keys), 0),
        (F.concat_ws(".", pick("w1", DICTIONARY), F.concat(pick("w2", DICTIONARY), F.substring(digits, 1, 2)), F.lit("mail"), F.lit("example.com")), pick("c", common), pick("c2", common), 0),
        (F.when(i % 44 < 22, F.substring(alnum, 1, 20)).otherwise(F.substring(h("x"), 1, 40)), F.concat(F.lit("//"), pick("c", ["user", "admin", "root", "deploy", "git"]), F.lit(":")), pick("p", ["https:", "postgres:", "redis:", "amqp:"]), 1),
        (F.substring(alnum, 1, 10), pick("e", ["=", ":"]), pick("k", keys), 1),
        (F.substring(h("x"), 1, 12), F.concat(pick("k", keys), pick("e", ["=", ":"])), pick("c", common), 1),
        (F.concat(pick("w1", DICTIONARY), pick("w2", DICTIONARY)), pick("e", ["=", ":"]), pick("k", keys), 0),
        (pick("w1", [*DICTIONARY, *common]), F.concat(pick("k", keys), pick("e", ["=", ":"])), pick("c", common), 0),
        (name, F.lit(""), F.lit(""), 0, some),
        (name, pick("c", ["", "class", "=", *common]), pick("c2", ["", *common]), 0, F.when(i % 4 < 2, told).otherwise(some)),
        (F.concat(name, F.substring(digits, 1, 1), F.initcap(pick("v2", DICTIONARY))), pick("c", ["", *common]), pick("c2", ["", *common]), 0, some),
        (marked, pick("e", ["=", ":"]), pick("k", keys), 1, some, True),
        (marked, F.concat(pick("k", keys), pick("e", ["=", ":"])), pick("c", common), 1, some, True),
        (phrase, pick("e", ["=", ":"]), pick("k", keys), 1, some, True),
        (F.concat(pick("w1", DICTIONARY), pick("w2", DICTIONARY), F.substring(digits, 1, 1), F.substring(alnum, 1, 1)), pick("e", ["=", ":"]), pick("k", keys), 1, some, True),
        (F.concat(pick("w1", DICTIONARY), pick("w2", DICTIONARY)), pick("e", ["=", ":"]), pick("k", keys), 0, some, True),
        (F.concat(pick("x1", ["your-", "example-", "sample_", "changeme-", "dummy."]), phrase), pick("e", ["=", ":"]), pick("k", keys), 0, some, True),
        (marked, pick("e", ["=", ":"]), pick("p", [*DICTIONARY, "title", "style", "color", "label"]), 0, some, True),
        (phrase, pick("e", ["=", ":", *common]), pick("p", [*DICTIONARY, "title", "style", "class", "label"]), 0, some, i % 2 == 0),
        (F.substring(h("x"), 1, 40), pick("c", common), pick("c2", common), 1, told),
        (F.substring(alnum, 1, 32), pick("c", common), pick("c2", common), 1, told),
        (F.substring(h("x"), 1, 40), F.lit(""), F.lit(""), 1, told),
        (F.substring(digits, 1, 16), pick("c", ["", *common]), pick("c2", ["", *common]), 0, F.when(i % 4 < 2, told).otherwise(some)),
        (F.upper(F.substring(h("x"), 1, 40)), pick("c", ["", *common]), pick("c2", common), 1, told),
        (F.substring(h("x"), 1, 32), pick("c", ["", *common]), pick("c2", common), 1, told),
        (F.substring(h("x"), 1, 40), pick("c", common), pick("c2", common), 0, F.when(i % 4 < 2, plain_told).otherwise(some)),
        (F.substring(h("x"), 1, 40), pick("p", plain), pick("c", common), 0, told),
        (F.substring(h("x"), 1, 40), pick("e", ["=", ":"]), pick("k", keys), 0, some, True, True),
        (F.substring(alnum, 1, 24), F.concat(pick("k", keys), pick("e", ["=", ":"])), pick("c", common), 0, some, i % 2 == 0, True),
        (marked, pick("e", ["=", ":"]), pick("k", keys), 0, some, True, True),
        (F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36)), pick("e", ["=", ":"]), pick("k", keys), 1, some, i % 2 == 0, True),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16))), pick("e", ["=", ":"]), pick("k", keys), 1, some, i % 2 == 0, True),
        (F.concat(F.lit("//"), pick("w1", DICTIONARY), F.lit("."), pick("w2", DICTIONARY), F.lit(".com/"), pick("w3", DICTIONARY), F.lit("/"), pick("w4", DICTIONARY), F.substring(digits, 1, 3)), F.lit("https:"), pick("c", common), 0),
    ]
    at = (i % len(cases)).cast("int")
    cases = [(*c, *(F.when(i % 3 > 0, some).otherwise(""), (i % 5 < 2) & (F.lit(c[3]) == 1), False)[len(c) - 4 :]) for c in cases]
    choose = lambda k: F.element_at(F.array(*(F.lit(c[k]) if isinstance(c[k], int) else c[k] for c in cases)), at + 1)
    path = F.when(choose(6), pick("path", quiet)).otherwise(pick("path", ["src/app.py", "config/settings.yaml", "main.go", "crawl", "deploy/env.sh", "", "lib/core.js"]))
    found = spark.range(0, rows, 1, 1).select(choose(0).alias("candidate"), choose(1).alias("before"), choose(2).alias("before2"), choose(4).alias("after"), choose(5).alias("quoted"), path.alias("path"), choose(3).cast("double").alias("label"))
    return Work(spark, "findings").save(found)  # written, or the features would repeat these expressions


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """The forest from findings (candidate, before, before2, path, label, and after and quoted where they are known)."""
    for name, unknown in (("after", F.lit("")), ("quoted", F.lit(False))):
        if name not in findings.columns:
            findings = findings.withColumn(name, unknown)
    x = findings.select(array_to_vector(F.array(*features("candidate", "before", "before2", "path", "after", "quoted"))).alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False).fit(x)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, word, candidate, before2, before, after, quoted, first_char): word counts the pieces of the text from 0."""

    def value(t: Column, k: Column) -> Column:
        """Whether it is a whole quoted value; only those end with a quote and begin with one."""
        return F.get(t, k).rlike("^[ \\t]*([\"'`])[^\"'`].*\\1$")

    def piece(t: Column, k: Column) -> Column:
        """Without the separators before it."""
        return F.when(value(t, k), F.substr(F.ltrim(F.get(t, k), F.lit(" \t")), F.lit(2))).otherwise(F.ltrim(F.get(t, k), F.lit(_SEPARATORS)))

    def bare(t: Column, k: Column) -> Column:
        return F.when(value(t, k), F.rtrim(piece(t, k), F.lit("\"'`"))).otherwise(F.rtrim(piece(t, k), F.lit(":.")))

    def behind(t: Column, k: Column) -> Column:
        return F.regexp_extract(F.array_join(F.slice(t, k + 2, _AFTER), ""), r"^[^\n]*", 0)

    def fits(t: Column, k: Column) -> Column:
        s, after = bare(t, k), F.get(t, k + 1)
        near = F.concat_ws(" ", F.coalesce(piece(t, k - 2), F.lit("")), F.coalesce(piece(t, k - 1), F.lit("")))
        assigned = F.coalesce(F.get(t, k - 1).endswith("=") | F.get(t, k - 1).endswith(":"), F.lit(False))
        whole = ~s.endswith("=") | after.isNull() | (F.length(F.ltrim(after, F.lit(_SEPARATORS))) < F.length(after))
        shaped = (F.length(s) >= MIN_LENGTH) & (s.rlike("[0-9]") | (F.regexp_count(s, F.lit(_CHANGES)) >= 4))
        # the cheap test first: most pieces are short words
        return ((F.length(F.get(t, k)) >= MIN_LENGTH) | assigned) & ((whole & s.rlike(_BODY)) | value(t, k)) & s.rlike("[A-Za-z0-9]") & (shaped | (assigned & near.rlike(KEY_WORDS)))

    def found(t: Column) -> Column:
        """t has the pieces with the separators before them, so their lengths add up to places in the text."""
        fit = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda k: fits(t, k))
        return F.flatten(F.transform(F.array(fit), lambda at: placed(t, at)))

    def placed(t: Column, at: Column) -> Column:
        # characters between a candidate and the one before it, then their running sum
        step = F.transform(at, lambda k, i: F.length(F.array_join(F.slice(t, F.coalesce(F.get(at, i - 1), F.lit(-1)) + 2, k - F.coalesce(F.get(at, i - 1), F.lit(-1))), "")))
        ends = F.aggregate(step, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.element_at(sums, -1) + n)))
        return F.zip_with(at, F.slice(ends, 2, F.size(at)), lambda k, end: F.struct(k.alias("word"), bare(t, k).alias("candidate"), piece(t, k - 2).alias("before2"), piece(t, k - 1).alias("before"), behind(t, k).alias("after"), F.get(t, k).rlike("^[ \\t]*[\"'`]").alias("quoted"), (end - F.length(piece(t, k))).alias("first_char")))

    # the pieces are a lambda's argument, so the text is cut once and not again for each of them
    cut = F.array(F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0)))
    every = F.flatten(F.transform(cut, found))
    rows = docs.select("doc_id", "path", F.explode(every).alias("x"))
    return rows.select("doc_id", "path", "x.*")


def secrets(spark: SparkSession, docs: DataFrame, path: str | None = None, findings: DataFrame | None = None) -> DataFrame:
    """Accepted findings in docs (doc_id, text and a path column): (doc_id, word, first_char, length, sha256, probability).

    The secret itself is not returned, only its digest and its place in the text; each place is a row of its own.
    """
    model = train(findings if findings is not None else labelled_findings(spark))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(path), F.lit("")).alias("path") if path else F.lit("").alias("path"), "text")
    found = candidates(docs).withColumn("features", array_to_vector(F.array(*features("candidate", "before", "before2", "path", "after", "quoted"))))
    scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("p").transform(found)
    scored = scored.withColumn("probability", F.element_at(vector_to_array("p"), 2)).where(F.col("probability") >= ACCEPT)
    return scored.select("doc_id", F.col("word").cast("long").alias("word"), F.col("first_char").cast("long").alias("first_char"), F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("sha256"), "probability")
