"""The candidates' way as tables: seeds and windows in, verdict requests between, findings and the run's status out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.text import TAGS, UNSEEN
from marlstone.operators.ordered import numbered
from marlstone.sources.work import apart

# How many windows a run may look at, lines of a function that is shown on request, and requests for them.
MAX_WINDOWS = 80
SHOWN_LINES = 80
MAX_REQUESTS = 2
# Arguments of the tools with their kinds and bounds; lengths for texts, values for numbers.
ARGUMENTS: dict[str, dict[str, tuple]] = {
    "list_files": {"path": ("text", None, None), "max_entries": ("number", 1, 500)},
    "read_file": {"path": ("needed text", None, None), "start_line": ("number", 1, None), "end_line": ("number or null", 1, None)},
    "search_code": {"pattern": ("needed text", 1, 200), "path": ("text", None, None), "regex": ("flag", None, None), "max_matches": ("number", 1, 100)},
    "scan_static": {"path": ("text", None, None), "scanner": ("one of semgrep bandit all", None, None)},
    "retrieve_knowledge": {"query": ("needed text", 1, 300), "cwe": ("id or null", None, None), "k": ("number", 1, 8)},
}


def _argument_fault(value: Column, kind: Column, rule: tuple) -> Column:
    """What is wrong with one argument, else null. kind is the JSON type of the value, null where it is absent."""
    what, lo, hi = rule
    is_text = kind == "STRING"
    whole = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|STRING)") & value.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$")
    absent = F.when(kind.isNull(), F.lit("missing" if what.startswith("needed") else None))
    size = F.length(value) if "text" in what else F.regexp_extract(value, r"([+-]?\d+)", 1).try_cast("decimal(38,0)")
    outside = F.coalesce(size < lo, F.lit(False)) if lo is not None else F.lit(False)
    outside = outside | (F.coalesce(size > hi, F.lit(False)) if hi is not None else F.lit(False))
    if "text" in what:
        bad = F.when(~is_text, "no text").when(outside, "out of bounds")
    elif what.startswith("number"):
        bad = F.when(kind == "BOOLEAN", F.when((value == "false") & F.lit(lo is not None and lo > 0), "out of bounds")).when(~whole, "no number").when(outside, "out of bounds")
    elif what == "flag":
        yes_no = F.lower(value).isin(*"true false 1 0 yes no y n on off t f".split())
        bad = F.when(~(kind.isin("BOOLEAN", "STRING", "BIGINT") & yes_no), "no flag")
    elif what.startswith("one of"):
        bad = F.when(~(is_text & value.isin(*what.split()[2:])), "no choice")
    else:
        bad = F.when(~(is_text & value.rlike(r"^CWE-\d+$")), "no id")
    if what.endswith("or null"):
        bad = F.when(kind != "VOID", bad)
    return F.when(kind.isNull(), absent).otherwise(bad)


def argument_errors(calls: DataFrame) -> DataFrame:
    """calls (tool, arguments: JSON) with `errors`, sorted: `name: what is wrong` for each argument that breaks its tool's rules or is none of them.

    An unknown tool is one error; arguments that are no object count as none given.
    """
    parsed = F.try_parse_json("arguments")
    given = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)
    x = calls.withColumn("_v", given).withColumn("_names", F.coalesce(F.map_keys(F.from_json("arguments", "map<string,string>")), F.array().cast("array<string>")))
    x = x.withColumn("_names", F.when(F.col("_v").isNotNull(), F.col("_names")).otherwise(F.array().cast("array<string>")))
    found = F.array(F.concat(F.lit("tool: unknown "), F.coalesce("tool", F.lit(""))))
    for tool, rules in ARGUMENTS.items():
        faults = [F.concat(F.lit(f"{a}: "), _argument_fault(F.try_variant_get("_v", f"$.{a}", "string"), F.schema_of_variant(F.try_variant_get("_v", f"$.{a}", "variant")), rule)) for a, rule in rules.items()]
        extra = F.transform(F.filter("_names", lambda n: ~n.isin(*rules)), lambda n: F.concat(n, F.lit(": not known")))  # noqa: B023
        found = F.when(F.col("tool") == tool, F.concat(F.array_compact(F.array(*faults)), extra)).otherwise(found)
    return x.withColumn("errors", F.array_sort(found)).drop("_v", "_names")


def budgeted_windows(windows: DataFrame, first: DataFrame, most: int = MAX_WINDOWS) -> DataFrame:
    """windows (app, path, line_start, line_end) in the order of a run: files of `first` (app, path) before others, then by place; those over the cap are marked skipped, not dropped."""
    x = windows.join(first.select("app", "path").distinct().withColumn("_first", F.lit(0)), ["app", "path"], "left")
    x = numbered(x.withColumn("_first", F.coalesce("_first", F.lit(1))), ["app"], ["_first", "path", "line_start"], "ord")
    return x.withColumn("ord", F.col("ord").cast("int")).withColumn("skipped", F.col("ord") > most).drop("_first")


def coverage(ordered: DataFrame) -> DataFrame:
    """(app, windows, skipped, skipped_files, reviewed_files): what of a run's windows was looked at."""
    files = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("path"))))
    return ordered.groupBy("app").agg(F.count(F.lit(1)).alias("windows"), F.count_if("skipped").alias("skipped"), files(F.col("skipped")).alias("skipped_files"), files(~F.col("skipped")).alias("reviewed_files"))


def hidden_notes(shown: DataFrame) -> DataFrame:
    """(app, path, note), once for each file with a line (app, path, text) that holds hidden characters."""
    odd = shown.where(F.col("text").rlike(f"[{TAGS}{UNSEEN}]")).select("app", "path").distinct()
    return odd.withColumn("note", F.concat("path", F.lit(": hidden Unicode characters in the source (possible Trojan Source / hidden instructions)")))


def seeds(idor: DataFrame, unsigned: DataFrame, files: DataFrame, handlers: DataFrame) -> DataFrame:
    """(app, path, line, line_start, line_end, title, family): one candidate a handler, broken object access before missing sign-in.

    A candidate cites the handler's first line that names its model (model of idor), else the handler's first line.
    """
    place = ["app", "path", "line_start"]
    title = lambda t: F.concat(F.lit(t), "function").alias("title")
    both = idor.select(*place, "priority", "model", title("Broken object-level authorization in ")).unionByName(
        unsigned.select(*place, F.lit(2).alias("priority"), F.lit(None).cast("string").alias("model"), title("Missing authentication on "))
    )
    k = F.row_number().over(Window.partitionBy(*place).orderBy("priority", "title"))
    x = both.withColumn("_k", k).where("_k = 1").join(apart(handlers.select(*place, "line_end").dropDuplicates(place)), place)
    body = F.slice(F.split("text", "\n", -1), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1)
    word = F.concat(F.lit(r"\b"), "model", F.lit(r"\b"))
    first = F.array_position(F.transform(body, lambda s: F.coalesce(F.rlike(s, word), F.lit(False))), True)
    x = x.join(apart(files.select("app", "path", "text")), ["app", "path"], "left")
    line = F.when(first > 0, F.col("line_start") + first - 1).otherwise(F.col("line_start"))
    return x.select("app", "path", line.cast("int").alias("line"), "line_start", "line_end", "title", F.lit("authorization_idor").alias("family"))


def in_window(candidates: DataFrame, shown: DataFrame, families: list[str]) -> DataFrame:
    """candidates (event_id, family, line) with `fate`: kept, out_of_window (the line is not in what the event shown (event_id, lo, hi) held, or there is none), or other_family."""
    x = candidates.join(shown.select("event_id", "lo", "hi"), "event_id", "left")
    inside = F.coalesce(F.col("line").between(F.col("lo"), F.col("hi")), F.lit(False))
    return x.withColumn("fate", F.when(~inside, "out_of_window").when(~F.coalesce(F.col("family").isin(*families), F.lit(False)), "other_family").otherwise("kept")).drop("lo", "hi")


def answered_requests(requests: DataFrame, symbols: DataFrame, most: int = MAX_REQUESTS, lines: int = SHOWN_LINES) -> DataFrame:
    """Requests (app, candidate, turn, path, need) for a function's text that are answered, with where it stands: file, line_start, line_end.

    The name is what stands before a bracket and after the last dot. Asking ends at the first request that names nothing, something asked before
    or no function of the application (symbols: app, name, path, line_start, line_end), and after `most`. Equal rows are one request, those of one turn go by name. A definition in the candidate's file comes before others.
    """
    name = F.element_at(F.split(F.element_at(F.split(F.trim(F.coalesce("need", F.lit(""))), r"\("), 1), r"\."), -1)
    x = requests.select("app", "candidate", "turn", "path", name.alias("name")).distinct()
    known = symbols.select("app", "name").distinct().withColumn("_known", F.lit(True))
    x = x.join(known, ["app", "name"], "left")
    again = F.row_number().over(Window.partitionBy("app", "candidate", "name").orderBy("turn")) > 1
    x = x.withColumn("_stops", (F.col("name") == "") | F.col("_known").isNull() | again)
    turns = Window.partitionBy("app", "candidate").orderBy("turn", "name")
    x = x.withColumn("_k", F.row_number().over(turns)).withColumn("_ended", F.max("_stops").over(turns.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.where((F.col("_k") <= most) & ~F.col("_ended")).drop("_k", "_ended", "_stops", "_known")
    # one candidate definition in the same file, one over all: both are single rows a key, so a common name does not multiply the requests
    place = F.struct("path", "line_start", "line_end")
    near = symbols.groupBy("app", "name", "path").agg(F.min(place).alias("near"))
    far = symbols.groupBy("app", "name").agg(F.min(place).alias("far"))
    x = x.join(near, ["app", "name", "path"], "left").join(far, ["app", "name"], "left").withColumn("at", F.coalesce("near", "far"))
    end = F.least(F.col("at.line_end"), F.col("at.line_start") + lines)
    return x.select("app", "candidate", "turn", "name", F.col("at.path").alias("file"), F.col("at.line_start").alias("line_start"), end.alias("line_end"))


def controls_seen(verdicts: DataFrame, shown: DataFrame, code: DataFrame) -> DataFrame:
    """verdicts (candidate, path, control_file, control_line) with `control_ok`: the line was shown to the candidate (shown: candidate, path, lo, hi) and is code.

    code (path, code_lines) holds each file's lines of code, null where they cannot be told: there any line will do. A control names its own file, else the candidate's.
    """
    x = verdicts.withColumn("_at", F.coalesce("control_file", "path"))
    seen = x.join(shown.withColumnRenamed("path", "_at"), ["candidate", "_at"])
    seen = seen.where(F.col("control_line").between(F.col("lo"), F.col("hi"))).select("candidate", "control_line", "_at").distinct().withColumn("_seen", F.lit(True))
    x = x.join(seen, ["candidate", "control_line", "_at"], "left").join(code.select(F.col("path").alias("_at"), "code_lines"), "_at", "left")
    is_code = F.col("code_lines").isNull() | F.array_contains("code_lines", F.col("control_line"))
    return x.withColumn("control_ok", F.coalesce("_seen", F.lit(False)) & F.coalesce(is_code, F.lit(False))).drop("_at", "_seen", "code_lines")


def observed_text(evidence: DataFrame, events: DataFrame, shown: DataFrame) -> DataFrame:
    """evidence (evidence_id, event_id, file, line_start, line_end) with `observed`: the text of its lines as its event showed it.

    events (event_id, tool), shown (event_id, path, n, text). Of a search only lines of the cited file count, of a read all; another tool or no event gives null.
    """
    lines = evidence.join(shown, "event_id").join(events.select("event_id", "tool"), "event_id")
    cited = F.col("n").between(F.col("line_start"), F.col("line_end")) & ((F.col("tool") == "read_file") | (F.col("path") == F.col("file")))
    text = lines.where(cited).groupBy("evidence_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda r: r["text"]), "\n").alias("_text"))
    x = evidence.join(events.select("event_id", "tool"), "event_id", "left").join(text, "evidence_id", "left")
    return x.withColumn("observed", F.when(F.col("tool").isin("read_file", "search_code"), F.coalesce("_text", F.lit("")))).drop("_text", "tool")


def top_helpers(helpers: DataFrame, most: int = 3) -> DataFrame:
    """(handler, helpers): the strongest helpers (handler, name, rank) of each handler, strongest first, then by name."""
    k = F.row_number().over(Window.partitionBy("handler").orderBy(F.desc("rank"), "name"))
    x = helpers.withColumn("_k", k).where(F.col("_k") <= most)
    return x.groupBy("handler").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "name"))), lambda r: r["name"]).alias("helpers"))


def idioms(handlers: DataFrame, reached: DataFrame, helpers: DataFrame, most_helpers: int = 8, most_examples: int = 3) -> DataFrame:
    """(app, handlers, with_id, scoped, helpers, examples): how an application ties objects to their users.

    handlers are routes, reached their owned models, helpers (app, name, rank) with 3 for an owner's check; the first names and examples in order.
    """
    key = ["app", "path", "function", "line_start"]
    loads = reached.select(*key).distinct().withColumn("_loads", F.lit(True))
    x = handlers.join(apart(loads), key, "left").withColumn("_with_id", (F.size("id_params") > 0) & F.col("_loads").isNotNull())
    k = F.row_number().over(Window.partitionBy("app", "owner_check").orderBy("path", "line_start"))
    x = x.withColumn("_k", k)
    example = F.when(F.col("owner_check") & (F.col("_k") <= most_examples), F.struct("_k", F.format_string("%s (%s:%d)", "function", "path", "line_start").alias("t")))
    out = x.groupBy("app").agg(F.count(F.lit(1)).alias("handlers"), F.count_if("_with_id").alias("with_id"), F.count_if("owner_check").alias("scoped"), F.transform(F.array_sort(F.collect_list(example)), lambda e: e["t"]).alias("examples"))
    named = helpers.where("rank = 3").select("app", "name").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("app").orderBy("name"))).where(F.col("_n") <= most_helpers)
    named = named.groupBy("app").agg(F.array_sort(F.collect_list("name")).alias("helpers"))
    return out.join(apart(named), "app", "left").withColumn("helpers", F.coalesce("helpers", F.array().cast("array<string>")))


def assembled(kept: DataFrame, shown: DataFrame, cwe: dict[str, str]) -> DataFrame:
    """Findings of candidates (app, candidate, event_id, family, path, line, title, reason), numbered in each application, with the cited line's text (shown: event_id, n, text) as evidence."""
    ids = F.create_map(*(F.lit(x) for kv in cwe.items() for x in kv))
    text = shown.groupBy("event_id", F.col("n").alias("line")).agg(F.min("text").alias("_text"))
    x = numbered(kept, ["app"], ["candidate"], "_no").join(text, ["event_id", "line"], "left")
    evidence = F.struct(F.col("path").alias("file"), F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.coalesce("_text", F.lit("")).alias("excerpt"), F.col("event_id").alias("tool_event_id"))
    return x.select(
        "app", F.format_string("F%03d", "_no").alias("finding_id"), F.format_string("H%03d", "_no").alias("hypothesis_id"), "title", F.try_element_at(ids, F.col("family")).alias("cwe_id"),
        F.lit("candidate").alias("analysis_status"), F.substring("reason", 1, 500).alias("source_to_sink"), evidence.alias("evidence"),
    )


def run_status(skipped: Column, invalid: Column) -> Column:
    """`partial` where windows were skipped or replies could not be used."""
    return F.when((F.coalesce(skipped, F.lit(0)) > 0) | (F.coalesce(invalid, F.lit(0)) > 0), "partial").otherwise("complete")
