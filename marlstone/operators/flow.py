"""Where the values of calls come from, and which calls a request may reach.

Parsing gives one row a call, with the roots of its values: an expression names what it passes on, names lead to what they are
bound to, and what is reached in the end are the function's parameters and the request itself. Whether a call is a
sink is decided by rules over these rows; whether a request feeds a function is a fixpoint over the table of calls, through functions and
files of any number: each round joins the functions that are new with the calls that hand a parameter on, until none is new.
"""

from __future__ import annotations

import ast
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import values as V
from marlstone.sources.work import apart, settled

REQUEST = "@request"

#: What happens to a value in an attribute or a call (last name, dotted text): the first rule that fits decides.
_PASSES = [
    ("attribute", lambda last, _: last in V.PATH_PARTS, "shut"),
    ("both", lambda _, text: re.search(V.CONFIGURATION, text), "shut"),
    ("call", lambda last, text: last in V.CLEANERS or re.search(V.LOOKUP, f"{text}("), "shut"),
    ("both", lambda _, text: re.search(V.REQUEST_WORDS, text), "request"),
    ("call", lambda last, _: last not in V.CARRIERS, "shut"),  # an unknown function returns data of its own
]

#: Syntax that binds names: where the names stand, and the expression.
_BINDERS = {
    ast.Assign: ("targets", "value"), ast.AnnAssign: ("target", "value"), ast.AugAssign: ("target", "value"), ast.NamedExpr: ("target", "value"), ast.For: ("target", "iter"),
    ast.AsyncFor: ("target", "iter"), ast.comprehension: ("target", "iter"), ast.withitem: ("optional_vars", "context_expr"),
}

#: Calls that may be sinks; the controls of others are not looked for.
_SINKS = {*V.SQL_METHODS, *V.SQL_WRAPPERS, *V.NOSQL_METHODS, *V.FILE_FUNCTIONS, *V.PATH_METHODS}


def called(n: ast.AST | None) -> str:
    """The last name of a call, an attribute or a name."""
    n = n.func if isinstance(n, ast.Call) else n
    return n.attr if isinstance(n, ast.Attribute) else n.id if isinstance(n, ast.Name) else ""


def names(*trees: ast.AST) -> set[str]:
    return {x.id for tree in trees for x in ast.walk(tree) if isinstance(x, ast.Name)}


def passed_on(expression: ast.AST) -> set[str]:
    """The names whose values an expression passes on, and REQUEST where it reads a request."""
    out, todo = set(), [expression]
    while todo:
        n = todo.pop()
        kind = "call" if isinstance(n, ast.Call) else "attribute" if isinstance(n, ast.Attribute) else ""
        if kind:
            text = ast.unparse(n.func if kind == "call" else n)
            fate = next((then for on, fits, then in _PASSES if on in (kind, "both") and fits(called(n), text)), "open")
            if fate == "request":
                out.add(REQUEST)
            elif fate == "open" and kind == "call":
                todo += [*n.args, *(k.value for k in n.keywords), *([n.func.value] if isinstance(n.func, ast.Attribute) else [])]
            elif fate == "open":
                todo.append(n.value)
        elif isinstance(n, ast.Name):
            out.add(n.id)
        else:
            todo += [n.value] if isinstance(n, ast.Subscript) else ast.iter_child_nodes(n)
    return out


def pieces(n: ast.AST) -> list[ast.AST]:
    """The changing parts of a string that is put together; none of any other expression."""
    put = {
        ast.JoinedStr: lambda: [v for v in n.values if isinstance(v, ast.FormattedValue)],
        ast.BinOp: lambda: [n] if isinstance(n.op, ast.Add) else [n.right] if isinstance(n.op, ast.Mod) and isinstance(getattr(n.left, "value", None), str) else [],
        ast.Call: lambda: [n] if getattr(n.func, "attr", "") == "format" and (n.args or n.keywords) else [],
    }
    return put.get(type(n), list)()


class Scope:
    """The names of a function: parameters, 0 where they are a request's, and what other names are bound to."""

    def __init__(self, fn: ast.AST, entry: bool):
        every = {a.arg for a in (*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs)}.difference(V.NO_PARAMETERS)
        self.params = {p: int(not entry and not re.search(V.REQUEST_WORDS, p)) for p in every}
        self.bound: dict[str, list[ast.AST]] = defaultdict(list)
        for n in ast.walk(fn):
            target, source = (getattr(n, field) for field in _BINDERS.get(type(n), ("_fields", "_fields")))
            if type(n) in _BINDERS and target is not None and source is not None:
                for name in names(*(target if isinstance(target, list) else [target])) - every:
                    self.bound[name].append(source)
        self._ends: dict[str, frozenset[str]] = {}

    def _end(self, name: str) -> frozenset[str]:
        """The parameters and the request that a name leads to."""
        if name not in self._ends:
            seen, todo, ends = set(), [name], set()
            while todo:
                at = todo.pop()
                if at == REQUEST or at in self.params:
                    ends.add(at)
                elif at not in seen:
                    seen.add(at)
                    todo += (x for e in self.bound.get(at, ()) for x in passed_on(e))
            self._ends[name] = frozenset(ends)
        return self._ends[name]

    def level(self, expressions: Iterable[ast.AST]) -> int | None:
        """0 if a request is behind one of them, 1 if only parameters are, None otherwise."""
        ends = {end for e in expressions for name in passed_on(e) for end in self._end(name)}
        return min((self.params.get(end, 0) for end in ends), default=None)

    def meaning(self, n: ast.AST) -> ast.AST:
        """For a name the expression bound to it last, one put together before others."""
        known = self.bound.get(n.id) if isinstance(n, ast.Name) else None
        return max(enumerate(known), key=lambda x: (bool(pieces(x[1])), x[0]))[1] if known else n

    def file_named(self, n: ast.AST) -> bool:
        """Whether the parameters in an expression, or failing them its text, are named like a file."""
        own = [x for x in names(n) if self.level([ast.Name(x)]) == 1]
        return any(re.search(V.FILE_PARAMETER, x) for x in own or [ast.unparse(n)])


def _text(level: int | None) -> str:
    return "" if level is None else str(level)


def call_detail(c: ast.Call, scope: Scope, start: int, body: str, mongo: bool) -> dict[str, str]:
    """What the rules ask of a call: levels of its values, and the controls in its function before it."""
    values = [*c.args, *(k.value for k in c.keywords)]
    levels = [scope.level([v]) for v in values]
    out = {"from_request": str(int(0 in levels)), "passes": str(int(1 in levels)), "func_start": str(start)}
    if called(c) not in _SINKS:
        return out
    receiver = c.func.value if isinstance(c.func, ast.Attribute) else None
    out |= {"method": str(int(receiver is not None)), "of": called(receiver), "args": str(len(c.args)), "mongo": str(int(mongo))}
    if receiver is not None:
        own = scope.meaning(receiver)
        slash = isinstance(own, ast.BinOp) and isinstance(own.op, ast.Div)
        out |= {"self_level": _text(scope.level([own])), "self_path": str(int(slash or "path" in ast.unparse(own).lower())), "self_file": str(int(scope.file_named(own)))}
    if c.args:
        first = c.args[0]
        wrapped = isinstance(first, ast.Call) and called(first) in V.SQL_WRAPPERS and bool(first.args)
        text, own = scope.meaning(first.args[0] if wrapped else first), scope.meaning(first)
        fixed = " ".join(x.value for x in ast.walk(text) if isinstance(x, ast.Constant) and isinstance(x.value, str))
        out |= {
            "first": type(first).__name__, "wrapped": str(int(wrapped)), "built": str(int(bool(pieces(text)))), "fixed": fixed, "built_level": _text(scope.level(pieces(text))),
            "raw_level": _text(scope.level([first])), "path_level": _text(scope.level([own])), "path_file": str(int(scope.file_named(own))),
        }
    before = "\n".join(body.split("\n")[: max(c.lineno - start, 0) + 1])
    for control, pattern, where in (("strong_sql", V.STRONG_SQL, body), ("strong_path", V.STRONG_PATH, before), ("weak_path", V.WEAK_PATH, before)):
        if found := re.search(pattern, where):
            out[control] = found[0]
    return out


def calls_of(fn: ast.AST, own: list[ast.Call], entry: bool, body: str, mongo: bool) -> Iterator[tuple[ast.Call, dict[str, str]]]:
    scope = Scope(fn, entry)
    for c in own:
        yield c, call_detail(c, scope, fn.lineno, body, mongo)


def _d(k: str) -> Column:
    return F.coalesce(F.col("detail")[k], F.lit(""))


def _is(k: str) -> Column:
    return _d(k) == "1"


def sink_calls(known: DataFrame) -> DataFrame:
    """(app, path, line_start, function, sink, family, priority, control, control_text, func_start, file_named) of the calls that the rules take for sinks."""
    name, method = F.col("name"), _is("method")
    # rules, in their order: which calls, the family, where the value's level stands, and whether it is named like a file
    wrapper, query = name.isin(V.SQL_WRAPPERS), method & name.isin(V.SQL_METHODS)
    own = method & name.isin([m for m in V.PATH_METHODS if m != "save"])
    rules = [
        ((wrapper | (query & ~_is("wrapped"))) & _is("built") & _d("fixed").rlike(V.SQL_WORDS), "sql_injection", "built_level", "path_file"),
        (method & name.isin(V.NOSQL_METHODS) & _is("mongo") & (_d("args") != "0") & ~_d("first").isin("Dict", "Constant"), "sql_injection", "raw_level", "path_file"),
        (own & ((name != "open") | _is("self_path")), "path_traversal", "self_level", "self_file"),
        (method & (name == "save") & (_d("first") != "Starred"), "path_traversal", "path_level", "path_file"),
        (~own & name.isin(V.FILE_FUNCTIONS) & (~method | _d("of").isin(V.FILE_MODULES)), "path_traversal", "path_level", "path_file"),
    ]

    def chosen(part: int) -> Column:
        out = F.lit("")
        for rule in reversed(rules):
            out = F.when(rule[0], F.lit(rule[part]) if part == 1 else _d(rule[part])).otherwise(out)
        return out

    sql = F.col("family") == "sql_injection"
    strong, weak = F.when(sql, _d("strong_sql")).otherwise(_d("strong_path")), F.when(sql, "").otherwise(_d("weak_path"))
    s = known.where(F.col("kind").eqNullSafe("call") & name.isin(sorted(_SINKS))).withColumn("family", chosen(1)).withColumn("priority", chosen(2)).where("family <> '' and priority <> ''")
    return s.select(
        "app", "path", "line_start", F.col("parent").alias("function"), name.alias("sink"), "family", F.col("priority").cast("int").alias("priority"), F.when(strong != "", "strong").when(weak != "", "weak").otherwise("none").alias("control"),
        F.when(strong != "", strong).otherwise(weak).alias("control_text"), _d("func_start").cast("int").alias("func_start"), (chosen(3) == "1").alias("file_named"),
    )


def fed_functions(known: DataFrame) -> DataFrame:
    """(app, function, hops): functions that some call hands a value of a request, hops calls behind the one that reads it.

    Semi-naive: a round joins only the functions that the round before found, and the last round finds none.
    """
    calls = known.where("kind = 'call'").select("app", F.col("parent").alias("caller"), F.col("name").alias("function"), _is("from_request").alias("asked"), _is("passes").alias("passes"))
    links = settled(calls.where("passes and caller <> function").select("app", "caller", "function").distinct())
    found = new = settled(calls.where("asked").select("app", "function").distinct().withColumn("hops", F.lit(0)))
    hops = 0
    while not new.isEmpty():
        hops += 1
        step = links.join(apart(new.select("app", F.col("function").alias("caller"))), ["app", "caller"]).select("app", "function").distinct()
        new = settled(step.join(apart(found), ["app", "function"], "left_anti").withColumn("hops", F.lit(hops)))
        found = found.unionByName(new)
    return found


def guard_functions(known: DataFrame) -> DataFrame:
    """(app, name): functions that check a path, return or raise, and touch no file themselves."""
    touching = known.where(F.col("kind").eqNullSafe("call") & F.col("name").isin(V.READS_OR_WRITES)).select("app", "path", _d("func_start").alias("def_line")).distinct()
    body = _d("body")
    checks = known.where((F.col("kind") == "function") & body.rlike(V.STRONG_PATH) & body.rlike(r"\b(?:return|raise)\b"))
    return checks.select("app", "path", "name", _d("def_line").alias("def_line")).join(apart(touching), ["app", "path", "def_line"], "left_anti").select("app", "name").distinct()
