"""Views of Django and its REST framework: routed functions and classes as handlers beside those of `code.routes`.

Parsing gives rows for views, for what URL files route, include and register, and for project settings. The rest is joins: prefixes of included URL files
by rounds over the table of includes, permissions that a class inherits by rounds over the table of bases (the nearest
class that states any counts, at equal distance the first base), permission classes of the project by what their own bodies enforce.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.operators import values as V
from marlstone.operators.code import enforces, helper_strength, owner_columns_of, parsed
from marlstone.operators.flow import called
from marlstone.sources.work import apart, settled

_SCHEMA = "app string, path string, kind string, name string, line_start int, line_end int, detail map<string,string>"
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Base classes further away are not followed.
MOST_BASES = 12


def _texts(nodes: list[ast.AST]) -> str:
    return "\n".join(map(ast.unparse, nodes))


def _functions(n: ast.AST) -> list[ast.AST]:
    return [x for x in ast.walk(n) if isinstance(x, _DEF) and x is not n]


def _listed(n: ast.AST | None) -> list[ast.AST]:
    return list(getattr(n, "elts", []))


def _stated(n: ast.AST) -> list[ast.AST] | None:
    """The permission classes that a view states itself, in its body or by a decorator; None if it states none."""
    lists = [s.value for s in ast.walk(n) if isinstance(s, ast.Assign) and any(getattr(t, "id", "") == "permission_classes" for t in s.targets)]
    lists += [d.args[0] for d in n.decorator_list if isinstance(d, ast.Call) and called(d) == "permission_classes" and d.args]
    return [e for x in lists for e in _listed(x)] if lists else None


def _view(app: str, path: str, n: ast.AST, lines: list[str]) -> tuple:
    inside, is_class = _functions(n), isinstance(n, ast.ClassDef)
    takers = inside if is_class else [n]
    skip = 0 if is_class else 1
    params = [a.arg for f in takers for a in [*f.args.args[1:], *f.args.kwonlyargs]] if is_class else [a.arg for a in [*n.args.args[skip:], *n.args.kwonlyargs]]
    stated = _stated(n)
    verbs = [e.value.upper() for d in n.decorator_list if isinstance(d, ast.Call) and d.args for e in _listed(d.args[0]) if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    calls = {called(c) for c in ast.walk(n) if isinstance(c, ast.Call)} - {n.name, ""}
    start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
    return app, path, "class" if is_class else "function", n.name, start, n.end_lineno, {
        "bases": _texts(getattr(n, "bases", [])), "guards": _texts(n.decorator_list), "inner_guards": _texts([d for f in inside for d in f.decorator_list]),
        "states": str(int(stated is not None)), "permissions": "\n".join(called(e) for e in stated or []), "body": "\n".join(lines[n.lineno - 1 : n.end_lineno]), "def_line": str(n.lineno),
        "methods": "\n".join(m.name for m in n.body if isinstance(m, _DEF)) if is_class else "", "params": "\n".join(p for p in params if p != "request"), "verbs": "\n".join(verbs), "calls": "\n".join(sorted(calls)),
        "takes_request": str(int(not is_class and bool(n.args.args) and n.args.args[0].arg == "request")),
    }


def _urls(app: str, path: str, tree: ast.AST) -> Iterator[tuple]:
    """What a URL file mentions, and its patterns: with a view, an included file or a registered class."""
    for n in ast.walk(tree):
        if isinstance(n, (ast.Name, ast.Attribute)):
            yield app, path, "mention", called(n), n.lineno, n.lineno, {}
        if isinstance(n, ast.Call) and called(n) in V.URL_CALLS and len(n.args) > 1 and isinstance(n.args[0], ast.Constant):
            to = n.args[1]
            included = next((str(a.value) for c in ast.walk(to) if isinstance(c, ast.Call) and called(c) == "include" for a in ast.walk(c) if isinstance(a, ast.Constant) and isinstance(a.value, str)), "")
            target = called(to.func.value) if isinstance(to, ast.Call) and called(to) == "as_view" and isinstance(to.func, ast.Attribute) else called(to)
            yield app, path, "url", "" if included else target, n.lineno, n.end_lineno, {"pattern": str(n.args[0].value) + "/" * (called(n) == "register"), "include": included}


def _rows(app: str, path: str, text: str) -> Iterator[tuple]:
    if "settings" in path:
        yield app, path, "settings", "", 1, 1, {"text": text}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    if path.endswith("urls.py"):
        yield from _urls(app, path, tree)
    uses = re.search(r"(?m)^\s*(?:from|import)\s+(?:django|rest_framework)\b", text) is not None
    lines = text.splitlines()
    top = {id(n) for n in tree.body}
    for n in ast.walk(tree):
        if isinstance(n, ast.ClassDef) or (isinstance(n, _DEF) and id(n) in top):
            row = _view(app, path, n, lines)
            yield (*row[:6], row[6] | {"uses": str(int(uses)), "top": str(int(id(n) in top))})


def view_facts(files: DataFrame) -> DataFrame:
    """Facts of files (app, path, text): classes, top functions, URL patterns, mentions and settings."""
    return parsed(files, _rows, _SCHEMA)


def _d(k: str) -> Column:
    return F.coalesce(F.col("detail")[k], F.lit(""))


def _list(k: str) -> Column:
    return F.filter(F.split(_d(k), "\n"), lambda x: x != "")


def url_paths(seen: DataFrame) -> DataFrame:
    """(app, view, url): each routed view under the prefixes of the URL files that include its file; the first in text order of several.

    A file that nothing includes has no prefix; an included one has those of the round that reaches it first, so a circle of includes ends.
    """
    url = seen.where("kind = 'url'").select("app", "path", "name", _d("pattern").alias("pattern"), _d("include").alias("include"))
    module = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    url = settled(url.withColumn("module", module))
    # a module is named from some folder downwards: each ending of a file's dotted path
    parts = F.split("module", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    named = url.select("app", "module").distinct().select("app", "module", F.explode(endings).alias("include"))
    includes = url.where("include <> ''").select("app", F.col("module").alias("by"), "pattern", "include").join(apart(named), ["app", "include"]).where("by <> module").select("app", "by", "pattern", "module").distinct()
    includes = settled(includes)
    found = new = settled(url.select("app", "module").distinct().join(apart(includes.select("app", "module")), ["app", "module"], "left_anti").withColumn("prefix", F.lit("")))
    while not new.isEmpty():
        step = includes.join(apart(new.select("app", F.col("module").alias("by"), "prefix")), ["app", "by"]).select("app", "module", F.concat("prefix", "pattern").alias("prefix"))
        new = settled(step.join(apart(found), ["app", "module"], "left_anti").distinct())
        found = found.unionByName(new)
    x = url.where("include = '' and name <> ''").join(apart(found), ["app", "module"], "left")
    return x.groupBy("app", F.col("name").alias("view")).agg(F.min(F.concat(F.lit("/"), F.coalesce("prefix", F.lit("")), "pattern")).alias("url"))


def permissions(seen: DataFrame, inherited: bool = True) -> DataFrame:
    """(app, path, name, line_start, permissions, distance): the permission classes of each view: its own, else those of its nearest base that states any."""
    own = ["app", "path", "name", "line_start"]
    v = seen.where("kind in ('class', 'function')").select(*own, (_d("states") == "1").alias("states"), _list("permissions").alias("permissions"), F.transform(_list("bases"), lambda b: F.element_at(F.split(b, r"\."), -1)).alias("bases"))
    v = settled(v)
    stated = v.where("states").select(*own, "permissions", F.lit(0).alias("distance"))
    if not inherited:
        return stated
    # the first definition of a name stands for it
    first = Window.partitionBy("app", "name").orderBy("path", "line_start")
    classes = settled(v.join(apart(seen.where("kind = 'class'").select(*own)), own, "left_semi").withColumn("_k", F.row_number().over(first)).where("_k = 1").select("app", F.col("name").alias("base"), F.col("states").alias("base_states"), F.col("permissions").alias("base_permissions"), F.col("bases").alias("base_bases")))
    open_ = v.where("not states").select(*own, "bases")
    for distance in range(1, MOST_BASES + 1):
        open_ = settled(open_.select(*own, F.posexplode("bases").alias("at", "base")).join(apart(classes), ["app", "base"]))
        if open_.isEmpty():
            break
        hit = open_.where("base_states").groupBy(*own).agg(F.min_by("base_permissions", F.struct("at", "base")).alias("permissions")).withColumn("distance", F.lit(distance))
        hit = settled(hit)
        stated = stated.unionByName(hit)
        open_ = open_.join(apart(hit), own, "left_anti").groupBy(*own).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "base_bases"))), lambda x: x["base_bases"])).alias("bases"))
    return stated


def views(known: DataFrame, seen: DataFrame, inherited: bool = True, owned: DataFrame | None = None) -> DataFrame:
    """Routed views with the columns of `code.routes`; known are the facts of `code.facts`, seen those of view_facts over the same files;
    owned (`code.owned_models`) may be given where it is known.

    A view is a top function whose first parameter is `request`, or a top class with a view's base, named in a URL file where the
    application has one. Sign-in counts from decorators, bases, permission classes, the body, called helpers and the project's default, which AllowAny lifts.
    """
    key = ["app", "path", "name", "line_start"]
    mentioned = seen.where("kind = 'mention'").select("app", "name").distinct()
    some = mentioned.select("app").distinct().withColumn("has_urls", F.lit(True))
    v = seen.where("kind in ('class', 'function')").where((_d("uses") == "1") & (_d("top") == "1") & ~F.col("path").rlike(V.NO_VIEW_FILE))
    shaped = F.when(F.col("kind") == "function", (_d("takes_request") == "1") & ~F.col("name").startswith("_")).otherwise(F.exists(_list("bases"), lambda b: b.rlike(V.VIEW_BASE)) & ~F.col("name").endswith("Mixin"))
    v = v.where(shaped).join(apart(mentioned.withColumn("routed", F.lit(True))), ["app", "name"], "left").join(apart(some), "app", "left").where("routed or has_urls is null").drop("routed", "has_urls")

    text = F.col("text")
    scheme = F.regexp_extract("text", r"(DEFAULT_PERMISSION_CLASSES[^\])]*)", 1)
    closed = (scheme.contains("IsAuthenticated") & ~scheme.contains("AllowAny")) | text.contains("LoginRequiredMiddleware")
    default = seen.where("kind = 'settings'").select("app", _d("text").alias("text")).groupBy("app").agg(F.max(closed).alias("closed"))
    columns = owner_columns_of(known, owned)
    first = seen.where("kind = 'class'").groupBy("app", "name").agg(F.min_by(_d("body"), F.struct("path", "line_start")).alias("class_body"))
    own_rank = enforces(F.col("class_body"), F.col("owner_columns"))
    asked = permissions(seen, inherited).select(*key, F.explode("permissions").alias("permission"))
    judged = asked.join(apart(first.withColumnRenamed("name", "permission")), ["app", "permission"], "left").join(apart(columns), "app", "left")
    role, login = F.col("permission").rlike(V.VIEW_ROLE), F.col("permission").rlike(V.VIEW_LOGIN)
    rank = F.when(F.col("class_body").isNotNull(), F.when(own_rank == 3, 3).when((own_rank == 2) | role, 2).otherwise(1)).when(role, 2).when(login, 1).otherwise(0)
    judged = judged.groupBy(*key).agg(F.max(F.when(rank == 3, 1).otherwise(rank)).alias("by_permission"), F.max(rank == 3).alias("owner_class"), F.max(F.col("permission") == "AllowAny").alias("public"), F.array_join(F.array_sort(F.collect_set("permission")), " ").alias("asked"))

    called_ = v.select(*key, F.explode(_list("calls")).alias("helper"))
    strong = helper_strength(known, columns=columns).where("rank > 0").withColumnRenamed("name", "helper")
    helpers = called_.join(apart(strong), ["app", "helper"]).groupBy(*key).agg(F.collect_set("rank").alias("kinds"))
    bodies = known.where("kind = 'function' and detail['method'] = '0'").groupBy("app", F.col("name").alias("helper")).agg(F.min_by(_d("body"), F.struct("path", "line_start")).alias("helper_body"))
    texts = called_.join(apart(bodies), ["app", "helper"]).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("helper_body")), "\n").alias("helper_text"))

    x = v.join(apart(default), "app", "left").join(apart(columns), "app", "left").join(apart(judged), key, "left").join(apart(helpers), key, "left").join(apart(texts), key, "left")
    x = x.join(apart(url_paths(seen).withColumnRenamed("view", "name")), ["app", "name"], "left")
    x = x.withColumns({"body": _d("body"), "bases": _list("bases"), "methods": _list("methods"), "_kinds": F.coalesce("kinds", F.array().cast("array<int>"))})
    body, is_class = F.col("body"), F.col("kind") == "class"
    guards = F.concat(_list("guards"), F.col("bases"))
    by_guard = F.when(F.exists(guards, lambda g: g.rlike(V.VIEW_ROLE) & ~g.endswith("api_view") & ~g.contains("csrf")), 2).when(F.exists(guards, lambda g: g.rlike(V.VIEW_LOGIN)), 1).otherwise(0)
    inner = _list("inner_guards")
    by_inner = F.when(F.exists(inner, lambda g: g.rlike(V.VIEW_ROLE) & ~F.substring_index(g, "(", 1).contains("action")), 2).when(F.exists(inner, lambda g: g.rlike(V.VIEW_LOGIN)), 1).otherwise(0)
    by_body = F.when(body.rlike(V.VIEW_ROLE_BODY) & body.rlike(V.VIEW_REFUSES), 2).when(body.rlike(V.VIEW_LOGIN_BODY), 1).otherwise(0)
    level = F.greatest(by_guard, by_inner, by_body, F.coalesce("by_permission", F.lit(0)))
    level = F.when((level == 0) & F.coalesce("closed", F.lit(False)) & ~F.coalesce("public", F.lit(False)), 1).otherwise(level)
    has = lambda k: F.array_contains("_kinds", k)
    x = x.withColumn("_level", level)
    level = F.when((F.col("_level") < 2) & has(2), 2).when((F.col("_level") == 0) & has(1), 1).otherwise(F.col("_level"))

    both, by_request = F.concat_ws("\n", "body", "helper_text"), body.rlike(V.REQUEST_OWNER)
    cols, user = F.coalesce("owner_columns", F.lit("-")), V.USER_ID
    column = F.concat(F.lit(r"\b(?:"), cols, F.lit(rf")\b\s*[=!]=\s*[^\n]*{user}|{user}[^\n]*[=!]=\s*[^\n]*\b(?:"), cols, F.lit(rf")\b|\b(?:"), cols, F.lit(rf")\s*=\s*{user}|\b(?i:"), cols, F.lit(r")\s*=\s*[?:%]"))
    scoped = F.rlike(both, column) | both.rlike(rf"[=!]=\s*{user}|{user}\s*[=!]=") | both.rlike(V.VIEW_SCOPED)
    owner = F.when(by_request, False).otherwise(scoped | has(3) | F.coalesce("owner_class", F.lit(False)))

    says = lambda *names: F.arrays_overlap("methods", F.array(*map(F.lit, names)))
    bases = F.array_join("bases", " ")
    verb = lambda c, v: F.when(c, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    of_class = F.concat(
        F.transform(F.array_intersect("methods", F.array(*map(F.lit, V.VIEW_VERBS))), F.upper), verb(says("create") | bases.rlike(V.WRITE_BASE), "POST"), verb(says("update", "partial_update"), "PUT"), verb(says("destroy"), "DELETE")
    )
    of_function = F.concat(_list("verbs"), F.transform(F.regexp_extract_all("body", F.lit(r"request\.method\s*==\s*['\"](\w+)['\"]")), F.upper))
    verbs = F.array_sort(F.array_distinct(F.when(is_class, of_class).otherwise(of_function)))
    verbs = F.when(F.size(verbs) == 0, F.array(F.lit("GET"))).otherwise(verbs)
    ids = F.filter(_list("params"), lambda p: p.rlike(V.ID_PARAMETER))
    data = F.transform(F.regexp_extract_all("body", F.lit(r"request\.(?:GET|POST|data|query_params)(?:\.get\(|\[)\s*['\"](\w*id|pk)['\"]")), lambda k: F.concat(k, F.lit(" (request data)")))
    kw = F.regexp_extract_all("body", F.lit(r"kwargs(?:\.get\(|\[)\s*['\"](\w+)['\"]"))
    detail = verb(bases.rlike(V.DETAIL_BASE) | says("retrieve", "update", "partial_update", "destroy", "get_object"), "pk (object lookup)")
    ids = F.concat(ids, F.when(is_class, F.concat(kw, detail)).otherwise(data), verb(by_request, "(request data)"))
    changes = F.arrays_overlap(verbs, F.array(*map(F.lit, ("POST", "PUT", "PATCH", "DELETE")))) | body.rlike(V.VIEW_WRITES)
    return settled(x.select(
        "app", "path", F.col("name").alias("function"), "line_start", "line_end", F.coalesce("url", F.lit("")).alias("url"), verbs.alias("methods"), "body", both.alias("reached"),
        F.element_at(F.array(*map(F.lit, ("none", "login", "role"))), level + 1).alias("auth"), changes.alias("writes"), owner.alias("owner_check"), F.array_sort(F.array_distinct(ids)).alias("id_params"),
        F.concat_ws(" ", F.array_join(F.transform(F.concat(guards, inner), lambda g: F.substring_index(g, "(", 1)), " "), "asked", F.when(by_body == 2, F.regexp_extract("body", V.VIEW_ROLE_BODY, 0)), _d("calls")).rlike(V.ADMIN_ONLY).alias("admin_only"),
    ))
