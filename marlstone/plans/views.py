"""Queries over views of Django applications, and over values that go through functions of several files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import code as C
from marlstone.operators import django as J
from marlstone.operators import flow as W
from marlstone.plans import query
from marlstone.sources.tables import table
from marlstone.sources.work import settled

#: An allotment: `$prefix`, `$default`, `$stated`, `$base` and `$check` differ from application to application.
GARDEN = {
    "garden/settings.py": 'REST_FRAMEWORK = {\n    "DEFAULT_PERMISSION_CLASSES": ["rest_framework.permissions.$default"],\n}\n',
    "garden/urls.py": 'from django.urls import include, path\n\nurlpatterns = [path("$prefix/", include("plots.urls")), path("hello/", hello)]\n',
    "plots/urls.py": (
        'from django.urls import path\n\nrouter.register("seeds", SeedViewSet)\n'
        'urlpatterns = [\n    path("plots/<int:plot_id>/", plot_page),\n    path("beds/<int:pk>/", BedView.as_view()),\n    path("tools/", ToolView.as_view()),\n]\n'
    ),
    "plots/models.py": (
        "from django.conf import settings\nfrom django.db import models\n\nclass Plot(models.Model):\n    owner = models.ForeignKey(settings.AUTH_USER_MODEL, on_delete=models.CASCADE)\n    size = models.IntegerField()\n\n"
        "class Bed(models.Model):\n    plot = models.ForeignKey('plots.Plot', on_delete=models.CASCADE)\n\nclass Tool(models.Model):\n    label = models.CharField(max_length=20)\n"
    ),
    "plots/permissions.py": "class OwnsPlot(BasePermission):\n    def has_object_permission(self, request, view, obj):\n        return obj.owner == request.user\n",
    "plots/bases.py": (
        "from rest_framework.permissions import *\nfrom rest_framework.views import APIView\n\nclass RootView(APIView):\n    permission_classes = [$stated]\n\nclass MidView(RootView):\n    pass\n\nclass NearView(MidView):\n    pass\n"
    ),
    "plots/views.py": (
        "from rest_framework import viewsets\nfrom rest_framework.views import APIView\n\ndef hello(request):\n    return page()\n\ndef spare(request, plot_id):\n    return Plot.objects.get(pk=plot_id)\n\n"
        "def plot_page(request, plot_id):\n    plot = get_object_or_404(Plot, pk=plot_id)\n    $check\n    plot.delete()\n\n"
        "class BedView($base):\n    def get(self, request, pk):\n        return Response(Bed.objects.get(pk=pk).plot_id)\n\n"
        "class ToolView(APIView):\n    def get(self, request):\n        return Response(list(Tool.objects.all()))\n\n"
        "class SeedViewSet(viewsets.ModelViewSet):\n    queryset = Plot.objects.all()\n    permission_classes = [OwnsPlot]\n"
    ),
}


def gardens(spark: SparkSession, d: str) -> DataFrame:
    """An application for each supplier; its nation's number decides prefix, default, permissions, bases and checks."""
    s, files = table(spark, d, "supplier"), spark.createDataFrame(list(GARDEN.items()), "path string, text string")
    x = s.select(F.concat(F.lit("app"), "s_suppkey").alias("app"), F.col("s_nationkey").alias("k")).join(F.broadcast(files))
    fill = {
        "$prefix": F.concat(F.lit("n"), "k"),
        "$default": F.when(F.col("k") % 2 == 0, "IsAuthenticated").otherwise("AllowAny"),
        "$stated": F.when(F.col("k") % 7 == 0, "IsAdminUser").when(F.col("k") % 7 == 1, "AllowAny").otherwise("IsAuthenticated"),
        "$base": F.element_at(F.array(*map(F.lit, ("RootView", "MidView", "NearView", "APIView"))), F.col("k") % 4 + 1),
        "$check": F.when(F.col("k") % 3 == 0, "if plot.owner != request.user: raise PermissionDenied").when(F.col("k") % 3 == 1, "if not request.user.is_staff: raise PermissionDenied").otherwise("pass"),
    }
    text = F.col("text")
    for mark, value in fill.items():
        text = F.replace(text, F.lit(mark), value)
    return x.select("app", "path", text.alias("text"))


#: What each application's views need: bed is the level of the permissions that BedView inherits.
_GARDENS = """WITH g AS (SELECT 'app' || s_suppkey AS app, s_nationkey AS k, CASE WHEN s_nationkey % 2 = 0 THEN 'login' ELSE 'none' END AS closed,
  CASE WHEN s_nationkey % 4 = 3 THEN CASE WHEN s_nationkey % 2 = 0 THEN 'login' ELSE 'none' END WHEN s_nationkey % 7 = 0 THEN 'role' WHEN s_nationkey % 7 = 1 THEN 'none' ELSE 'login' END AS bed FROM supplier)"""


@query(
    "django_views",
    f"""{_GARDENS} SELECT app, function, url, methods, auth, writes, owner_check, id_params FROM (
  SELECT app, 'hello' AS function, '/hello/' AS url, 'GET' AS methods, closed AS auth, false AS writes, false AS owner_check, '' AS id_params FROM g
  UNION ALL SELECT app, 'plot_page', '/n' || k || '/plots/<int:plot_id>/', 'GET', CASE WHEN k % 3 = 1 THEN 'role' ELSE closed END, true, k % 3 = 0, 'plot_id' FROM g
  UNION ALL SELECT app, 'BedView', '/n' || k || '/beds/<int:pk>/', 'GET', bed, false, false, 'pk' FROM g
  UNION ALL SELECT app, 'ToolView', '/n' || k || '/tools/', 'GET', closed, false, false, '' FROM g
  UNION ALL SELECT app, 'SeedViewSet', '/n' || k || '/seeds/', 'POST', 'login', true, true, 'pk (object lookup)' FROM g)""",
)
def django_views(spark: SparkSession, d: str) -> DataFrame:
    files = gardens(spark, d)
    v = J.views(settled(C.facts(files)), settled(J.view_facts(files)))
    return v.select("app", "function", "url", F.array_join("methods", ",").alias("methods"), "auth", "writes", "owner_check", F.array_join("id_params", ",").alias("id_params"))


@query(
    "django_candidates",
    f"""{_GARDENS} SELECT app, function, model, auth, siblings::BIGINT AS siblings, priority::INT AS priority FROM (
  SELECT app, 'plot_page' AS function, 'Plot' AS model, closed AS auth, 1 AS siblings, 0 AS priority FROM g WHERE k % 3 = 2
  UNION ALL SELECT app, 'BedView', 'Bed', bed, 0, 1 FROM g WHERE bed = 'login')""",
)
def django_candidates(spark: SparkSession, d: str) -> DataFrame:
    files = gardens(spark, d)
    known = settled(C.facts(files))
    owned = settled(C.owned_models(known))
    found = C.idor_candidates(known, J.views(known, settled(J.view_facts(files)), owned=owned), owned=owned)
    return found.select("app", "function", "model", "auth", "siblings", "priority")


#: A handler and six functions in files of their own, each of which calls the next.
_STEPS = 6


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """An application for each supplier: a path goes through so many functions as its nation says, and one of its supplier's number makes a number of it."""
    s = table(spark, d, "supplier").select(F.concat(F.lit("app"), "s_suppkey").alias("app"), (F.col("s_nationkey") % _STEPS).alias("last"), (F.col("s_suppkey") % (_STEPS + 3)).cast("int").alias("cut"))
    i = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i")
    x = s.select("app", "last", "cut", i)
    name = lambda k: F.concat(F.lit("step"), k.cast("string"))
    value = F.when(F.col("i") == F.col("cut"), F.concat(F.lit("int(p)"))).otherwise("p")
    ends = F.when(F.col("i") == F.col("last"), "open(q)").otherwise(F.concat(name(F.col("i") + 1), F.lit("(q)")))
    body = F.concat(F.lit("def "), name(F.col("i")), F.lit("(p):\n    q = "), value, F.lit("\n    return "), ends, F.lit("\n"))
    start = s.select("app", F.lit("start.py").alias("path"), F.lit("def start(request):\n    step0(request.args['p'])\n").alias("text"))
    return start.unionByName(x.select("app", F.concat(name(F.col("i")), F.lit(".py")).alias("path"), body.alias("text")))


_CHAIN_SQL = f"""WITH s AS (SELECT 'app' || s_suppkey AS app, s_nationkey % {_STEPS} AS last, s_suppkey % {_STEPS + 3} AS cut FROM supplier),
  fed AS (SELECT app, last, cut, unnest(range(least(last, cut) + 1)) AS i FROM s)"""


@query("fed_functions", f"{_CHAIN_SQL} SELECT app, 'step' || i AS function, i::INT AS hops FROM fed")
def fed_functions(spark: SparkSession, d: str) -> DataFrame:
    """The application's functions behind a request, however many files lie between; one that cleans the value hands on nothing."""
    known = settled(C.facts(_chains(spark, d)))
    return W.fed_functions(known).join(C.symbols(known).select("app", F.col("name").alias("function")), ["app", "function"], "left_semi")


@query("far_sinks", f"{_CHAIN_SQL} SELECT app, 'step' || last || '.py' AS path, 'step' || last AS function, 'path_traversal' AS family, 1::INT AS priority FROM s WHERE cut > last")
def far_sinks(spark: SparkSession, d: str) -> DataFrame:
    return C.sinks(settled(C.facts(_chains(spark, d)))).select("app", "path", "function", "family", "priority")
