"""Django views, permissions that are inherited, included URL files, and values that go through functions."""

import pytest

from marlstone.operators import code as C
from marlstone.operators import django as J
from marlstone.operators import flow as W

LIBRARY = {
    "site/settings.py": "REST_FRAMEWORK = {'DEFAULT_PERMISSION_CLASSES': ['rest_framework.permissions.IsAuthenticated']}\n",
    "site/urls.py": "urlpatterns = [path('', include('loans.urls')), re_path('^x/', include('site.extra.urls'))]\n",
    "site/extra/urls.py": "urlpatterns = [path('again/', include('loans.urls')), path('open/', notice), path('self/', include('site.extra.urls'))]\n",
    "loans/urls.py": "urlpatterns = [path('loan/<int:pk>/', loan), path('mine/<int:pk>/', views.my_loan), path('move/<int:pk>/', move), path('desk/', DeskView.as_view()), path('shelf/<int:pk>/', ShelfView.as_view()), path('odd/', odd)]\nrouter.register('loans', LoanViewSet)\n",
    "loans/models.py": "class Loan(models.Model):\n    borrower = models.ForeignKey(get_user_model(), on_delete=models.CASCADE)\n    tags = models.ManyToManyField('loans.Tag')\n",
    "loans/views.py": """from django.utils.decorators import method_decorator
from rest_framework import viewsets

def for_user(user, pk):
    loan = Loan.objects.get(pk=pk)
    if loan.borrower != user:
        raise PermissionDenied
    return loan

def loan(request, pk):
    return show(Loan.objects.get(pk=pk))

def my_loan(request, pk):
    return show(for_user(request.user, pk))

@permission_classes([IsAuthenticated])
def move(request, pk):
    loan = Loan.objects.get(pk=pk)
    loan.borrower_id = request.data["user_id"]
    loan.save()

def unrouted(request, pk):
    return Loan.objects.get(pk=pk).delete()

@api_view(["GET"])
@permission_classes([AllowAny])
def notice(request):
    return Response("hello")

class Own(viewsets.GenericViewSet):
    permission_classes = [AllowAny]

class Base(Own):
    permission_classes = [IsAdminUser]

class Between(Base):
    pass

class LoanViewSet(Between, viewsets.ModelViewSet):
    queryset = Loan.objects.all()

class DeskView(UserPassesTestMixin, View):
    def get(self, request):
        return Response(Loan.objects.all())

class ShelfView(View):
    @method_decorator(login_required)
    def post(self, request, pk):
        Loan.objects.get(pk=pk).delete()
""",
    "loans/broken.py": "def view(request:\n",
}


def table(spark, files, app="a"):
    return spark.createDataFrame([(app, p, t) for p, t in files.items()], "app string, path string, text string")


@pytest.fixture(scope="module")
def library(spark):
    files = table(spark, LIBRARY).unionByName(table(spark, {"v.py": "import django\ndef loan(request, id):\n    return request.user.is_authenticated\n", "n.py": None}, "no_urls"))
    known, seen = C.facts(files).cache(), J.view_facts(files).cache()
    return known, seen, {(r.app, r.function): r for r in J.views(known, seen).collect()}


def test_views(spark, library):
    known, seen, v = library
    assert {f for a, f in v if a == "a"} == {"loan", "my_loan", "move", "notice", "LoanViewSet", "DeskView", "ShelfView"}  # unrouted and helpers are none
    at = {f: (r.url, r.auth, r.owner_check, r.writes) for (a, f), r in v.items() if a == "a"}
    assert at["loan"] == ("/loan/<int:pk>/", "login", False, False)  # the project's default
    assert at["my_loan"] == ("/mine/<int:pk>/", "login", True, False)  # a helper compares the owner
    assert at["move"] == ("/move/<int:pk>/", "login", False, True)  # an owner out of the request is no check
    assert at["notice"] == ("/^x/open/", "none", False, False)  # AllowAny lifts the default
    assert at["LoanViewSet"][:2] == ("/loans/", "role")  # nearest base with permissions, two steps up
    assert at["DeskView"][1] == "role"
    assert at["ShelfView"][1] == "login"
    assert v["a", "ShelfView"].methods == ["POST"]
    assert "user_id (request data)" in v["a", "move"].id_params
    assert (v["no_urls", "loan"].auth, v["no_urls", "loan"].url) == ("login", "")
    found = {r.function for r in C.idor_candidates(known, J.views(known, seen)).collect()}
    assert found == {"loan", "move", "ShelfView"}


def test_inheritance(spark, library):
    _, seen, _ = library
    own = {r.name for r in J.permissions(seen, inherited=False).collect()}
    assert own == {"Own", "Base", "move", "notice"}
    far = {r.name: (r.permissions, r.distance) for r in J.permissions(seen).collect()}
    assert far["LoanViewSet"] == (["IsAdminUser"], 2)
    assert far["Between"] == (["IsAdminUser"], 1)
    ring = table(spark, {"x.py": "import django\nclass A(B): pass\nclass B(A): pass\n"})
    assert J.permissions(J.view_facts(ring)).collect() == []


def test_empty(spark):
    none = spark.createDataFrame([], "app string, path string, text string")
    assert J.views(C.facts(none), J.view_facts(none)).collect() == []
    assert W.fed_functions(C.facts(none)).collect() == []


def test_values_through_three_functions_of_two_files(spark):
    files = {
        "web.py": "def page(request):\n    first(request.args['f'])\ndef third(r):\n    return open(r)\ndef lone(s):\n    return open(s)\n",
        "lib.py": "def first(p):\n    q = p.strip()\n    second(q)\ndef second(x):\n    y = z = x\n    third(z)\n    lone(int(x))\ndef loop(a):\n    loop(a)\n",
    }
    known = C.facts(table(spark, files)).cache()
    hops = {r.function: r.hops for r in W.fed_functions(known).collect()}
    assert {k: v for k, v in hops.items() if k in ("first", "second", "third", "lone", "loop")} == {"first": 0, "second": 1, "third": 2}
    assert [(r.path, r.function, r.priority) for r in C.sinks(known).collect()] == [("web.py", "third", 1)]


def test_roots_of_expressions():
    import ast

    tree = ast.parse("def f(a, b, request_id, db):\n  c = a\n  d = c + 'x'\n  e = d\n  g = len(e)\n  for h in e: pass\n  with open(h) as k: m = k.read()\n  n = row.filter(a)\n  o = settings.X\n  p = request.form['q']\n  a = p\n")
    scope = W.Scope(tree.body[0], False)
    level = lambda x: scope.level([ast.parse(x, mode="eval").body])
    got = [level(x) for x in ("a", "e", "g", "h", "m", "n", "o", "p", "request_id", "db", "unknown(a)", "f'{e}{p}'", "b.stem", "[b, 1]", "b[0].upper()", "lambda: b")]
    assert got == [1, 1, None, 1, None, None, None, 0, 0, None, None, 0, None, 1, 1, 1]
    assert [len(W.pieces(ast.parse(x, mode="eval").body)) for x in ("f'{a}b{c}'", "f'a'", "'%s' % a", "a % 2", "'a' + b", "'{}'.format(a)", "'a'.format()", "a * b")] == [2, 0, 1, 0, 1, 1, 0, 0]
