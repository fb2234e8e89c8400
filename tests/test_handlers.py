"""Bodies of handlers, and the files that routes' handlers lead to."""

import pytest

from factloom.operators import extract as X
from factloom.operators.classify import classify
from factloom.operators.handlers import all_contract_details, cross_file_details, function_body, handler_candidates

SCRIPT = """const x = { list: 1 };
// exports.list = no
exports.list = asyncHandler(async (req, res) => {
  res.json({ a: '}' }); // }
});
exports.make = async ({ body }, res) => {
  if (body) { res.status(201).json('}'); }
};
class C {
  async show(req, res) {
    res.send('x');
  }
}
const arrow = (req, res) => res.json({
  z: 1,
});
module.exports = function (req, res) {
  res.end();
}
"""


@pytest.mark.parametrize(
    ("language", "text", "name", "want"),
    [
        ("javascript", SCRIPT, "list", "exports.list = asyncHandler(async (req, res) => {\n  res.json({ a: '}' }); \n})"),
        ("javascript", SCRIPT, "make", "exports.make = async ({ body }, res) => {\n  if (body) { res.status(201).json('}'); }\n}"),
        ("javascript", SCRIPT, "show", "  async show(req, res) {\n    res.send('x');\n  }"),
        ("javascript", SCRIPT, "arrow", "const arrow = (req, res) => res.json({\n  z: 1,\n})"),
        ("javascript", SCRIPT, "default", "module.exports = function (req, res) {\n  res.end();\n}"),
        ("javascript", SCRIPT, "none", None),
        ("javascript", "", "none", None),
        ("python", 'def f(a):\n    """def g(): 1"""\n    return 1  # x\n\ndef h(): pass\n', "f", "def f(a):\n    \n    return 1  \n\n"),
        ("python", 'def f(a):\n    """def g(): 1"""\n', "g", None),
        ("ruby", "class A\n  def index\n    if x\n      1\n    end\n  end\n  def show\n  end\nend\n", "index", "  def index\n    if x\n      1\n    end\n  end"),
        ("go", "func (s *S) Get(c *gin.Context) {\n\tx := \"}\"\n}\nfunc Set() {}\n", "Get", "func (s *S) Get(c *gin.Context) {\n\tx := \"}\"\n}"),
        ("php", "<?php\nclass U {\n  public function index(Request $r): View\n  {\n    return 1;\n  }\n}", "index", "  public function index(Request $r): View\n  {\n    return 1;\n  }"),
        ("elixir", "  def index(conn, _) do\n    render(conn)\n  end\n", "index", "  def index(conn, _) do\n    render(conn)\n  end"),
        ("rust", "pub async fn list(q: Query<P>) -> Json<X> {\n  Json(1)\n}\n", "list", "pub async fn list(q: Query<P>) -> Json<X> {\n  Json(1)\n}"),
    ],
)
def test_function_body(language, text, name, want):
    assert function_body(text, language, name) == want


FILES = {
    "web/routes.ts": "import * as users from './users';\nimport { drop as remove, type X } from './more';\nimport only from './only';\napp.get('/a', users.list);\napp.delete('/b', remove);\napp.post('/c', only);\napp.put('/d', here);\nfunction here(req, res) {\n  res.status(409).send(req.body.x);\n}\n",
    "web/users.ts": "export const list = (req, res) => {\n  res.json(req.query.q);\n};\n",
    "web/more/index.ts": "export function drop(req, res) { res.status(204).send(); }\n",
    "web/only.js": "export default async (req, res) => {\n  res.render('x');\n};\n",
    "one/routes/web.php": "<?php\nuse App\\Http\\Controllers\\UserController;\nRoute::get('/users', [UserController::class, 'index']);\n",
    "one/app/Http/Controllers/UserController.php": "<?php\nclass UserController {\n  public function index(Request $request) {\n    return response()->json($request->input('q'));\n  }\n}\n",
    "two/app/Http/Controllers/UserController.php": "<?php\nclass UserController {\n  public function index() { return view('wrong'); }\n}\n",
    "ex/lib/router.ex": 'scope "/api" do\n  get "/u", App.UserController, :show\nend\n',
    "ex/lib/controllers/user_controller.ex": "def show(conn, _) do\n  conn |> put_status(404) |> json(%{})\nend\n",
    "rs/src/main.rs": 'App::new().route("/r", web::get().to(handlers::list))\n',
    "rs/src/handlers/mod.rs": "pub async fn list() -> HttpResponse {\n  HttpResponse::Created().finish()\n}\n",
    "dj/app/urls.py": "from app.views import Item\nfrom . import views\nurlpatterns = [path('i', Item.as_view()), path('j', views.j)]\n",
    "dj/app/views.py": "class Item(View):\n    def get(self, request):\n        return JsonResponse({})\n\ndef j(request):\n    return redirect('x')\n",
    "empty.py": "",
}


@pytest.fixture(scope="module")
def facts(spark):
    files = classify(spark.createDataFrame([*FILES.items(), ("null.py", None)], "path string, content string")).cache()
    raw = X.extract(files, X.ROUTE_FAMILIES).cache()
    return files, raw, X.api_routes(files, raw).cache()


def test_candidates(facts):
    files, raw, routes = facts
    got = {(r.handler, r.target, r.symbol) for r in handler_candidates(routes, raw, files).collect()}
    assert {("users.list", "web/users.ts", "list"), ("remove", "web/more/index.ts", "drop"), ("only", "web/only.js", "default"), ("UserController::class, 'index'", "one/app/Http/Controllers/UserController.php", "index"), ("App.UserController, :show", "ex/lib/controllers/user_controller.ex", "show"), ("handlers::list", "rs/src/handlers/mod.rs", "list"), ("views.j", "dj/app/views.py", "j")} <= got
    assert not [t for _, t, _ in got if t.startswith("two/")]


def test_hints_follow_handlers(facts):
    files, raw, routes = facts
    got = {r.path: (r.request_hints, r.response_hints, r.status_codes) for r in all_contract_details(files, routes, raw).collect()}
    assert got["/a"] == (["query:req.query.q"], ["response:res.json"], [])
    assert got["/b"] == ([], ["response:res.send"], ["204"])
    assert got["/c"] == ([], ["response:res.render"], [])
    assert got["/d"] == (["body:req.body.x"], ["response:res.send"], ["409"])
    assert got["/users"] == (["body:q"], ["response:json"], [])
    assert got["/api/u"][2] == ["404"]
    assert got["/r"][2] == ["201"]
    assert got["/j"][1] == ["response:redirect"]


def test_no_routes(facts):
    files, raw, routes = facts
    assert cross_file_details(files, routes.filter("false"), raw).count() == 0
