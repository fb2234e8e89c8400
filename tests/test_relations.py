"""Path matching, link tiers, mounted routers, contract hints, model fields, numbering."""

import pytest
from pyspark.sql import functions as F

from factloom import catalogue
from factloom.functions import text as T
from factloom.operators import extract as X
from factloom.operators import link
from factloom.operators import relate as R
from factloom.operators.classify import classify
from factloom.operators.contracts import body_of, contract_details, details, signature, status_code
from factloom.operators.link import link_calls
from factloom.operators.ordered import numbered_within


def test_parts_and_variants(spark):
    one = spark.createDataFrame([("/a/:id/{Name}/<x>/[s]/*rest/(*all)/*/12/0a1b2c3d4e/v2/w-x/é",)], "p string").select(T.parsed(F.col("p")).alias("x")).first().x
    assert [(p["kind"], p["name"]) for p in one] == [("word", None), ("param", "id"), ("param", "name"), ("param", "x"), ("param", "s"), ("param", "rest"), ("param", "all"), ("rest", None), ("id", None), ("id", None), ("version", None), ("word", None), ("other", None)]
    paths = ["/a(/:b)(/c)", "/a/(b)", "/x", "/a(/b(/c))"]
    got = [r.v for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(T.optional_variants(F.col("p")).alias("v")).collect()]
    assert [set(x) for x in got] == [{"/a", "/a/:b", "/a/c", "/a/:b/c"}, {"/a", "/a/b"}, {"/x"}, {"/a", "/a/b", "/a/b/c"}]


ROUTES = [
    ("GET", "/api/users/:id", "express", "getUser", "route"), ("GET", "/posts/:post_id/comments", "rails", "comments#index", "route"), ("GET", "/cats/:id", "rails", "cats#show", "rails-resource-member-route"),
    ("GET", "/about", "rails", "static#show", "route"), ("GET", "/contact", "rails", "static#show", "route"), ("GET", "/files/:id/raw.json", "rails", "files#raw", "route"), ("POST", "/api/login", "express", "login", "route"), ("GET", "/trpc/user.list", "trpc", None, "route"),
]
CALLS = [
    ("/api/users/12", "GET", "fetch", "a.js", "param", "/api/users/:id"), ("/posts/my-first-post/comments", "GET", "fetch", "a.js", "rails-anchored-param", "/posts/:post_id/comments"), ("/cats/tom", "GET", "fetch", "a.js", "rails-resource-text-id-param", "/cats/:id"),
    ("/cats/tom.json", "GET", "fetch", "a.js", "rails-resource-text-id-param", "/cats/:id"), ("/posts/my-post/comments.json", "GET", "fetch", "a.js", "rails-anchored-param-format-suffix", "/posts/:post_id/comments"), ("/:page.html", "GET", "fetch", "web/static/x.js", "static-page-family", "/about"),
    ("/:page.html", "GET", "axios", "web/x.js", "unmatched", None), ("/api/login", "GET", "fetch", "a.js", "method-mismatch", "/api/login"), ("https://h.example/x", "GET", "fetch", "a.js", "external-url", None), ("/nowhere", "GET", "fetch", "a.js", "unmatched", None),
]


def test_link_tiers(spark):
    routes = spark.createDataFrame([(i, *r, None) for i, r in enumerate(ROUTES)], "route_id long, method string, path string, framework string, handler string, kind string, route_name string")
    calls = spark.createDataFrame([(i, s, e, m, c) for i, (e, m, c, s, _, _) in enumerate(CALLS)], "call_id long, source string, endpoint string, method string, client string")
    got = {r.call_id: (r.match_type, r.matched_route) for r in link_calls(calls, routes).collect()}
    assert got == {i: (kind, route) for i, (*_, kind, route) in enumerate(CALLS)}


FILES = {
    "srv/app.js": "const users = require('./users');\nconst admin = require('./admin');\napp.use('/api', auth, users);\napp.use('/v2', users);\napp.use('/admin', admin);\n",
    "srv/users.js": "router.get('/:id', getUser);\nfunction getUser(req, res) {\n  const n = req.params.id;\n  if (!n) throw new Error('x');\n  res.status(404).json({});\n}\n",
    "srv/admin.js": "const inner = require('./inner');\nrouter.use('/deep', inner);\nrouter.post('/x', (req, res) => {\n  res.send(req.body.name);\n});\n",
    "srv/inner.js": "router.get('/end', done);\n",
    "srv/alone.js": "router.get('/alone', done);\n",
    "py/main.py": "from routers import items, users as people\nfrom .web import bp\napp.include_router(items.router, prefix='/shop')\napp.include_router(\n    people.router,\n)\napp.register_blueprint(bp, url_prefix='/web')\n",
    "py/routers/items.py": "router = APIRouter(\n    prefix='/items',\n)\n\n@router.get('/{item_id}', response_model=Item)\nasync def read_item(item_id: int, q: Optional[str] = None, body: Item = Body()):\n    raise HTTPException(404)\n",
    "py/routers/users.py": "router = APIRouter()\n@router.get('/me')\ndef me():\n    pass\n",
    "py/web.py": "bp = Blueprint('web', __name__)\n@bp.route('/home')\ndef home():\n    return jsonify(request.args.get('p')), 201\n",
    "proj/urls.py": "urlpatterns = [\n  path('shop/', include('shop.urls')),\n]\n",
    "shop/urls.py": "urlpatterns = [path('list/', views.listing)]\n",
    "go/main.go": "func main() {\n  r := gin.Default()\n  v1 := r.Group(\"/v1\")\n  in := v1.Group(\"/in\")\n  v1.GET(\"/a\", one)\n  in.POST(\"/b\", two)\n  r.GET(\"/c\", three)\n}\nfunc one(c *gin.Context) {\n  c.JSON(http.StatusNotFound, gin.H{\"k\": c.Param(\"id\")})\n}\n",
    "java/Two.java": "@RestController\n@RequestMapping(\"/one\")\nclass A {\n  @GetMapping(\"/x\")\n  public String x() { return \"\"; }\n}\n@RequestMapping(\"/two\")\nclass B {\n  @PostMapping(\"/y\")\n  @ResponseStatus(HttpStatus.CREATED)\n  public List<String> y(@RequestBody Thing t) { throw new Bad(); }\n}\n",
    "app/shop/[id]/route.ts": "export async function GET(req) {\n  return NextResponse.json({});\n}\n",
    "src/routes/items/[id]/+server.ts": "export async function POST({ request }) {}\n",
    "app/(group)/cart/page.tsx": "export default function Page() {}\n",
    "models.py": "class A(BaseModel):\n    name: str\n    n: int = 1\n\nclass B(BaseModel):\n    pass\n",
    "schema.prisma": "model User {\n  id Int @id\n  name String\n}\nmodel Empty {\n}\n",
    ".github/workflows/ci.yml": "on: push\njobs:\n  build:\n    steps:\n      - uses: actions/checkout@v4\n        env:\n          T: ${{ secrets.TOKEN }}\n",
    "k8s/app.yaml": "kind: Deployment\nmetadata:\n  name: web\nspec:\n  image: repo/web:1\n",
    "src/main/resources/application.yml": "server:\n  port: 80\n",
    "other.yaml": "kind: Nothing\n  build:\nuses: x\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return classify(spark.createDataFrame(list(FILES.items()), "path string, content string")).cache()


@pytest.fixture(scope="module")
def routes(files):
    return X.api_routes(files).cache()


def test_mounted_routes(routes):
    got = {(r.framework, r.method, r.path, r.evidence.file) for r in routes.collect()}
    assert got == {
        ("express", "GET", "/api/:id", "srv/users.js"), ("express", "GET", "/v2/:id", "srv/users.js"), ("express", "POST", "/admin/x", "srv/admin.js"), ("express", "GET", "/admin/deep/end", "srv/inner.js"), ("express", "GET", "/alone", "srv/alone.js"),
        ("fastapi", "GET", "/shop/items/{item_id}", "py/routers/items.py"), ("fastapi", "GET", "/me", "py/routers/users.py"), ("flask", "GET", "/web/home", "py/web.py"), ("django", "ANY", "/shop/list", "shop/urls.py"),
        ("gin", "GET", "/v1/a", "go/main.go"), ("gin", "POST", "/v1/in/b", "go/main.go"), ("gin", "GET", "/c", "go/main.go"), ("spring", "GET", "/one/x", "java/Two.java"), ("spring", "POST", "/two/y", "java/Two.java"),
        ("next-app", "GET", "/shop/:id", "app/shop/[id]/route.ts"), ("sveltekit", "POST", "/items/:id", "src/routes/items/[id]/+server.ts"),
    }


def test_contract_hints(files, routes):
    got = {(r.method, r.path): (r.request_hints, r.response_hints, r.status_codes, r.error_hints) for r in contract_details(files, routes).collect()}
    assert got["GET", "/api/:id"] == (["path:req.params.id"], ["response:res.json"], ["404"], ["error:throw new", "error:4xx-or-5xx-status"])
    assert got["POST", "/admin/x"] == (["body:req.body.name"], ["response:res.send"], [], [])
    assert got["GET", "/shop/items/{item_id}"] == (["path:item_id", "path:item_id:int", "query:q:Optional[str]", "body:body:Item"], ["response_model:Item"], [], ["error:HTTPException", "error:raise ", "error:4xx-or-5xx-status"])
    assert got["GET", "/web/home"] == (["query:request.args.p"], ["response:jsonify"], ["201"], [])
    assert got["GET", "/v1/a"] == (["path:id"], ["response-key:k", "response:c.JSON"], ["404"], [])
    assert got["POST", "/two/y"] == (["body:Thing"], ["return:List<String>"], ["201"], ["error:throw new"])
    assert got["GET", "/shop/:id"][1] == ["response:NextResponse.json"]


def test_hint_helpers():
    assert [status_code(x) for x in ("404", "HTTP_201_CREATED", "NOT_FOUND", "NotFound", "StatusTeapotless", ":created")] == ["404", "201", "404", "404", "StatusTeapotless", "201"]
    assert signature("def f(self, a: Dict[str, int] = {}, *b, c: Model | None = None):", "f", "/x/{c}") == ["query:a:Dict[str, int]", "query:b", "path:c:Model | None"]
    assert body_of("x\nfunction go() {\n  a\n}\nrest".split("\n"), "go") == ["function go() {", "  a", "}"] and body_of(["x"], "go") == []
    assert details("", "unknown", None, "/a")["request"] == []


def test_model_fields(files):
    got = {r.name: (r.kind, r.fields) for r in X.data_models(files).collect()}
    assert got["A"] == ("pydantic", ["name", "n"]) and got["B"] == ("pydantic", []) and got["User"] == ("prisma", ["id", "name"]) and got["Empty"] == ("prisma", [])


def test_runtime_by_path(files):
    got = {(r.kind, r.name, r.path) for r in X.named(files, "runtime").collect()}
    assert {("github-action", "actions/checkout@v4"), ("github-job", "build"), ("github-secret", "TOKEN"), ("kubernetes-kind", "Deployment"), ("kubernetes-name", "web"), ("kubernetes-image", "repo/web:1"), ("spring-config", "server"), ("spring-config", "port")} == {(k, n) for k, n, _ in got}
    assert "other.yaml" not in {p for _, _, p in got}
    pages = files.select("path", X.file_route(F.col("path"), "frontend").alias("r")).filter("r is not null")
    assert {(r.r.label, r.r.route) for r in pages.collect()} == {("next-app", "/cart")}


def test_numbers_within_prefixes(spark):
    rows = [("A", f"c{i % 700:04d}") for i in range(1100)] + [("B", "x"), ("B", "a")]
    got = numbered_within(spark.createDataFrame(rows, "p string, c string").repartition(5), "p", ["c"]).collect()
    want = [f"A-{i:03d}" for i in range(1, 1101)]
    assert [r.claim_id for r in sorted((r for r in got if r.p == "A"), key=lambda r: (r.c, int(r.claim_id[2:])))] == want
    assert {(r.claim_id, r.c) for r in got if r.p == "B"} == {("B-001", "a"), ("B-002", "x")}


def test_mounts_end_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "y"), ("c", "b", "z"), ("a", "b", "w")], "parent string, child string, prefix string")
    got = R.mount_closure(edges, spark.createDataFrame([("a",)], "node string")).collect()
    assert {(r.node, r.prefix, r.depth) for r in got} == {("a", "", 0), ("b", "/x", 1), ("b", "/w", 1), ("c", "/x/y", 2), ("c", "/w/y", 2)}


def test_links_make_no_pairs_of_paths_that_begin_alike(spark, monkeypatch):
    """2,000 projects behind one first part, and one path that 2,000 routes share: candidates stay a few a call, and the least route is chosen."""
    n, pairs, join = 2000, [], link._same_shape

    def counted(*args):
        out = join(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(link, "_same_shape", counted)
    ids = spark.range(n)
    own = ids.select((F.col("id") + n).alias("route_id"), F.lit("GET").alias("method"), F.concat(F.lit("/api/p"), "id", F.lit("/users/:id")).alias("path"))
    shared = ids.select("id", F.lit("GET"), F.concat(F.lit("/api/all/{x"), "id", F.lit("}/end")))
    routes = own.union(shared).select("*", F.lit("express").alias("framework"), F.lit(None).cast("string").alias("handler"), F.lit(None).cast("string").alias("route_name"))
    calls = ids.select(F.col("id").alias("call_id"), F.explode(F.array(F.concat(F.lit("/api/p"), "id", F.lit("/users/7")), F.concat(F.lit("/api/all/"), "id", F.lit("/end")))).alias("endpoint"))
    calls = calls.select("call_id", F.lit("a.js").alias("source"), "endpoint", F.lit("GET").alias("method"), F.lit("fetch").alias("client"))
    got = link_calls(calls, routes).withColumn("own", F.col("matched_route") == F.concat(F.lit("/api/p"), "call_id", F.lit("/users/:id")))
    assert {(r.match_type, r.own, r.shared): r["count"] for r in got.groupBy("match_type", "own", (F.col("matched_route") == "/api/all/{x0}/end").alias("shared")).count().collect()} == {("param", True, False): n, ("param", False, True): n}
    assert max(pairs) <= 4 * n


def test_targets_that_share_a_key_cost_no_pairs(spark, monkeypatch):
    """Forty targets of one term and forty tests that hold it: one row stands for the targets, and the least of them is chosen as before."""
    files = spark.createDataFrame([(f"tests/widget{k}.test.js", "test", 10, "use('widget');") for k in range(40)] + [("tests/a.test.js", "test", 10, "get('/x');")], "path string, role string, size_bytes long, content string")
    routes = spark.createDataFrame([(m, "/x") for m in ("PUT", "GET", "POST")], "method string, path string")
    targets = spark.createDataFrame([("service", f"WidgetStore{k}", 1) for k in range(40)] + [("data-model", "WidgetModel", 3)], "kind string, name string, ord long")
    joined = []
    own = type(targets).join

    def join(left, right, *a, **kw):
        joined.append(own(left, right, *a, **kw))
        return joined[-1]

    monkeypatch.setattr(type(targets), "join", join)
    rows = R.test_maps(files, routes, targets).collect()
    assert {(r.target_kind, r.target, r.confidence) for r in rows if "widget" in r.test_path} == {("service", "WidgetStore0", "medium")}
    assert [(r.target, r.confidence) for r in rows if r.test_path == "tests/a.test.js"] == [("GET /x", "high")] and len(rows) == 41
    assert max(df.count() for df in joined) <= 41


def test_service_corpus_is_classified_and_scanned_once(spark, monkeypatch):
    """The classified files and the matches are stored before anything derives from them."""
    kept, scanned = [], []
    own, store = X.extract, catalogue.stored
    monkeypatch.setattr(X, "extract", lambda files, *a, **kw: scanned.append(any(files is k for k in kept)) or own(files, *a, **kw))
    monkeypatch.setattr(catalogue, "stored", lambda df, what: kept.append(store(df, what)) or kept[-1])
    for name in ("test_targets", "gap_evidence", "boundary_sizes"):
        scanned.clear()
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        assert scanned == [True]
