"""Queries over the structure of source text: comments and strings, blocks, scopes, bodies in other files, wrapped clients, trees.

Like those of the catalogue they read a corpus that both engines write from the tables, row by row, by the same string
functions; the SQL states what each file holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _spark_quotes, query
from .operators import extract as X
from .operators import relate as R
from .operators.classify import classify
from .operators.frontend_routes import frontend_routes
from .operators.handlers import all_contract_details
from .operators.lexing import block_tree, lexical_masks
from .operators.link import link_calls
from .operators.trees import openapi_routes, tree_facts, tree_nodes
from .operators.wrappers import resolved_api_calls
from .sources.tables import spread, stored, table


def _text(*lines: str) -> str:
    """SQL of a text whose lines are SQL strings; ``{k}`` stands for the key of the row."""
    return " || chr(10) || ".join(lines) + " || chr(10)"


def _line(template: str, key: str) -> str:
    """SQL of one line: ``{k}`` in the template is the row's key."""
    parts = ["'" + x.replace("'", "''").replace("${", "$' || '{") + "'" for x in template.split("{k}")]  # a name in ${ } is Spark's own
    return f" || {key} || ".join(parts)


#: the table whose rows the corpora are written from, and its key: a row is a project, its kind is told by the key
ROWS_OF, KEY = "embeddings", "vec_id"


def corpus(spark: SparkSession, sf_dir: str, files: list[tuple[int, str, str]]) -> DataFrame:
    """path, content of files given as (kind of project, path, text): ``{k}`` is the key of the row that is the project."""
    rows, kinds = spread(table(spark, sf_dir, ROWS_OF).select(KEY)), 1 + max(kind for kind, _, _ in files)
    written = []
    for kind in range(kinds):
        own = [(_line(path, KEY), _text(*(_line(x, KEY) for x in text.split("\n")))) for k, path, text in files if k == kind]
        both = F.array(*[F.struct(F.expr(_spark_quotes(path)).alias("path"), F.expr(_spark_quotes(text)).alias("content")) for path, text in own])
        written.append(F.when(F.pmod(KEY, F.lit(kinds)) == kind, both))
    return rows.select(F.explode(F.coalesce(*written)).alias("f")).select("f.path", "f.content")


def _rows(kind: int, kinds: int, path: str, *rows: tuple[str, ...]) -> str:
    """SQL of rows that one file of the corpus yields: its path and then each value of ``rows``, with ``{k}`` for the key; ``:`` begins a number, ``-`` is null."""
    def value(x: str) -> str:
        return "NULL" if x == "-" else f"CAST({x[1:]} AS INTEGER)" if x.startswith(":") else _line(x, KEY)

    return " UNION ALL ".join(f"SELECT {', '.join([_line(path, KEY), *map(value, r)])} FROM {ROWS_OF} WHERE {KEY} % {kinds} = {kind}" for r in rows)


def _sql(columns: str, *parts: str) -> str:
    return f"WITH t({columns}) AS ({' UNION ALL '.join(parts)}) SELECT * FROM t"


# ---------------------------------------------------------------- comments and strings

_PART = '''"""Docs of part {k}
def hidden_{k}():
    pass
"""
import mod_{k}  # import gone_{k}
# class Comment_{k}: pass
class Part_{k}:
    def size(self):
        return "def no_{k}(): pass"
text = \'\'\'
import never_{k}
class Never_{k}:
    pass
\'\'\'
def after_{k}(a, b):
    return r"x"'''
_SUPPLIER = """/* function dead_{k}() {}
class Dead_{k} {} */
// app.get('/no/{k}', nope)
const t{k} = `function inside_{k}() {} $""" + """{process.env.KEY_{k}} class Tick_{k} {}`;
function live_{k}() { return 'class Str_{k}'; } // function tail_{k}() {}
const slash{k} = /["'`]/g;
app.get('/s/{k}', live_{k});
import dep{k} from 'dep-{k}';"""
_NATION = """=begin
class Dead{k}
def dead_{k}
=end
require 'gem_{k}' # require 'no_{k}'
class Nation{k}
  def live_{k}
    sql = <<~SQL
      class Never{k}
      def never_{k}
    SQL
    "def str_{k}"
  end
end"""
_CUSTOMER = """/* a /* fn dead_{k}() */
fn dead2_{k}() */
fn live_{k}<'a>(x: &'a str) -> char { '"' }
const S: &str = r#"
fn never_{k}() "quoted"
"#;
struct Customer{k};"""
_REGION = """package r{k}
// func dead{k}() {}
var q = `
func never{k}() {}
`
func live{k}() { return }"""
MASKED = [
    (0, "pkg/p{k}.py", _PART),
    (1, "lib/s{k}.js", _SUPPLIER),
    (2, "app/n{k}.rb", _NATION),
    (3, "src/c{k}.rs", _CUSTOMER),
    (4, "cmd/r{k}.go", _REGION),
]


@query("masked_symbols", _sql(
    "path, family, name, line",
    _rows(0, 5, "pkg/p{k}.py", ("import", "mod_{k}", ":5"), ("symbol", "Part_{k}", ":7"), ("symbol", "size", ":8"), ("symbol", "after_{k}", ":15")),
    _rows(1, 5, "lib/s{k}.js", ("symbol", "live_{k}", ":5"), ("route", "/s/{k}", ":7"), ("import", "dep-{k}", ":8"), ("runtime", "KEY_{k}", ":4")),
    _rows(2, 5, "app/n{k}.rb", ("import", "gem_{k}", ":5"), ("symbol", "Nation{k}", ":6"), ("symbol", "live_{k}", ":7")),
    _rows(3, 5, "src/c{k}.rs", ("symbol", "live_{k}", ":3"), ("symbol", "Customer{k}", ":7")),
    _rows(4, 5, "cmd/r{k}.go", ("symbol", "live{k}", ":6")),
))
def masked_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.extract(classify(corpus(spark, sf_dir, MASKED)), ["symbol", "import", "route", "runtime"])
    return found.select("path", "family", F.col("subject").alias("name"), "line")


@query("lexical_masks", _sql(
    "path, kind, line_start, line_end",
    _rows(0, 5, "pkg/p{k}.py", ("string", ":1", ":4"), ("comment", ":5", ":5"), ("comment", ":6", ":6"), ("string", ":9", ":9"), ("string", ":10", ":14"), ("string", ":16", ":16")),
    _rows(1, 5, "lib/s{k}.js", ("comment", ":1", ":2"), ("comment", ":3", ":3"), ("string", ":4", ":4"), ("string", ":4", ":4"), ("string", ":5", ":5"), ("comment", ":5", ":5"), ("string", ":6", ":6"), ("string", ":7", ":7"), ("string", ":8", ":8")),
    _rows(2, 5, "app/n{k}.rb", ("comment", ":1", ":4"), ("string", ":5", ":5"), ("comment", ":5", ":5"), ("string", ":8", ":11"), ("string", ":12", ":12")),
    _rows(3, 5, "src/c{k}.rs", ("comment", ":1", ":2"), ("string", ":3", ":3"), ("string", ":4", ":6")),
    _rows(4, 5, "cmd/r{k}.go", ("comment", ":2", ":2"), ("string", ":3", ":5")),
))
def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_masks(classify(corpus(spark, sf_dir, MASKED))).select("path", "kind", "line_start", "line_end")


# ---------------------------------------------------------------- blocks and scopes

_RAILS = """Rails.application.routes.draw do
  namespace :admin do # it's do
    get 'stats/{k}', to: 'stats#index'
    scope '/v{k}', module: 'x' do
      resources :categories do
        get 'near', to: 'categories#near'
        member do
          post 'publish', to: 'categories#publish' if feature?
        end
        collection do
          get :search
        end
      end
    end
    # get 'no', to: 'x#y'
  end
  namespace :api, path: 'rest' do
    delete 'items/:id', to: 'items#drop'
  end
  get 'home', to: 'pages#home'
end"""
_PHOENIX = """scope "/api/{k}", App do
  pipe_through :api
  scope "/v1" do
    get "/users", UserController, :index
  end
  post "/users", UserController, :create
end
get "/", PageController, :home"""
_LARAVEL = """<?php
Route::prefix('admin/{k}')->middleware(['auth'])->group(function () {
    Route::get('/users', 'UserController@index');
    Route::group(['prefix' => 'deep', 'as' => 'x.'], function () {
        Route::post('/save', 'DeepController@save'); // }
    });
    Route::put('/users/{id}', 'UserController@put');
});
Route::get('/home', 'HomeController@index');"""
_KTOR = """fun Application.routes() = routing {
  route("/api/{k}") {
    route("/v1") {
      get("/users") { call.respond("{") }
    }
    post("/users") { }
  }
  get("/health") { }
}"""
_SPRING = """@RestController
@RequestMapping("/v{k}")
public class A {
  @GetMapping("/users")
  public List<User> all() { return null; }
}
class B {
  @PostMapping("/plain")
  public User make() { return null; }
}"""
_ACTIX = """fn app() { App::new().service(web::scope("/api/{k}").route("/a", web::get().to(list))
    .service(web::scope("/b").route("/c", web::post().to(make))).route("/d", web::put().to(put)))
    .route("/z", web::get().to(zed)) }"""
SCOPED = [
    (0, "n{k}/config/routes.rb", _RAILS),
    (1, "r{k}/lib/router.ex", _PHOENIX),
    (2, "s{k}/routes/web.php", _LARAVEL),
    (3, "c{k}/src/Routes.kt", _KTOR),
    (4, "p{k}/src/A.java", _SPRING),
    (5, "r{k}/src/app.rs", _ACTIX),
]


@query("scoped_routes", "SELECT DISTINCT method, path, handler, framework FROM (" + _sql(
    "file, method, path, handler, framework",
    _rows(0, 6, "n{k}/config/routes.rb", ("GET", "/admin/stats/{k}", "stats#index", "rails"), ("GET", "/admin/v{k}/categories/:category_id/near", "categories#near", "rails"), ("POST", "/admin/v{k}/categories/:id/publish", "categories#publish", "rails"), ("GET", "/admin/v{k}/categories/search", "-", "rails"), ("GET", "/admin/v{k}/categories", "categories#index", "rails"), ("POST", "/admin/v{k}/categories", "categories#create", "rails"), ("GET", "/admin/v{k}/categories/:id", "categories#show", "rails"), ("PATCH", "/admin/v{k}/categories/:id", "categories#update", "rails"), ("PUT", "/admin/v{k}/categories/:id", "categories#update", "rails"), ("DELETE", "/admin/v{k}/categories/:id", "categories#destroy", "rails"), ("DELETE", "/rest/items/:id", "items#drop", "rails"), ("GET", "/home", "pages#home", "rails")),
    _rows(1, 6, "r{k}/lib/router.ex", ("GET", "/api/{k}/v1/users", "UserController, :index", "phoenix"), ("POST", "/api/{k}/users", "UserController, :create", "phoenix"), ("GET", "/", "PageController, :home", "phoenix")),
    _rows(2, 6, "s{k}/routes/web.php", ("GET", "/admin/{k}/users", "'UserController@index'", "laravel"), ("POST", "/admin/{k}/deep/save", "'DeepController@save'", "laravel"), ("PUT", "/admin/{k}/users/{id}", "'UserController@put'", "laravel"), ("GET", "/home", "'HomeController@index'", "laravel")),
    _rows(3, 6, "c{k}/src/Routes.kt", ("GET", "/api/{k}/v1/users", "-", "ktor"), ("POST", "/api/{k}/users", "-", "ktor"), ("GET", "/health", "-", "ktor")),
    _rows(4, 6, "p{k}/src/A.java", ("GET", "/v{k}/users", "all", "spring"), ("POST", "/plain", "make", "spring")),
    _rows(5, 6, "r{k}/src/app.rs", ("GET", "/api/{k}/a", "list", "actix"), ("POST", "/api/{k}/b/c", "make", "actix"), ("PUT", "/api/{k}/d", "put", "actix"), ("GET", "/z", "zed", "actix")),
) + ")")
def scoped_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.api_routes(classify(corpus(spark, sf_dir, SCOPED))).select("method", "path", "handler", "framework")


@query("block_tree", _sql(
    "path, block, parent, line_start, line_end",
    _rows(0, 2, "n{k}/config/routes.rb", (":0", "-", ":1", ":21"), (":1", ":0", ":2", ":16"), (":2", ":1", ":4", ":14"), (":3", ":2", ":5", ":13"), (":4", ":3", ":7", ":9"), (":5", ":3", ":10", ":12"), (":6", ":0", ":17", ":19")),
    _rows(1, 2, "pkg/p{k}.py", (":0", "-", ":7", ":10"), (":1", ":0", ":8", ":10"), (":2", "-", ":15", ":16")),
).replace("NULL", "CAST(NULL AS INTEGER)"))
def block_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = block_tree(classify(corpus(spark, sf_dir, [SCOPED[0], (1, *MASKED[0][1:])]))).filter("opener not in ('(', '[')")
    return own.select("path", "block", "parent", "line_start", "line_end")


# ---------------------------------------------------------------- handlers in other files

_ROUTES_JS = """const users = require('./users');
const { drop: remove } = require('./more/drop');
router.get('/s{k}/list', users.list);
router.delete('/s{k}/one', remove);"""
_USERS_JS = """// exports.list = async (req, res) => { res.status(500).json(req.query.no); };
exports.list = wrap(async (req, res) => {
  if (!req.query.page) {
    return res.status(404).json({ error: '}' });
  }
  res.json([]);
});
exports.other = (req, res) => {
  res.status(418).send(req.query.never);
};"""
_DROP_JS = """function drop({ body }, res) {
  res.status(204).send();
}
module.exports = { drop };
const late = (req, res) => res.render(req.query.late);"""
_URLS_PY = """from . import views
urlpatterns = [
    path('n{k}/items', views.items),
]"""
_VIEWS_PY = '''def items(request):
    """return JsonResponse(1)"""
    raise Http404

def other(request):
    return JsonResponse({"status": 500})'''
_MAIN_GO = """package main
import (
	"example.com/app/r{k}/handlers"
)
func main() {
	r.GET("/r{k}/ping", handlers.Ping)
	r.POST("/r{k}/save", save)
}"""
_PING_GO = """package handlers
func Ping(c *gin.Context) {
	c.JSON(202, gin.H{})
}
func Other(c *gin.Context) {
	c.JSON(500, gin.H{})
}"""
_SAVE_GO = """package main
func save(c *gin.Context) {
	c.Status(201)
}"""
_RAILS_ROUTES = """Rails.application.routes.draw do
  namespace :admin do
    get 'items/{k}', to: 'items#show'
  end
end"""
_ITEMS_RB = """class Admin::ItemsController < ApplicationController
  def index
    render json: {}, status: 500
  end

  def show
    if params[:deep] then redirect_to x end
    render json: {}, status: 203
  end
end"""
_PLAIN_ITEMS_RB = """class ItemsController
  def show
    render html: x, status: 404
  end
end"""
HANDLERS = [
    (0, "s{k}/srv/routes.js", _ROUTES_JS),
    (0, "s{k}/srv/users.js", _USERS_JS),
    (0, "s{k}/srv/more/drop.ts", _DROP_JS),
    (1, "n{k}/urls.py", _URLS_PY),
    (1, "n{k}/views.py", _VIEWS_PY),
    (2, "r{k}/main.go", _MAIN_GO),
    (2, "r{k}/save.go", _SAVE_GO),
    (2, "r{k}/handlers/ping.go", _PING_GO),
    (3, "p{k}/config/routes.rb", _RAILS_ROUTES),
    (3, "p{k}/app/controllers/items_controller.rb", _PLAIN_ITEMS_RB),
    (3, "p{k}/app/controllers/admin/items_controller.rb", _ITEMS_RB),
]


@query("cross_file_contracts", _sql(
    "file, path, request, response, status",
    _rows(0, 4, "s{k}/srv/routes.js", ("/s{k}/list", "query:req.query.page", "response:res.json", "404"), ("/s{k}/one", "", "response:res.send", "204")),
    _rows(1, 4, "n{k}/urls.py", ("/n{k}/items", "", "", "")),
    _rows(2, 4, "r{k}/main.go", ("/r{k}/ping", "", "response:c.JSON", "202"), ("/r{k}/save", "", "", "201")),
    _rows(3, 4, "p{k}/config/routes.rb", ("/admin/items/{k}", "param:params.deep", "response:render.json|response:redirect_to", "203")),
))
def cross_file_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = classify(corpus(spark, sf_dir, HANDLERS))
    raw = stored(X.extract(files, X.ROUTE_FAMILIES), "matches")
    routes = stored(X.api_routes(files, raw), "routes")
    c = R.contracts(routes.select("method", "path", "framework"), all_contract_details(files, routes, raw))
    both = c.join(routes.select("path", "evidence.file"), "path")
    return both.select("file", "path", *[F.array_join(x, "|").alias(n) for x, n in (("request_hints", "request"), ("response_hints", "response"), ("status_codes", "status"))])


# ---------------------------------------------------------------- wrapped API clients

_CONFIG_TS = """export const BASE = '/api';
export const HOSTS = { api: 'https://x{k}.example.com' };
const LOOP = `${LOOP2}/x`;
const LOOP2 = LOOP + '/y';"""
_HTTP_TS = """import { BASE } from './config';
const ROOT = `${BASE}/p{k}`;
// export const no = (path) => fetch(ROOT + path);
export async function request(path, options = {}) {
  return fetch(ROOT + path, { method: options.method || 'GET' });
}
export const send = (method, path, body) => fetch(`${ROOT}${path}`, { method, body: JSON.stringify(body) });
export function loop(path, n) {
  if (n) { return loop('/again' + path, n - 1); }
  return request(path);
}"""
_USERS_TS = """import { request, send as submit, loop } from './http';
import { HOSTS } from './config';
export const getUser = (id) => request(`/users/${id}`);
export const users = {
  drop: async (id) => submit('DELETE', `/users/${encodeURIComponent(id)}`),
  list() { return request('/users'); },
  far(id) { return axios.get(HOSTS.api + '/far/' + id); },
};
export class Orders {
  find(page: number) { return this.load('/orders'); }
  private load(path: string) { return loop(path, 1); }
}
export default new Orders();"""
_VIEW_TSX = """import orders, { getUser, users as people } from '../api/users';
export function Page() {
  getUser(7).then(show);
  people.drop(current.id);
  orders.find(2);
  const text = "getUser(8)"; // getUser(9)
  return fetch('/api/plain/{k}', { method: 'PUT' });
}"""
_SERVER_JS = """app.get('/api/p{k}/users/:id', one);
app.delete('/api/p{k}/users/:id', drop);
app.get('/api/p{k}/users', list);
app.get('/api/p{k}/orders', orders);
app.put('/api/plain/{k}', plain);"""
WRAPPED = [(0, "w{k}/src/api/config.ts", _CONFIG_TS), (0, "w{k}/src/api/http.ts", _HTTP_TS), (0, "w{k}/src/api/users.ts", _USERS_TS), (0, "w{k}/src/pages/Page.tsx", _VIEW_TSX), (0, "w{k}/server/index.js", _SERVER_JS)]


def _wrapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = classify(corpus(spark, sf_dir, WRAPPED))
    raw = stored(X.extract(files, [*X.ROUTE_FAMILIES, "call"]), "matches")
    return files, raw, stored(resolved_api_calls(files, raw), "calls")


@query("wrapped_calls", _sql(
    "path, line, method, endpoint",
    _rows(0, 1, "w{k}/src/pages/Page.tsx", (":3", "GET", "/api/p{k}/users/7"), (":4", "DELETE", "/api/p{k}/users/:id"), (":7", "PUT", "/api/plain/{k}")),
    _rows(0, 1, "w{k}/src/api/users.ts", (":6", "GET", "/api/p{k}/users"), (":7", "GET", "https://x{k}.example.com/far/:id"), (":10", "GET", "/api/p{k}/orders")),
))
def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wrapped(spark, sf_dir)[2].select("path", "line", "method", "endpoint")


@query("wrapped_links", _sql(
    "source, method, matched_route, match_type",
    _rows(0, 1, "w{k}/src/pages/Page.tsx", ("GET", "/api/p{k}/users/:id", "param"), ("DELETE", "/api/p{k}/users/:id", "exact"), ("PUT", "/api/plain/{k}", "exact")),
    _rows(0, 1, "w{k}/src/api/users.ts", ("GET", "/api/p{k}/users", "exact"), ("GET", "-", "external-url"), ("GET", "/api/p{k}/orders", "exact")),
))
def wrapped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, raw, calls = _wrapped(spark, sf_dir)
    routes = stored(X.api_routes(files, raw), "routes")
    keyed = calls.select(F.xxhash64("path", "line", "endpoint").alias("call_id"), F.col("path").alias("source"), "endpoint", "method", "client")
    known = routes.select(F.xxhash64("method", "path").alias("route_id"), "method", "path", "framework", "handler", F.lit(None).cast("string").alias("route_name"))
    return link_calls(keyed, known).select("source", "method", "matched_route", "match_type")


# ---------------------------------------------------------------- YAML and JSON trees

_OPENAPI_YAML = """# paths:
openapi: "3.0.1" # get:
paths:
  /users/{id}:
    parameters:
    - name: id
      in: path
    get:
      operationId: getUser{k}
      description: |
        post:
          operationId: no
      parameters:
        - {name: deep, in: query}
      responses:
        "200": {description: 'ok # not a comment'}
        '404':
          description: gone
    delete:
      responses: {'204': {description: done}}
components:
  get:
    operationId: never"""
_KUBERNETES = """apiVersion: apps/v1
kind: Deployment
metadata:
  name: web{k}
spec:
  template:
    spec:
      containers:
      - name: app
        image: registry/app:{k} # image: no
        ports:
        - containerPort: 8080
---
apiVersion: batch/v1
kind: CronJob
metadata: {name: job{k}}
spec:
  schedule: "*/5 * * * *"
---
note: |
  kind: Nothing"""
_WORKFLOW = """on:
  schedule:
    - cron: '0 {k} * * *'
jobs:
  build{k}:
    steps:
      - uses: actions/checkout@v4
      - name: uses
        run: |
          uses: no
          make {k}
  test:
    steps: [{uses: a/b@v1}]"""
_COMPOSE = """services:
  db{k}:
    image: postgres:16
    ports: ["5432:5432"]
  web:
    image: web
volumes:
  data:"""
_OPENAPI_JSON = """{"swagger": "2.0", "paths": {"/items/{id}": {"put": {"operationId": "put{k}", "parameters": [{"name": "id", "in": "path"}, {"name": "body", "in": "body"}], "requestBody": {}, "responses": {"200": {}, "400": {}}}}},
 "definitions": {"get": {"operationId": "no"}}}"""
TREES = [
    (0, "y{k}/openapi.yaml", _OPENAPI_YAML),
    (1, "y{k}/deploy/all.yaml", _KUBERNETES),
    (2, "y{k}/.github/workflows/ci.yml", _WORKFLOW),
    (2, "y{k}/docker-compose.yml", _COMPOSE),
    (3, "y{k}/swagger.json", _OPENAPI_JSON),
]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_nodes(classify(corpus(spark, sf_dir, TREES)))


@query("yaml_paths", _sql(
    "path, doc, keys, value, line",
    _rows(1, 4, "y{k}/deploy/all.yaml", (":0", "apiVersion", "apps/v1", ":1"), (":0", "kind", "Deployment", ":2"), (":0", "metadata name", "web{k}", ":4"), (":0", "spec template spec containers [] name", "app", ":9"), (":0", "spec template spec containers [] image", "registry/app:{k}", ":10"), (":0", "spec template spec containers [] ports [] containerPort", "8080", ":12"), (":1", "apiVersion", "batch/v1", ":14"), (":1", "kind", "CronJob", ":15"), (":1", "metadata name", "job{k}", ":16"), (":1", "spec schedule", "*/5 * * * *", ":18"), (":2", "note", "kind: Nothing", ":20")),
    _rows(2, 4, "y{k}/docker-compose.yml", (":0", "services db{k} image", "postgres:16", ":3"), (":0", "services db{k} ports []", "5432:5432", ":4"), (":0", "services web image", "web", ":6")),
))
def yaml_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _nodes(spark, sf_dir).filter("value is not null and (path like '%all.yaml' or path like '%compose.yml')")
    return own.select("path", "doc", F.array_join("keys", " ").alias("keys"), "value", "line")


@query("openapi_routes", _sql(
    "path, method, route, handler, parameters, n_responses",
    _rows(0, 4, "y{k}/openapi.yaml", ("GET", "/users/{id}", "getUser{k}", "id,deep", ":2"), ("DELETE", "/users/{id}", "-", "id", ":1")),
    _rows(3, 4, "y{k}/swagger.json", ("PUT", "/items/{id}", "put{k}", "id,body", ":2")),
))
def spec_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = openapi_routes(_nodes(spark, sf_dir))
    return own.select("path", "method", "route", "handler", F.array_join("parameters", ",").alias("parameters"), F.col("n_responses").cast("int").alias("n_responses"))


@query("tree_facts", _sql(
    "path, kind, name, detail",
    _rows(1, 4, "y{k}/deploy/all.yaml", ("kubernetes-kind", "Deployment", "-"), ("kubernetes-name", "web{k}", "-"), ("kubernetes-image", "registry/app:{k}", "-"), ("kubernetes-port", "8080", "-"), ("kubernetes-kind", "CronJob", "-"), ("kubernetes-name", "job{k}", "-"), ("kubernetes-schedule", "*/5 * * * *", "-")),
    _rows(2, 4, "y{k}/.github/workflows/ci.yml", ("github-job", "build{k}", "-"), ("github-job", "test", "-"), ("github-action", "actions/checkout@v4", "build{k}"), ("github-action", "a/b@v1", "test"), ("github-schedule", "0 {k} * * *", "-")),
    f"SELECT {_line('y{k}/.github/workflows/ci.yml', KEY)}, 'github-run', 'uses: no' || chr(10) || {_line('make {k}', KEY)}, {_line('build{k}', KEY)} FROM {ROWS_OF} WHERE {KEY} % 4 = 2",
    _rows(2, 4, "y{k}/docker-compose.yml", ("compose-service", "db{k}", "-"), ("compose-service", "web", "-"), ("compose-image", "postgres:16", "db{k}"), ("compose-image", "web", "web"), ("compose-port", "5432:5432", "db{k}")),
))
def facts_of_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_facts(_nodes(spark, sf_dir)).select("path", "kind", "name", "detail")


# ---------------------------------------------------------------- nested and lazy frontend routes

_APP_TSX = """import Admin from './admin/Admin';
const Late = lazy(() => import('./late'));
// <Route path="/no" element={<No />} />
export default () => <Routes>
  <Route path="/p{k}" element={<Layout wide={1 > 0} />}>
    <Route index element={<Home />} />
    <Route path="users" element={<Users />}>
      <Route path=":id" element={<User />} />
    </Route>
    <Route path="admin/*" element={<Admin />} />
  </Route>
  <Route path="late/*" element={<Late />} />
</Routes>;"""
_ADMIN_TSX = """export default function Admin() {
  return <Routes>
    <Route path="stats" element={<Stats />} />
  </Routes>;
}"""
_LATE_TSX = """export default () => <Routes><Route path="deep" element={<Deep />} /><Route path="back/*" element={<Back />} /></Routes>;"""
_ROUTER_TS = """import { createRouter } from 'vue-router';
import { itemRoutes } from './items';
const routes = [
  { path: '/', component: Home, meta: { path: 'no' } },
  { path: '/shop{k}', component: Shop, children: [
    { path: '', component: List },
    { path: ':id', component: () => import('./Item.vue'), children: itemRoutes },
    { path: '/old', redirect: '/' },
  ] },
];
const settings = { path: '/tmp' };"""
_ITEMS_TS = """import { RouteRecordRaw } from 'vue-router';
export const itemRoutes = [{ path: 'edit', component: Edit }];"""
_NG_ROUTES = """import { Routes } from '@angular/router';
export const routes: Routes = [
  { path: 'admin{k}', loadChildren: () => import('./admin/admin.module').then(m => m.AdminModule) },
  { path: 'x', children: [ { path: 'y', component: Y } ] },
];"""
_NG_MODULE = """import { AdminRoutingModule } from './admin-routing.module';
export class AdminModule {}"""
_NG_ROUTING = """const routes: Routes = [{ path: 'people', component: People, children: [{ path: ':id', component: Person }] }];
export class AdminRoutingModule {}"""
FRONTEND = [
    (0, "r{k}/src/App.tsx", _APP_TSX),
    (0, "r{k}/src/admin/Admin.tsx", _ADMIN_TSX),
    (0, "r{k}/src/late/index.tsx", _LATE_TSX),
    (1, "v{k}/src/router.ts", _ROUTER_TS),
    (1, "v{k}/src/items.ts", _ITEMS_TS),
    (2, "a{k}/src/app.routes.ts", _NG_ROUTES),
    (2, "a{k}/src/admin/admin.module.ts", _NG_MODULE),
    (2, "a{k}/src/admin/admin-routing.module.ts", _NG_ROUTING),
]


@query("nested_frontend_routes", _sql(
    "path, kind, name, component",
    _rows(0, 3, "r{k}/src/App.tsx", ("react-router", "/p{k}", "Layout"), ("react-router", "/p{k}", "Home"), ("react-router", "/p{k}/users", "Users"), ("react-router", "/p{k}/users/:id", "User"), ("react-router", "/p{k}/admin", "Admin"), ("react-router", "/late", "Late")),
    _rows(0, 3, "r{k}/src/admin/Admin.tsx", ("react-router", "/p{k}/admin/stats", "Stats")),
    _rows(0, 3, "r{k}/src/late/index.tsx", ("react-router", "/late/deep", "Deep"), ("react-router", "/late/back", "Back")),
    _rows(1, 3, "v{k}/src/router.ts", ("vue-router", "/", "Home"), ("vue-router", "/shop{k}", "Shop"), ("vue-router", "/shop{k}", "List"), ("vue-router", "/shop{k}/:id", "-"), ("vue-router", "/old", "-")),
    _rows(1, 3, "v{k}/src/items.ts", ("vue-router", "/shop{k}/:id/edit", "Edit")),
    _rows(2, 3, "a{k}/src/app.routes.ts", ("angular", "/admin{k}", "-"), ("angular", "/x", "-"), ("angular", "/x/y", "Y")),
    _rows(2, 3, "a{k}/src/admin/admin-routing.module.ts", ("vue-router", "/admin{k}/people", "People"), ("vue-router", "/admin{k}/people/:id", "Person")),
))
def nested_frontend_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = classify(corpus(spark, sf_dir, FRONTEND))
    raw = stored(X.extract(files, ["binding", "import"]), "matches")
    return frontend_routes(files, raw).select("path", "kind", "name", "component")


# ---------------------------------------------------------------- routes implied by resources

_RESOURCES_RB = """Rails.application.routes.draw do
  namespace :admin{k} do
    resources :posts, :tags, only: [:index, :show] do
      resources :comments, shallow: true, except: %i[destroy update]
    end
    resource :profile, path: 'me', only: :show
  end
  resources :boxes, param: :slug, controller: 'crates', only: [:update] # , only: [:show]
end"""
_RESOURCES_PHP = """<?php
Route::prefix('v{k}')->group(function () {
    Route::apiResource('photos.comments', CommentController::class)
        ->only(['index', 'show']);
});
Route::resource('entries', 'EntryController', ['except' => ['create', 'edit', 'update', 'destroy']]);
// Route::resource('no', 'NoController');"""
_RESOURCES_EX = """scope "/api/{k}", App do
  resources "/users", UserController, only: [:index, :update]
end"""
RESOURCES = [(0, "q{k}/config/routes.rb", _RESOURCES_RB), (1, "q{k}/routes/api.php", _RESOURCES_PHP), (2, "q{k}/lib/router.ex", _RESOURCES_EX)]


@query("resource_routes", _sql(
    "file, method, path, handler, framework",
    _rows(0, 3, "q{k}/config/routes.rb", ("GET", "/admin{k}/posts", "posts#index", "rails"), ("GET", "/admin{k}/posts/:id", "posts#show", "rails"), ("GET", "/admin{k}/tags", "tags#index", "rails"), ("GET", "/admin{k}/tags/:id", "tags#show", "rails"), ("GET", "/admin{k}/posts/:post_id/comments", "comments#index", "rails"), ("POST", "/admin{k}/posts/:post_id/comments", "comments#create", "rails"), ("GET", "/admin{k}/comments/:id", "comments#show", "rails"), ("GET", "/admin{k}/me", "profile#show", "rails"), ("PATCH", "/boxes/:slug", "crates#update", "rails"), ("PUT", "/boxes/:slug", "crates#update", "rails")),
    _rows(1, 3, "q{k}/routes/api.php", ("GET", "/v{k}/photos/{photo}/comments", "CommentController@index", "laravel"), ("GET", "/v{k}/photos/{photo}/comments/{comment}", "CommentController@show", "laravel"), ("GET", "/entries", "EntryController@index", "laravel"), ("POST", "/entries", "EntryController@store", "laravel"), ("GET", "/entries/{entry}", "EntryController@show", "laravel")),
    _rows(2, 3, "q{k}/lib/router.ex", ("GET", "/api/{k}/users", "UserController, :index", "phoenix"), ("PATCH", "/api/{k}/users/:id", "UserController, :update", "phoenix"), ("PUT", "/api/{k}/users/:id", "UserController, :update", "phoenix")),
))
def resource_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = stored(X.extract(classify(corpus(spark, sf_dir, RESOURCES)), X.ROUTE_FAMILIES), "matches")
    return X.declared_routes(raw).select("evidence.file", "method", "path", "handler", "framework")
