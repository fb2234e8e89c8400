import pytest

from factloom.operators import extract as X
from factloom.operators.classify import classify

FILES = {
    "src/server.ts": "import express from 'express';\nconst app = express();\napp.get('/api/users/:id', getUser);\napp.post('/api/users', auth, createUser);\nrouter.all('/health', ping);\n",
    "src/users.controller.ts": "@Controller('cats')\nexport class CatsController {\n  @Get(':id')\n  async findOne(id: string) {}\n  @Post()\n  create() {}\n}\n",
    "api/main.py": "from fastapi import FastAPI\napp = FastAPI()\n@app.get('/items/{item_id}')\nasync def read_item(item_id: int):\n    return 1\n\n@bp.route('/old', methods=['POST'])\ndef old():\n    pass\n\nclass Item(BaseModel):\n    name: str\n",
    "web/App.tsx": "export function UserCard() {\n  const [open, setOpen] = useState(false);\n  fetch('/api/users/123');\n  axios.post('/api/users', {});\n  fetch('/api/users', { method: 'PUT' });\n  return null;\n}\n",
    "java/src/UserController.java": "import org.springframework.web;\n@RestController\n@RequestMapping(\"/v1\")\npublic class UserController {\n  @GetMapping(\"/users\")\n  public List<User> all() { return null; }\n}\n",
    "go/main.go": "package main\nfunc main() {\n  r.GET(\"/ping\", handlers.Ping)\n  http.HandleFunc(\"POST /submit\", submit)\n}\n",
    "config/routes.rb": "get '/posts', to: 'posts#index'\n",
    "package.json": "﻿{\"dependencies\": {\"express\": \"^4\", \"react\": \"18\"}, \"devDependencies\": {\"jest\": \"29\"}}".lstrip("﻿"),
    "pyproject.toml": "[project]\ndependencies = [\"fastapi>=0.1\", \"celery\"]\n[project.optional-dependencies]\ndev = [\"pytest\"]\n",
    "requirements.txt": "flask==2.0\n# note\nrequests\n",
    "go.mod": "module x\nrequire github.com/gin-gonic/gin v1.9.0\n",
    ".env": "SECRET_KEY=abc\nPORT=1\n",
    "db/schema.sql": "CREATE TABLE users (id int);\ncreate index ix on users(id);\n",
    "tests/user.test.ts": "fetch('/api/users/1');\n",
    "examples/demo.js": "app.get('/demo', x);\n",
    "node_modules/a/index.js": "app.get('/no', x);\n",
    "broken.json": "{oops",
}


@pytest.fixture(scope="module")
def files(spark):
    return classify(spark.createDataFrame(list(FILES.items()), "path string, content string")).cache()


def test_classification(files):
    got = {r.path: (r.language, r.role) for r in files.collect()}
    assert "node_modules/a/index.js" not in got
    assert got["src/server.ts"] == ("typescript", "source")
    assert got["tests/user.test.ts"] == ("typescript", "test")
    assert got["examples/demo.js"] == ("javascript", "sample")
    assert got["package.json"] == ("json", "config")
    assert got[".env"] == ("env", "config")
    assert got["db/schema.sql"] == ("sql", "data-layer")


def test_routes(files):
    got = {(r.framework, r.method, r.path, r.handler) for r in X.api_routes(files).collect()}
    assert {
        ("express", "GET", "/api/users/:id", "getUser"),
        ("express", "POST", "/api/users", "createUser"),
        ("express", "ALL", "/health", "ping"),
        ("nestjs", "GET", "/cats/:id", "findOne"),
        ("nestjs", "POST", "/cats", "create"),
        ("fastapi", "GET", "/items/{item_id}", "read_item"),
        ("flask", "POST", "/old", "old"),
        ("spring", "GET", "/v1/users", "all"),
        ("gin", "GET", "/ping", "handlers.Ping"),
        ("net-http", "POST", "/submit", "submit"),
        ("rails", "GET", "/posts", "posts#index"),
    } == got


def test_calls(files):
    got = {(r.client, r.method, r.endpoint, r.line) for r in X.api_calls(files).collect()}
    assert got == {("fetch", "GET", "/api/users/123", 3), ("axios", "POST", "/api/users", 4), ("fetch", "PUT", "/api/users", 5)}


def test_names(files):
    assert {(r.kind, r.name) for r in X.named(files, "data-model").collect()} == {("pydantic", "Item")}
    assert {(r.kind, r.name) for r in X.named(files, "runtime").collect()} == {("env-key", "SECRET_KEY"), ("env-key", "PORT")}
    assert {(r.kind, r.name) for r in X.named(files, "data-layer").collect()} == {("table", "users"), ("index", "ix")}
    assert ("react", "UserCard") in {(r.kind, r.name) for r in X.named(files, "component").collect()}
    assert {(r.kind, r.name) for r in X.named(files, "state").collect()} == {("react-hook", "open")}
    assert ("from", "fastapi") in {(r.kind, r.name) for r in X.named(files, "import").collect()}


def test_dependencies_and_frameworks(files):
    deps = X.dependencies(files)
    got = {(r.name, r.source, r.scope) for r in deps.collect()}
    assert {
        ("express", "package.json", "runtime"), ("react", "package.json", "runtime"), ("jest", "package.json", "development"), ("fastapi", "pyproject.toml", "runtime"), ("celery", "pyproject.toml", "runtime"),
        ("pytest", "pyproject.toml", "dev"), ("flask", "requirements.txt", "runtime"), ("requests", "requirements.txt", "runtime"), ("github.com/gin-gonic/gin", "go.mod", "runtime"),
    } == got
    fw = {r.name: r.confidence for r in X.frameworks(deps, X.named(files, "import")).collect()}
    assert fw["express"] == 0.95 and fw["fastapi"] == 0.95 and fw["spring"] == 0.85


def test_issues(files):
    assert [r.path for r in X.parse_issues(files).collect()] == ["broken.json"]
