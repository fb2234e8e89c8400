"""Wrapped API clients: templates, constants over files, wrappers of wrappers, cycles."""

import pytest

from factloom.operators import extract as X
from factloom.operators.classify import classify
from factloom.operators.wrappers import client_facts, parts_of, resolved_api_calls, wrapped_calls


def shown(parts):
    return "".join({"lit": p["text"], "ref": f"<{p['text']}>", "param": "{" + p["text"] + "}"}[p["kind"]] for p in parts)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("'/a' + id + \"/b\"", "/a{0:id}/b"),
        ("`/a/${id}/${x.y}?q=${encodeURIComponent(id)}`", "/a/{0:id}/<x.y>?q={0:id}"),
        ("BASE + `/${`in/${id}`}`", "<BASE>/in/{0:id}"),
        ("cond ? '/a' : '/b'", "<value>"),
        ("(id as string)!", "{0:id}"),
        ("id!", "{0:id}"),
        ("user?.id", "<user.id>"),
        ("build(id)", "<build>"),
        ("7", "7"),
        ("", ""),
        ("`never closed", "<value>"),
    ],
)
def test_templates(text, want):
    assert shown(parts_of(text, ["id"])) == want


def test_facts_of_a_script():
    text = "class A {\n  get(path) { return this.load(path); }\n  async load(p) { return http.get(`/x${p}`); } // fetch('/no')\n}\nconst api = axios.create({ baseURL: '/v1' });\nexport default new A();\nif (x) { f(1); }\nconst one = id => fetch('/one/' + id);\nconst C = { a: '/a', b: \"fetch('/no')\" };\n"
    got = {(kind, name, owner, shown(method or []), shown(parts or [])) for kind, name, owner, _, method, parts, _ in client_facts(text, "typescript")}
    assert {("function", "A.get", "", "", ""), ("function", "A.load", "", "", ""), ("function", "one", "", "", ""), ("sink", "angular", "A.load", "GET", "/x{0:p}"), ("sink", "", "api.get", "GET", "/v1{0:url}"), ("alias", "default", "A", "", ""), ("call", "A.load", "A.get", "", ""), ("sink", "fetch", "one", "GET", "/one/{0:id}"), ("constant", "C.a", "", "", "/a")} <= got
    assert not [g for g in got if g[0] == "sink" and "no" in g[4]]


FILES = {
    "a/base.js": "module.exports = { BASE: '/api', UP: DOWN, };\nconst DOWN = UP;\nexport const V = '/v2';\n",
    "a/http.js": "import { V } from './base';\nimport * as all from './base';\nconst api = axios.create({ baseURL: all.V });\nexport const get = (path) => api.get(path);\nexport function ping(path) { return pong(path + '/i'); }\nfunction pong(path) { if (path) { return ping(path); } return fetch(V + path, { method: 'POST' }); }\n",
    "a/user.ts": "import { get, ping } from './http';\nexport const user = (id) => get(`/users/${id}`);\nexport const lonely = (id) => fetch(`/alone/${id}`);\nping('/p');\n",
    "a/view.vue": "<template><p @click=\"user(1)\">it's</p></template>\n<script>\nimport { user } from './user';\nuser(3);\nuser(me.id);\nconst plain = () => axios.get('/plain');\nfetch(UNKNOWN + '/tail');\n</script>\n",
    "a/user.test.ts": "import { user } from './user';\nuser(9);\n",
    "b/x.js": "const BASE = '/only';\nfetch('/head' + name);\n$.get('/jq');\n",
    "c/null.js": None,
    "c/empty.ts": "",
}


@pytest.fixture(scope="module")
def facts(spark):
    files = classify(spark.createDataFrame(list(FILES.items()), "path string, content string")).cache()
    return files, X.extract(files, [*X.ROUTE_FAMILIES, "call"]).cache()


def test_calls_through_wrappers(facts):
    got = {(r.path, r.line, r.method, r.endpoint) for r in resolved_api_calls(*facts).collect()}
    assert got == {
        ("a/view.vue", 4, "GET", "/v2/users/3"),
        ("a/view.vue", 5, "GET", "/v2/users/:id"),
        ("a/view.vue", 6, "GET", "/plain"),
        ("a/view.vue", 7, "GET", "/tail"),
        ("a/user.ts", 3, "GET", "/alone/:id"),
        ("a/user.ts", 4, "POST", "/v2/p/i"),
        ("b/x.js", 2, "GET", "/head${name}"),
        ("b/x.js", 3, "GET", "/jq"),
    }


def test_chains_end(facts):
    found = wrapped_calls(*facts).collect()
    assert all(len(r.through) == len(set(r.through)) or r.through[-1].endswith("#") for r in found)
    assert max(len(r.through) for r in found) == 4


def test_no_scripts(facts):
    files, raw = facts
    assert wrapped_calls(files.filter("path = 'c/empty.ts'"), raw.filter("false")).count() == 0
