"""YAML and JSON as trees, by cases that are easily got wrong; facts asked for by keys."""

import pytest

from factloom.operators.classify import classify
from factloom.operators.trees import json_nodes, matches_keys, openapi_routes, tree_facts, tree_nodes, yaml_nodes


def values(text):
    return {(n.doc, "/".join(n.keys)): n.value for n in yaml_nodes(text) if n.value is not None}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a: 1\nb:\n  c: 2\n  d:\n    e: 3\nf: 4", {(0, "a"): "1", (0, "b/c"): "2", (0, "b/d/e"): "3", (0, "f"): "4"}),
        ("a:\n- x\n- y\nb: z", {(0, "a/[]"): "y", (0, "b"): "z"}),
        ("a:\n  - b: 1\n    c: 2\n  - d: 3", {(0, "a/[]/b"): "1", (0, "a/[]/c"): "2", (0, "a/[]/d"): "3"}),
        ("- - a: 1\n- b", {(0, "[]/[]/a"): "1", (0, "[]"): "b"}),
        ("a: 'it''s # x' # y\nb: \"c: \\\"d\\\" #\"\n'e: f': g", {(0, "a"): "it's # x", (0, "b"): 'c: "d" #', (0, "e: f"): "g"}),
        ("a: |\n  b: c\n\n   d # e\nf: >-\n  g\n", {(0, "a"): "b: c\n\n d # e", (0, "f"): "g"}),
        ("a: {b: [1, {c: 'd, e'}], f: }\ng: [\n  1,\n  2]\nh: i", {(0, "a/b/[]"): "1", (0, "a/b/[]/c"): "d, e", (0, "a/f"): "", (0, "g/[]"): "2", (0, "h"): "i"}),
        ("a: 1\n---\n# x\na: 2\n...\n--- \nb:\n  - 3", {(0, "a"): "1", (1, "a"): "2", (2, "b/[]"): "3"}),
        ("a: b\n  c\nd: 'e\n  f'", {(0, "a"): "b c", (0, "d"): "e f"}),
        ("url: http://x:80/#y\nt: 10:30\nenv: ${{ a }}\nj: {{ b }}", {(0, "url"): "http://x:80/#y", (0, "t"): "10:30", (0, "env"): "${{ a }}", (0, "j"): "{{ b }}"}),
        ("a: &x\n  b: 1\nc: *x\nd: &y 2\ne: !!str 3", {(0, "a/b"): "1", (0, "c"): "*x", (0, "d"): "2", (0, "e"): "3"}),
        ("a:\r\n\tb: 1\r\n", {(0, "a/b"): "1"}),
        ("", {}),
        ("just words", {}),
    ],
)
def test_yaml(text, want):
    assert values(text) == want


def test_parents_follow_keys():
    nodes = yaml_nodes("a:\n  - b: {c: [1, 2]}\n    d:\n    - e\nf:\n  g: 1\n---\nh: {i: 2}\n")
    by = {n.node: n for n in nodes}
    for n in nodes:
        above = by[n.parent].keys if n.parent >= 0 else ()
        assert n.keys[:-1] == above and (n.parent < 0 or by[n.parent].doc == n.doc) and n.line >= 1


def test_json():
    assert {"/".join(n.keys): n.value for n in json_nodes('{"a": [1, {"b": null, "c": true}], "d": "x"}') if n.value is not None} == {"a/[]": "1", "a/[]/c": "true", "d": "x"}
    assert json_nodes("{") == [] and json_nodes("") == [] and json_nodes("[" * 100_000) == []


FILES = {
    "api/openapi.yml": "openapi: 3.0.0\npaths:\n  '/a/{id}':\n    parameters: [{name: id, in: path}]\n    get:\n      operationId: one\n      parameters:\n      - in: query\n        name: q\n  /b:\n    post: {requestBody: {}, responses: {'201': {}}}\nx-get:\n  /no: {get: {}}\n",
    "not/openapi.yml": "paths:\n  /no:\n    get: {}\n",
    "k8s.yaml": "apiVersion: v1\nkind: Service\nmetadata:\n  name: s\n  labels: {kind: no}\n---\nkind: NoVersion\n",
    "conf/application.yml": "spring:\n  datasource:\n    url: x\nlist:\n  - a: 1\n",
    ".gitlab-ci.yml": "stages: [build]\nbuild:\n  script:\n    - make\n.hidden:\n  image: x\n",
    "other/compose-notes.yaml": "image: no\n",
    "broken.json": "{oops",
    "empty.yml": "",
}


@pytest.fixture(scope="module")
def nodes(spark):
    return tree_nodes(classify(spark.createDataFrame([*FILES.items(), ("null.yml", None)], "path string, content string"))).cache()


def test_operations(nodes):
    got = {(r.path, r.method, r.route, r.handler, tuple(r.parameters), r.n_responses, r.has_body) for r in openapi_routes(nodes).collect()}
    assert got == {("api/openapi.yml", "GET", "/a/{id}", "one", ("id", "q"), 0, False), ("api/openapi.yml", "POST", "/b", None, (), 1, True)}


def test_facts(nodes):
    got = {(r.path, r.kind, r.name) for r in tree_facts(nodes).collect()}
    assert got == {("k8s.yaml", "kubernetes-kind", "Service"), ("k8s.yaml", "kubernetes-name", "s"), ("conf/application.yml", "spring-config", "spring.datasource.url"), ("conf/application.yml", "spring-config", "list.a"), (".gitlab-ci.yml", "gitlab-job", "build")}


def test_patterns(spark):
    keys = spark.createDataFrame([(["a", "b", "c"],), (["a", "[]", "c"],), (["c"],), ([],)], "keys array<string>")
    for pattern, want in (("a/*/c", [0]), ("a/[]/c", [1]), ("**/c", [0, 1, 2]), ("**/b/c", [0]), ("**", [0, 1, 2, 3])):
        got = keys.select(matches_keys(keys["keys"], pattern).alias("ok")).collect()
        assert [k for k, r in enumerate(got) if r.ok] == want
