"""YAML and JSON files as trees of nodes, and facts that ask for paths of keys in them.

``tree_nodes`` gives each node with its document, parent, keys from the root (``[]`` for the items of a list) and value; YAML
is read line by line with a stack of indents: nested mappings and lists, lists as deep as their key, several documents,
quoted and block scalars, scalars over lines, flow collections and comments.  ``TREE_RULES`` are rows: the files, keys that
the document must have at its root, a pattern of keys (``*`` is any one key, ``**`` any number of them) and what to take from
the match.  Nothing is looked for line by line, so a name counts only where it stands in the tree.

Aliases stay as they are written.  A line that fits nothing continues the scalar above it or is passed over; a JSON file that
does not parse has no nodes, and neither have null contents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_path
from ..sources.tables import arrow_ready, stored

NODES = "path string, doc int, node int, parent int, keys array<string>, value string, line int"
METHODS = ["get", "post", "put", "patch", "delete", "options", "head", "trace"]


class Node(NamedTuple):
    doc: int
    node: int
    parent: int  # -1: none
    keys: tuple[str, ...]
    value: str | None
    line: int  # from 1; 0: not known


class _Open:
    """A node that lines below may belong to."""

    def __init__(self, indent: int, item: bool, node: int, keys: tuple[str, ...]) -> None:
        self.indent, self.item, self.node, self.keys = indent, item, node, keys


def _scalar(text: str) -> str:
    text = re.sub(r"^(?:[&!][^\s]+\s+)+", "", text.strip())
    if len(text) > 1 and text[0] == text[-1] == '"':
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    return text


_QUOTED_OR_COMMENT = re.compile(r"(?:^|(?<=[ \t\[{,:-]))(?:\"(?:[^\"\\]|\\.)*\"?|'(?:[^']|'')*'?)|(?:^|(?<=[ \t]))(?P<comment>#)")


def _without_comment(line: str) -> str:
    for m in _QUOTED_OR_COMMENT.finditer(line):
        if m["comment"]:
            return line[: m.start()].rstrip()
    return line.rstrip()


_KEY = re.compile(r"(?P<key>\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s\"'\[\]{}#&*!|>%@`,-][^#]*?|-[^\s#][^#]*?|[&*!][^\s]+)\s*:(?:\s+(?P<value>.*))?$")


def _flow(text: str) -> object:
    """A flow collection as lists, dicts and scalars; what is left open ends with the text."""
    at = 0

    def value() -> object:
        nonlocal at
        while at < len(text) and text[at] in " \t\n,":
            at += 1
        if at < len(text) and text[at] in "[{":
            close, out = ("]", []) if text[at] == "[" else ("}", {})
            at += 1
            while at < len(text):
                while at < len(text) and text[at] in " \t\n,":
                    at += 1
                if at >= len(text) or text[at] == close:
                    at += 1
                    break
                start = at
                one = value()
                if isinstance(out, dict):
                    while at < len(text) and text[at] in " \t\n":
                        at += 1
                    if at < len(text) and text[at] == ":":
                        at += 1
                        out[str(one)] = value()
                    else:
                        out[str(one)] = None
                else:
                    out.append(one)
                at = max(at, start + 1)
            return out
        if at < len(text) and text[at] in "\"'":
            m = re.compile(r"\"(?:[^\"\\]|\\.)*\"?|'(?:[^']|'')*'?").match(text, at)
            at = m.end()
            return _scalar(m[0])
        m = re.compile(r"(?:[^,\[\]{}:]|:(?=[^\s,\[\]{}]))*").match(text, at)
        at = m.end()
        return _scalar(m[0])

    return value()


class Tree:
    """Numbers the nodes of a file."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.doc = 0

    def add(self, parent: int, keys: tuple[str, ...], value: str | None, line: int) -> int:
        self.nodes.append(Node(self.doc, len(self.nodes), parent, keys, value, line))
        return len(self.nodes) - 1

    def put(self, parent: int, keys: tuple[str, ...], value: object, line: int) -> None:
        """A node for a value made of lists, dicts and scalars, with all below it."""
        todo = [(parent, keys, value)]
        while todo:
            parent, keys, value = todo.pop(0)
            nested = isinstance(value, dict | list)
            text = None if nested or value is None else json.dumps(value) if isinstance(value, bool) else str(value)
            own = self.add(parent, keys, text, line) if keys else -1
            if isinstance(value, dict):
                todo += [(own, (*keys, str(k)), v) for k, v in value.items()]
            elif isinstance(value, list):
                todo += [(own, (*keys, "[]"), v) for v in value]


def yaml_nodes(text: str) -> list[Node]:
    tree, open_, lines = Tree(), [], text.split("\n")
    at = 0

    def below(line: int, indent: int) -> int:
        """The first line from ``line`` on that is indented no more."""
        while line < len(lines) and (not lines[line].strip() or len(lines[line]) - len(lines[line].lstrip()) > indent):
            line += 1
        return line

    def read(indent: int, body: str, line: int) -> int:
        """One line's content from ``indent`` on; the line to go on with."""
        while m := re.match(r"-(?:\s+|$)", body):
            while open_ and (open_[-1].indent > indent or (open_[-1].indent == indent and open_[-1].item)):
                open_.pop()
            top = open_[-1] if open_ else None
            keys = (*(top.keys if top else ()), "[]")
            open_.append(_Open(indent, True, tree.add(top.node if top else -1, keys, None, line + 1), keys))
            indent, body = indent + m.end(), body[m.end() :]
        m = _KEY.match(body) if body else None
        if m is None:
            if body and open_:
                own = tree.nodes[open_[-1].node]
                if body[0] in "[{":
                    body, line = collection(body, line)
                    children(open_[-1], _flow(body), line)
                elif body[0] in "|>" and own.value is None:
                    end = below(line + 1, open_[-1].indent)
                    tree.nodes[own.node] = own._replace(value=block(line + 1, end))
                    return end
                else:
                    tree.nodes[own.node] = own._replace(value=_scalar(body) if own.value is None else f"{own.value} {_scalar(body)}")
            elif body and body[0] in "[{":
                body, line = collection(body, line)
                tree.put(-1, (), _flow(body), line + 1)
            return line + 1
        while open_ and open_[-1].indent >= indent and not (open_[-1].item and open_[-1].indent < indent):
            open_.pop()
        top = open_[-1] if open_ else None
        keys = (*(top.keys if top else ()), _scalar(m["key"]))
        own = _Open(indent, False, tree.add(top.node if top else -1, keys, None, line + 1), keys)
        open_.append(own)
        value = re.sub(r"^(?:[&!][^\s]+(?:\s+|$))+", "", m["value"] or "")
        if not value:
            return line + 1
        if value[0] in "|>" and re.fullmatch(r"[|>][+-]?\d*[+-]?", value):
            end = below(line + 1, indent)
            tree.nodes[own.node] = tree.nodes[own.node]._replace(value=block(line + 1, end))
            return end
        if value[0] in "[{" and not value.startswith("{{"):
            value, line = collection(value, line)
            children(own, _flow(value), line)
            return line + 1
        while value[0] in "\"'" and not re.fullmatch(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", value) and line + 1 < len(lines) and value.count(value[0]) % 2:
            line += 1
            value += " " + lines[line].strip()
        tree.nodes[own.node] = tree.nodes[own.node]._replace(value=_scalar(value))
        return line + 1

    def block(line: int, end: int) -> str:
        own = lines[line:end]
        margin = min((len(x) - len(x.lstrip()) for x in own if x.strip()), default=0)
        return "\n".join(x[margin:] for x in own).rstrip("\n")

    def collection(body: str, line: int) -> tuple[str, int]:
        """A flow collection with the lines that it runs over."""
        while sum(body.count(c) for c in "[{") > sum(body.count(c) for c in "]}") and line + 1 < len(lines):
            line += 1
            body += "\n" + _without_comment(lines[line].strip())
        return body, line

    def children(own: _Open, value: object, line: int) -> None:
        for k, v in value.items() if isinstance(value, dict) else (("[]", v) for v in value):
            tree.put(own.node, (*own.keys, k), v, line + 1)

    while at < len(lines):
        line = lines[at].rstrip("\r").replace("\t", "    ")
        if re.match(r"---(\s|$)|\.\.\.\s*$|%", line):
            tree.doc += bool(tree.nodes) and tree.nodes[-1].doc == tree.doc
            open_.clear()
            line = " " * 3 + line[3:] if line.startswith("---") else ""
        body = _without_comment(line)
        if not body.strip():
            at += 1
            continue
        indent = len(body) - len(body.lstrip())
        at = read(indent, body.strip(), at)
    return tree.nodes


def json_nodes(text: str) -> list[Node]:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return []
    tree = Tree()
    tree.put(-1, (), value, 0)
    return tree.nodes


def tree_nodes(files: DataFrame) -> DataFrame:
    """``NODES`` of every YAML and JSON file."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32()]
    names = [c.split()[0] for c in NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 32):
                some = b.slice(k, 32)
                rows = []
                for path, language, content in zip(*(some.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                    found = yaml_nodes(content) if language == "yaml" else json_nodes(content)
                    rows += [(path, n.doc, n.node, None if n.parent < 0 else n.parent, list(n.keys), n.value, n.line or None) for n in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    src = files.filter(F.col("language").isin("yaml", "json") & ~F.col("role").isin("generated", "sample") & F.col("content").isNotNull())
    return arrow_ready(src.select("path", "language", "content")).mapInArrow(run, NODES)


class TreeRule(NamedTuple):
    family: str
    label: str
    files: str  # a pattern over the path
    roots: tuple[str, ...]  # keys of the document's root of which it has one
    keys: str  # keys with slashes between them; * is one key, ** any number
    subject: str  # value, or the place of a key, from the end (-1 is the last)
    detail: str = ""


#: (fixed values: labels and keys)
TREE_RULES = [
    TreeRule("runtime", "kubernetes-kind", ".", ("apiVersion",), "kind", "value"),
    TreeRule("runtime", "kubernetes-name", ".", ("apiVersion",), "metadata/name", "value"),
    TreeRule("runtime", "kubernetes-image", ".", ("apiVersion",), "**/containers/[]/image", "value"),
    TreeRule("runtime", "kubernetes-image", ".", ("apiVersion",), "**/initContainers/[]/image", "value"),
    TreeRule("runtime", "kubernetes-schedule", ".", ("apiVersion",), "spec/schedule", "value"),
    TreeRule("runtime", "kubernetes-port", ".", ("apiVersion",), "**/ports/[]/containerPort", "value"),
    TreeRule("runtime", "kubernetes-env", ".", ("apiVersion",), "**/env/[]/name", "value"),
    TreeRule("runtime", "github-job", r"(^|/)\.github/workflows/", ("jobs",), "jobs/*", "-1"),
    TreeRule("runtime", "github-action", r"(^|/)\.github/workflows/", ("jobs",), "jobs/*/steps/[]/uses", "value", "-4"),
    TreeRule("runtime", "github-run", r"(^|/)\.github/workflows/", ("jobs",), "jobs/*/steps/[]/run", "value", "-4"),
    TreeRule("runtime", "github-action", r"(^|/)\.github/actions/", ("runs",), "runs/steps/[]/uses", "value"),
    TreeRule("runtime", "github-schedule", r"(^|/)\.github/workflows/", ("jobs",), "on/schedule/[]/cron", "value"),
    TreeRule("runtime", "compose-service", r"(^|/)(docker-)?compose[^/]*\.ya?ml$", ("services",), "services/*", "-1"),
    TreeRule("runtime", "compose-image", r"(^|/)(docker-)?compose[^/]*\.ya?ml$", ("services",), "services/*/image", "value", "-2"),
    TreeRule("runtime", "compose-port", r"(^|/)(docker-)?compose[^/]*\.ya?ml$", ("services",), "services/*/ports/[]", "value", "-3"),
    TreeRule("runtime", "gitlab-job", r"(^|/)\.gitlab-ci[^/]*\.ya?ml$", (), "*/script", "-2"),
    TreeRule("runtime", "spring-config", r"(^|/)(application|bootstrap)[^/]*\.ya?ml$", (), "**", "path"),
    TreeRule("runtime", "helm-chart", r"(^|/)Chart\.ya?ml$", ("apiVersion",), "name", "value"),
    TreeRule("runtime", "appsettings", r"(^|/)appsettings[^/]*\.json$", (), "**", "path"),
]
#: labels that these rules find, so that line rules need not
TREE_LABELS = sorted({r.label for r in TREE_RULES})


def matches_keys(keys: Column, pattern: str) -> Column:
    """Whether an array of keys fits a pattern; ``**`` may stand at its beginning only."""
    want = pattern.split("/")
    if want[0] != "**":
        return (F.size(keys) == len(want)) & _all([F.get(keys, F.lit(k)) == w if w != "*" else F.get(keys, F.lit(k)) != "[]" for k, w in enumerate(want)])
    want = want[1:]
    return (F.size(keys) >= len(want)) & _all([F.get(keys, F.size(keys) - (len(want) - k)) == w for k, w in enumerate(want)])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _taken(what: str) -> Column:
    if what == "value":
        return F.col("value")
    if what == "path":
        return F.when(F.col("value").isNotNull(), F.array_join(F.filter("keys", lambda k: k != "[]"), "."))
    return F.get("keys", F.size("keys") + int(what)) if what else F.lit(None).cast("string")


def tree_facts(nodes: DataFrame) -> DataFrame:
    """path, doc, family, kind, name, detail, line of every match of ``TREE_RULES`` in ``tree_nodes``."""
    roots = nodes.filter("parent is null").groupBy("path", "doc").agg(F.collect_set(F.get("keys", F.lit(0))).alias("roots"))
    both = nodes.join(roots, ["path", "doc"])
    hits = [
        F.when(
            F.col("path").rlike(r.files) & (F.arrays_overlap("roots", F.array(*map(F.lit, r.roots))) if r.roots else F.lit(True)) & matches_keys(F.col("keys"), r.keys),
            F.struct(F.lit(r.family).alias("family"), F.lit(r.label).alias("kind"), _taken(r.subject).alias("name"), _taken(r.detail).alias("detail")),
        )
        for r in TREE_RULES
    ]
    found = both.withColumn("hit", F.explode(F.array_compact(F.array(*hits))))
    return found.select("path", "doc", "hit.*", "line").filter("name is not null").distinct()


def openapi_routes(nodes: DataFrame) -> DataFrame:
    """path (file), doc, method, route, handler, parameters (names), n_responses, has_body, line of the operations of OpenAPI documents, YAML or JSON."""
    marked = nodes.filter("parent is null and keys[0] in ('openapi', 'swagger')").select("path", "doc").distinct()
    own = nodes.join(marked, ["path", "doc"], "left_semi").filter("keys[0] = 'paths' and size(keys) >= 3")
    op = own.filter(F.lower(F.get("keys", F.lit(2))).isin(*METHODS) | (F.get("keys", F.lit(2)) == "parameters"))
    rest = F.slice("keys", 4, F.greatest(F.size("keys") - 3, F.lit(0)))
    at = F.array_join(rest, "/")
    rows = op.groupBy("path", "doc", F.get("keys", F.lit(1)).alias("route"), F.lower(F.get("keys", F.lit(2))).alias("method")).agg(
        F.min(F.when(F.size("keys") == 3, F.col("line"))).alias("line"),
        F.max(F.when(at == "operationId", F.col("value"))).alias("handler"),
        F.collect_list(F.when((at == "parameters/[]/name") | ((F.get("keys", F.lit(2)) == "parameters") & (at == "[]/name")), F.struct("node", F.col("value").alias("name")))).alias("named"),
        F.count_if((F.size("keys") == 5) & (F.get("keys", F.lit(3)) == "responses")).alias("n_responses"),
        F.max(F.coalesce(F.get("keys", F.lit(3)) == "requestBody", F.lit(False))).alias("has_body"),
    )
    shared = rows.filter("method = 'parameters'").select("path", "doc", "route", F.col("named").alias("shared"))
    both = rows.filter("method <> 'parameters'").join(shared, ["path", "doc", "route"], "left")
    names = F.concat(F.coalesce(F.array_sort("shared").getField("name"), F.array().cast("array<string>")), F.array_sort("named").getField("name"))
    return both.select("path", "doc", F.upper("method").alias("method"), normalize_path(F.col("route")).alias("route"), "handler", names.alias("parameters"), "n_responses", "has_body", "line")


def spec_routes(nodes: DataFrame) -> DataFrame:
    """The operations of OpenAPI documents with the columns of ``api_routes``."""
    own = openapi_routes(nodes)
    place = F.struct(F.col("path").alias("file"), F.lit("route").alias("kind"), F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.lit(None).cast("string").alias("note"))
    none = F.lit(None).cast("string")
    return own.select("method", F.col("route").alias("path"), "handler", F.lit("openapi").alias("framework"), F.lit("openapi-spec-route").alias("kind"), none.alias("class_prefix"), place.alias("evidence"), F.col("route").alias("own_path"))


def written_nodes(files: DataFrame) -> DataFrame:
    return stored(tree_nodes(files), "tree-nodes")
