"""Frontend routes under their full paths: nested elements and route objects, lazy modules and routes of other files.

In a file a route is a ``<Route>`` element or an object with a path and something that routes have; its parent is the route
around it, by the stack of tags or by the tree of blocks.  Across files a route leads to another file by a lazy import, by a
component whose path goes on (``/*``), or by children that are imported; these edges are closed over files with the prefixes
that they carry, and a chain that comes back to a file ends there.  A child's path that begins with a slash stands for itself
within its file.  A file that several routes lead to has its routes under each; one that none leads to keeps its own paths, and
so do files that only lead to each other.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import arrow_ready, stored
from .lexing import Lines, Masks, blocks
from .relate import import_targets, mount_closure, union_all
from .wrappers import SCRIPTS, visible_names

FOUND = "path string, kind string, route string, component string, module string, uses string, leaf boolean, line int"
_HAS = r"(?:component|element|Component|children|loadChildren|loadComponent|lazy|redirectTo|redirect)"
_PATH = re.compile(r"(?:^|[{,])\s*path\s*:\s*(?P<q>[\"'`])(?P<path>[^\"'`\n]*)(?P=q)|(?:^|[{,])\s*(?P<index>index)\s*:\s*true\b", re.MULTILINE)
_TAG = re.compile(r"<(?P<close>/?)Route\b")
_LAZY = re.compile(r"\b(?:const|let|var)\s+(?P<name>\w+)\s*=\s*(?:React\.)?(?:lazy|loadable|defineAsyncComponent)\(\s*\(\s*\)\s*=>\s*import\(\s*[\"'](?P<module>[^\"'\n]+)[\"']|\b(?:const|let|var)\s+(?P<plain>\w+)\s*=\s*\(\s*\)\s*=>\s*import\(\s*[\"'](?P<where>[^\"'\n]+)[\"']")


def joined(parent: str, own: str) -> str:
    """A child's path under its parent's."""
    above = [] if own.startswith("/") and own != "/" else parent.strip("/").split("/")
    return "/" + "/".join(x for x in (*above, *own.strip("/").split("/")) if x and x != "*")


def route_nodes(text: str, language: str) -> list[tuple]:
    """(kind, route, component, module, uses, leaf, line) of each route of a script; uses: a name that its children come from."""
    masks, lines = Masks(text, language), Lines(text)
    tree = blocks(text, language)
    opens = [b.start for b in tree]
    lazy = {m["name"] or m["plain"]: m["module"] or m["where"] for m in _LAZY.finditer(text) if not masks.kind(m.start())}
    out: list[tuple] = []

    def innermost(place: int) -> int:
        k = bisect_right(opens, place) - 1
        while k >= 0 and not tree[k].body <= place < tree[k].end:
            k = tree[k].parent
        return k

    def put(kind: str, route: str, goes_on: bool, component: str | None, module: str | None, uses: str | None, leaf: bool, place: int) -> None:
        module = module or lazy.get(component or "")
        out.append((kind, route, component, module, uses or (component if goes_on and not module else None), leaf, lines.of(place)))

    # route objects
    kind = "angular" if re.search(r"@angular/router|\bload(?:Children|Component)\b", text) else "vue-router" if re.search(r"vue-router|\bcomponent\s*:", text) else "react-router"
    own: dict[int, tuple[str, int]] = {}
    for m in _PATH.finditer(text):
        place = m.end() - 1
        start = m.start() + len(m[0]) - len(m[0].lstrip("{, \t\n"))
        k = innermost(start)
        if not masks.kind(start) and k >= 0 and tree[k].opener == "{" and k not in own:
            own[k] = (m["path"] or "", place)

    def prop(k: int, pattern: str) -> re.Match | None:
        """A property of an object itself, not of one inside it."""
        for m in re.compile(rf"(?<![\w$.])(?:{pattern})").finditer(text, tree[k].body, tree[k].end):
            if not masks.kind(m.start()) and innermost(m.start()) == k:
                return m
        return None

    full: dict[int, str] = {}
    for k in sorted(own):
        if not prop(k, rf"{_HAS}\s*[:(,}}]"):
            continue
        above = tree[k].parent
        while above >= 0 and above not in full:
            above = tree[above].parent
        route, place = own[k]
        full[k] = joined(full.get(above, ""), route)
        component = prop(k, r"(?:component|Component)\s*:\s*(?P<name>[A-Z]\w*)|element\s*:\s*<\s*(?P<tag>[A-Z]\w*)")
        module = prop(k, r"(?:component|loadChildren|loadComponent|lazy|Component)\s*(?::\s*(?:async\s*)?\([^()]*\)\s*=>|\(\s*\)\s*\{)[\s\S]{0,200}?import\(\s*[\"'](?P<module>[^\"'\n]+)[\"']")
        children = prop(k, r"children\s*:\s*(?P<name>[A-Za-z_$]\w*)|children\s*:\s*\[\s*\.\.\.(?P<spread>[A-Za-z_$]\w*)")
        put(kind, full[k], route.endswith("*"), component and (component["name"] or component["tag"]), module and module["module"], children and (children["name"] or children["spread"]), not prop(k, "children"), place)

    # route elements
    stack: list[str] = []
    for m in _TAG.finditer(text):
        if masks.kind(m.start()):
            continue
        if m["close"]:
            if stack:
                stack.pop()
            continue
        at = m.end()
        while at < len(text) and text[at] != ">":
            k = bisect_right(opens, at) - 1
            at = tree[k].end + 1 if k >= 0 and tree[k].start == at and tree[k].opener == "{" else at + 1
        head = text[m.end() : at]
        path = re.search(r"\bpath=\{?\s*[\"'`]([^\"'`\n]*)", head)
        component = re.search(r"\b(?:element|component|Component)=\{\s*(?:<\s*)?([A-Z]\w*)", head)
        route = joined(stack[-1] if stack else "", path[1] if path else "")
        closed = head.rstrip().endswith("/")
        if path or re.search(r"\bindex\b", head):
            put("react-router", route, bool(path) and path[1].endswith("*"), component and component[1], None, None, closed, m.start())
        if not closed:
            stack.append(route)
    return out


def scan_routes(files: DataFrame) -> DataFrame:
    """``FOUND``: the routes of every script file, as the file has them."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.string()] * 6 + [pa.bool_(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                some = b.slice(k, 64)
                rows = [(path, *r) for path, language, content in zip(*(some.column(c).to_pylist() for c in ("path", "language", "content")), strict=True) for r in route_nodes(content, language)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    src = files.filter(F.col("language").isin(*SCRIPTS) & ~F.col("role").isin("test", "generated", "sample") & F.col("content").rlike(r"\bpath\b|<Route\b"))
    return arrow_ready(src.select("path", "language", "content")).mapInArrow(run, FOUND)


def frontend_routes(files: DataFrame, raw: DataFrame) -> DataFrame:
    """path, kind, name (the full route), component, line of the routes of script files."""
    known = stored(files.filter("content is not null").select("path", "language", "role"), "paths")
    found = stored(scan_routes(files), "frontend-routes")
    lazy = found.filter("module is not null").select("path", F.col("module").alias("name"), F.col("route").alias("prefix")).distinct()
    by_module = lazy.join(import_targets(lazy.select("path", "name").distinct(), known), ["path", "name"]).select("path", "target", "prefix")
    names = visible_names(raw, known).select("path", F.col("variable").alias("uses"), "target").distinct()
    by_name = found.filter("uses is not null").select("path", "uses", F.col("route").alias("prefix")).distinct().join(names, ["path", "uses"]).select("path", "target", "prefix")
    # a module of its own hands its routes on to the routing module that it imports
    imports = raw.filter(r"family = 'import' and path like '%.module.ts' and subject rlike '[.-](routing|routes)'").select("path", F.col("subject").alias("name")).distinct()
    by_routing = imports.join(import_targets(imports, known), ["path", "name"]).select("path", "target", F.lit("").alias("prefix"))
    edges = union_all([by_module, by_name, by_routing]).filter("path <> target").select(F.col("path").alias("parent"), F.col("target").alias("child"), "prefix").distinct()
    edges = stored(edges, "route-edges")
    child = edges.select(F.col("child").alias("node")).distinct()
    roots = edges.select(F.col("parent").alias("node")).distinct().join(child, "node", "left_anti")
    closed = mount_closure(edges, roots).filter("depth > 0").select(F.col("node").alias("path"), "prefix").distinct()
    both = found.join(closed, "path", "left")
    name = F.regexp_replace(F.concat(F.coalesce("prefix", F.lit("")), F.lit("/"), "route"), "/+", "/")
    name = F.when(F.length(name) > 1, F.regexp_replace(name, "/$", "")).otherwise(name)
    return both.select("path", "kind", name.alias("name"), "component", "line").distinct()
